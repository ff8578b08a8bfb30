"""Windows, lags, streaks, indices and the hourly feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.catalog.registry import oracle, query
from hydrolake.functions import calendar, numeric, risk
from hydrolake.operators import rolling, series, timegrid
from hydrolake.plans import features, scoring
from hydrolake.sources import relations as rel

W = 'partition by loc order by "time"'
WD = "partition by loc order by tanggal"


def rows_between(n: int, order: str = W) -> str:
    return f"over ({order} rows between {n - 1} preceding and current row)"


def hourly(spark, d):
    return series.hour_index(rel.obs_hourly(spark, d))


def daily(spark, d):
    return series.row_index(rel.obs_daily(spark, d), "tanggal", bucket=F.trunc("tanggal", "year"))


@query(oracle("loc time:t rain_3h:d rain_24h:d rain_72h:d rain_168h:d", f"""
select loc, "time", {", ".join(f"sum(precipitation) {rows_between(n)} as rain_{n}h" for n in (3, 24, 72, 168))} from obs_hourly""", "obs_hourly"))
def rolling_rain(spark, d):
    return rolling.rolling_rain(hourly(spark, d)).select("loc", "time", "rain_3h", "rain_24h", "rain_72h", "rain_168h")


@query(oracle("loc time:t wind_24h:d", f'select loc, "time", max(wind_speed) {rows_between(24)} as wind_24h from obs_hourly', "obs_hourly"))
def rolling_wind(spark, d):
    return rolling.rolling(hourly(spark, d), "wind_speed", 24, F.max, "wind_24h").select("loc", "time", "wind_24h")


@query(oracle("loc time:t rainfall_acceleration:d", f"""
select loc, "time", coalesce(m - lag(m) over ({W}), 0) as rainfall_acceleration
from (select loc, "time", avg(precipitation) {rows_between(3)} as m from obs_hourly)""", "obs_hourly"))
def rain_acceleration(spark, d):
    return rolling.rain_acceleration(hourly(spark, d)).select("loc", "time", "rainfall_acceleration")


@query(oracle("loc time:t rain_burst_count:i", f"""
select loc, "time", sum(case when precipitation > 10 then 1 else 0 end) {rows_between(24)} as rain_burst_count from obs_hourly""", "obs_hourly"))
def burst_count(spark, d):
    return rolling.burst_count(hourly(spark, d)).select("loc", "time", "rain_burst_count")


@query(oracle("loc time:t durasi_hujan_jam:i", f"""
select loc, "time", case when count(*) {rows_between(24)} = 24 then sum(case when precipitation > 0 then 1 else 0 end) {rows_between(24)} end as durasi_hujan_jam
from obs_hourly""", "obs_hourly"))
def rain_duration(spark, d):
    return rolling.rain_duration(hourly(spark, d)).select("loc", "time", "durasi_hujan_jam")


@query(oracle("loc time:t soil_saturation_trend:d", f"""
select loc, "time", coalesce(s - lag(s, 72) over ({W}), 0) as soil_saturation_trend
from (select loc, "time", (soil_moisture_surface + soil_moisture_root)/2 as s from obs_hourly)""", "obs_hourly"))
def soil_trend(spark, d):
    s = hourly(spark, d).withColumn("s", (F.col("soil_moisture_surface") + F.col("soil_moisture_root")) / 2)
    return rolling.diff(s, "s", 72, "soil_saturation_trend").select("loc", "time", "soil_saturation_trend")


@query(oracle("loc tanggal:t " + " ".join(f"rain_lag{k}:d" for k in range(1, 8)), f"""
select loc, tanggal, {", ".join(f"coalesce(lag(rain_sum_imputed, {k}) over ({WD}), 0) as rain_lag{k}" for k in range(1, 8))} from obs_daily""", "obs_daily"))
def row_lags(spark, d):
    return rolling.row_lags(daily(spark, d), "rain_sum_imputed", range(1, 8), "rain_lag").select("loc", "tanggal", *config.LAG_FEATURES)


@query(oracle("loc tanggal:t " + " ".join(f"rain_lag{k}:d" for k in range(1, 8)), f"""
select loc, tanggal, {", ".join(f"coalesce(sum(rain_sum_imputed) over ({WD} range between interval {k} day preceding and interval {k} day preceding), 0) as rain_lag{k}" for k in range(1, 8))} from obs_daily""", "obs_daily"))
def calendar_lags(spark, d):
    return timegrid.calendar_lags(rel.obs_daily(spark, d), "rain_sum_imputed").select("loc", "tanggal", *config.LAG_FEATURES)


@query(oracle("loc tanggal:t rain_cumsum_3d:d rain_cumsum_7d:d strict_3d:d", f"""
select loc, tanggal, sum(rain_sum_imputed) {rows_between(3, WD)} as rain_cumsum_3d, sum(rain_sum_imputed) {rows_between(7, WD)} as rain_cumsum_7d,
 case when count(*) {rows_between(3, WD)} = 3 then sum(rain_sum_imputed) {rows_between(3, WD)} end as strict_3d from obs_daily""", "obs_daily"))
def daily_cumsum(spark, d):
    s = series.Series(daily(spark, d), back=6)
    s.add(
        rain_cumsum_3d=s.rolling("rain_sum_imputed", 3),
        rain_cumsum_7d=s.rolling("rain_sum_imputed", 7),
        strict_3d=s.rolling("rain_sum_imputed", 3, min_rows=3),
    )
    return s.rows().select("loc", "tanggal", "rain_cumsum_3d", "rain_cumsum_7d", "strict_3d")


@query(oracle("loc tanggal:t prev_flood_30d:i prev_meluap_30d:i flood_incl:i meluap_incl:i", f"""
select loc, tanggal,
 coalesce(sum(f) over ({WD} rows between 30 preceding and 1 preceding), 0) as prev_flood_30d,
 coalesce(sum(m) over ({WD} rows between 30 preceding and 1 preceding), 0) as prev_meluap_30d,
 sum(f) {rows_between(30, WD)} as flood_incl, sum(m) {rows_between(30, WD)} as meluap_incl
from (select loc, tanggal, case when status_siaga='Banjir' then 1 else 0 end as f, case when status_siaga in ('Banjir','Air Meluap') then 1 else 0 end as m from obs_daily)""", "obs_daily"))
def flood_history_30d(spark, d):
    label = F.when(F.col("status_siaga") == "Banjir", 2).when(F.col("status_siaga") == "Air Meluap", 1).otherwise(0)
    s = series.Series(daily(spark, d).withColumn("label", label), back=30)
    rolling.add_flood_history(s, 30)
    s.count_last(30, flood_incl=F.col("label") == 2, meluap_incl=F.col("label") >= 1)
    return s.rows().select("loc", "tanggal", "prev_flood_30d", "prev_meluap_30d", "flood_incl", "meluap_incl")


STREAK = """select loc, {t}, case when wet=1 then sum(wet) over (partition by loc, island order by {t}) else 0 end as {name}
from (select loc, {t}, wet, sum(chg) over (partition by loc order by {t}) as island
 from (select loc, {t}, wet, case when wet = lag(wet) over (partition by loc order by {t}) then 0 else 1 end as chg
  from (select loc, {t}, case when {rain} > 0 then 1 else 0 end as wet from {rel})))"""


@query(oracle("loc time:t wet_hours:i consecutive_rain_days:d", "select *, wet_hours/24.0::double as consecutive_rain_days from ("
       + STREAK.format(t='"time"', name="wet_hours", rain="precipitation", rel="obs_hourly") + ")", "obs_hourly"))
def rain_streaks(spark, d):
    return rolling.rain_streaks(hourly(spark, d), "precipitation", "wet_hours", size=168).select(
        "loc", "time", "wet_hours", (F.col("wet_hours") / 24.0).alias("consecutive_rain_days")
    )


@query(oracle("loc time:t depth_cm:d smooth_depth_cm:d", f"""
select loc, "time", depth_cm, avg(depth_cm) over ({W} rows between 1 preceding and 1 following) as smooth_depth_cm
from (select loc, "time", 2*precipitation + 20*greatest(est-2.5::double, 0) as depth_cm from obs_hourly)""", "obs_hourly"))
def smooth_depth(spark, d):
    h = hourly(spark, d).withColumn("depth_cm", risk.formula_depth("precipitation", "est"))
    return rolling.centered_mean(h, "depth_cm", 1, "smooth_depth_cm").select("loc", "time", "depth_cm", "smooth_depth_cm")


@query(oracle("loc time:t est:d tide_change:d tide_trend tide_slope:d", f"""
select *, case when abs(tide_change) < 0.05 then 'Stabil' when tide_change > 0 then 'Pasang Naik' else 'Surut' end as tide_trend from (
select loc, "time", est, coalesce(round(est - lag(est) over ({W}), 6), round(est - lead(est) over ({W}), 6), 0) as tide_change,
 coalesce(est - lag(est) over ({W}), 0) as tide_slope from obs_hourly)""", "obs_hourly"))
def tide_trend(spark, d):
    s = series.Series(hourly(spark, d), back=1, ahead=1)
    s.add(
        # two-decimal readings: rounding keeps 0.05 steps from falling either side of the limit
        tide_change=F.coalesce(
            F.round(F.col("est") - s.lag("est"), 6), F.round(F.col("est") - s.lead("est"), 6), F.lit(0.0)
        ),
        tide_slope=s.diff("est"),
    )
    return s.rows().select("loc", "time", "est", "tide_change", risk.tide_trend_class("tide_change").alias("tide_trend"), "tide_slope")


@query(oracle("loc time:t rain_recent_6h:d tail_6h:d upstream_status", """
select a.loc, a."time", a.s as rain_recent_6h, t.s as tail_6h,
 case when a.s > 20 then 'Hujan Deras' when a.s > 5 then 'Hujan Ringan' else 'Kering/Aman' end as upstream_status
from w a join w t on a.loc = t.loc where a."time" = (select max("time") - interval 14 day from obs_hourly) and t."time" = (select max("time") from obs_hourly)""",
 "obs_hourly", {"w": f"""select loc, "time", case when count(*) {rows_between(6)} = 6 then sum(upstream_precipitation) {rows_between(6)} end as s from obs_hourly"""}))
def upstream_recent(spark, d):
    h = rel.obs_hourly(spark, d)
    as_of = as_of_time(spark, d)
    return timegrid.upstream_recent(h, as_of, rain="upstream_precipitation").select(
        "loc", "time", "rain_recent_6h", "tail_6h", risk.upstream_status("rain_recent_6h").alias("upstream_status")
    )


def as_of_time(spark, d):
    """The moment taken as now: 14 days before the last event, on the hour."""
    last = rel.table(spark, d, "events").select(F.max("ts").alias("t"))
    last = last.select((F.date_trunc("hour", "t").cast("timestamp_ntz") - F.expr("interval 14 days")).alias("t"))
    return last.scalar()


@query(oracle("loc tanggal:t api:d", f"""
select loc, tanggal, list_reduce(list(rain_sum_imputed) over ({WD} rows between unbounded preceding and current row), lambda a, x: a*0.85::double + x) as api from obs_daily""", "obs_daily"))
def api_recursive(spark, d):
    return rolling.api_recursive(daily(spark, d), "rain_sum_imputed").select("loc", "tanggal", "api")


LAG_API = " + ".join(f"power(0.85::double, {k})*coalesce(lag(rain_sum_imputed, {k}) over ({WD}), 0)" for k in range(1, 8))


@query(oracle("loc tanggal:t api_7day:d", f"select loc, tanggal, rain_sum_imputed + {LAG_API} as api_7day from obs_daily", "obs_daily"))
def api_7day(spark, d):
    lagged = rolling.row_lags(daily(spark, d), "rain_sum_imputed", range(1, 8), "rain_lag")
    cols = [F.col("rain_sum_imputed"), *[F.col(c) for c in config.LAG_FEATURES]]
    return lagged.select("loc", "tanggal", rolling.api_lags(cols).alias("api_7day"))


DAYSUM = """select loc, cast("time" as date) as dt, sum(precipitation) as rain from obs_hourly group by 1, 2"""


@query(oracle("loc time:t hujan_3days:d", f"""
select h.loc, h."time", h.s24 + 0.85::double*(coalesce(d1.rain,0) + 0.85::double*(coalesce(d2.rain,0) + 0.85::double*coalesce(d3.rain,0))) as hujan_3days
from (select loc, "time", cast("time" as date) as dt, sum(precipitation) {rows_between(24)} as s24 from obs_hourly) h
{" ".join(f"left join daysum d{k} on d{k}.loc = h.loc and d{k}.dt = h.dt - {k}" for k in (1, 2, 3))}""", "obs_hourly", {"daysum": DAYSUM}))
def api_3day(spark, d):
    return features.legacy_v1_hourly(rel.obs_hourly(spark, d)).select("loc", "time", "hujan_3days")


@query(oracle("loc time:t curah_hujan_mm:d durasi_hujan_jam:i pasut_msl_max:d pasut_slope:d hujan_lag1:d hujan_lag2:d hujan_lag3:d hujan_3days:d", f"""
select h.loc, h."time", s24 as curah_hujan_mm, coalesce(dur, 0) as durasi_hujan_jam, est as pasut_msl_max, slope as pasut_slope,
 coalesce(d1.rain,0) as hujan_lag1, coalesce(d2.rain,0) as hujan_lag2, coalesce(d3.rain,0) as hujan_lag3,
 s24 + 0.85::double*coalesce(d1.rain,0) + power(0.85::double,2)*coalesce(d2.rain,0) + power(0.85::double,3)*coalesce(d3.rain,0) as hujan_3days
from (select loc, "time", est, cast("time" as date) as dt, sum(precipitation) {rows_between(24)} as s24, coalesce(est - lag(est) over ({W}), 0) as slope,
 case when count(*) {rows_between(24)} = 24 then sum(case when precipitation > 0 then 1 else 0 end) {rows_between(24)} end as dur from obs_hourly) h
{" ".join(f"left join daysum d{k} on d{k}.loc = h.loc and d{k}.dt = h.dt - {k}" for k in (1, 2, 3))}""", "obs_hourly", {"daysum": DAYSUM}))
def legacy_v1_features(spark, d):
    f = features.legacy_v1_hourly(rel.obs_hourly(spark, d))
    return f.withColumn("durasi_hujan_jam", F.col("durasi_hujan_jam").cast("long"))


@query(oracle("loc tanggal:t pasut_msl_max:d pasut_max_lag1:d", f"""
select loc, tanggal, pasut_msl_max, coalesce(first_value(l ignore nulls) over ({WD} rows between current row and unbounded following), null) as pasut_max_lag1
from (select loc, tanggal, pasut_msl_max, lag(pasut_msl_max) over ({WD}) as l from obs_daily)""", "obs_daily"))
def lag_backfill(spark, d):
    return series.backfill_first(daily(spark, d), "pasut_msl_max", "pasut_max_lag1", size=64).select(
        "loc", "tanggal", "pasut_msl_max", "pasut_max_lag1"
    )


HOURLY_ORACLE = f"""
select h.loc, h."time", s24 as rain_sum_imputed, precipitation as rain_intensity_max, soil_moisture_surface as soil_moisture_surface_mean,
 soil_moisture_root as soil_moisture_root_mean, est as pasut_msl_max,
 {", ".join(f"coalesce(d{k}.rain, 0) as rain_lag{k}" for k in range(1, 8))},
 sat as soil_saturation_index, s72 as rain_cumsum_3d, s168 as rain_cumsum_7d, est*s24 as tide_rain_interaction,
 case when est > 2.5 then 1 else 0 end as is_high_tide, case when s24 > 50 then 1 else 0 end as is_heavy_rain,
 s24 + {" + ".join(f"power(0.85::double,{k})*coalesce(d{k}.rain, 0)" for k in range(1, 8))} as api_7day,
 sin(2*pi()*month(h."time")/12) as month_sin, cos(2*pi()*month(h."time")/12) as month_cos,
 case when month(h."time") in (11,12,1,2,3) then 1 else 0 end as is_rainy_season, case when isodow(h."time") >= 6 then 1 else 0 end as is_weekend,
 0 as prev_flood_30d, 0 as prev_meluap_30d, s3 as rain_intensity_3h, burst as rain_burst_count, coalesce(sat - sat72, 0) as soil_saturation_trend,
 case when est > 2.5 and s24 > 50 then 1 else 0 end as tide_rain_sync, st.wet_hours/24.0::double as consecutive_rain_days,
 case when hour(h."time") >= 22 or hour(h."time") <= 6 then 1.2::double else 1.0::double end as hour_risk_factor,
 least(greatest(s168/200, 0), 2) as drain_capacity_index, upstream_precipitation as upstream_rain_6h, wind as wind_speed_max,
 coalesce(m3 - m3p, 0) as rainfall_acceleration, 2.0::double as elevation_m, 50.0::double as drainage_capacity
from (select *, lag(sat, 72) over ({W}) as sat72, lag(m3) over ({W}) as m3p from (
  select *, cast("time" as date) as dt, (soil_moisture_surface+soil_moisture_root)/2 as sat, sum(precipitation) {rows_between(24)} as s24,
  sum(precipitation) {rows_between(3)} as s3, sum(precipitation) {rows_between(72)} as s72, sum(precipitation) {rows_between(168)} as s168,
  avg(precipitation) {rows_between(3)} as m3, max(wind_speed) {rows_between(24)} as wind,
  sum(case when precipitation > 10 then 1 else 0 end) {rows_between(24)} as burst from obs_hourly)) h
{" ".join(f"left join daysum d{k} on d{k}.loc = h.loc and d{k}.dt = h.dt - {k}" for k in range(1, 8))}
join streaks st on st.loc = h.loc and st."time" = h."time" """
INT_FEATURES = {"is_high_tide", "is_heavy_rain", "is_rainy_season", "is_weekend", "prev_flood_30d", "prev_meluap_30d", "tide_rain_sync"}
V7_COLUMNS = " ".join(f"{c}:i" if c in INT_FEATURES else f"{c}:d" for c in config.FEATURES_V7)


@query(oracle("loc time:t " + V7_COLUMNS, HOURLY_ORACLE, "obs_hourly",
              {"daysum": DAYSUM, "streaks": STREAK.format(t='"time"', name="wet_hours", rain="precipitation", rel="obs_hourly")}))
def hourly_feature_store(spark, d):
    return features.hourly_features(rel.obs_hourly(spark, d))


STATUS_ORACLE = f"""select *, case when depth_cm < 20 then 'AMAN' when depth_cm < 50 then 'WASPADA' when depth_cm < 100 then 'SIAGA' else 'AWAS' end as status
from (select loc, "time", est, precipitation, soil_moisture_surface, soil_moisture_root, sum(precipitation) {rows_between(24)} as rain_rolling_24h,
 avg(2*precipitation + 20*greatest(est-2.5::double, 0)) over ({W} rows between 1 preceding and 1 following) as depth_cm from obs_hourly)"""
STATUS_COLUMNS = "loc time:t depth_cm:d status rain_rolling_24h:d est:d precipitation:d soil_moisture_surface:d soil_moisture_root:d"


@query(oracle(STATUS_COLUMNS, STATUS_ORACLE, "obs_hourly"))
def hourly_risk_status(spark, d):
    return scoring.score_series(rel.obs_hourly(spark, d))


@query(oracle("loc max_depth_cm:d", f"select loc, max(depth_cm) as max_depth_cm from ({STATUS_ORACLE}) group by loc", "obs_hourly"))
def max_depth_by_loc(spark, d):
    return scoring.max_depth(scoring.score_series(rel.obs_hourly(spark, d)))


@query(oracle("loc time:t is_high_tide:i is_heavy_rain:i tide_rain_sync:i is_burst:i", """
select loc, "time", case when est > 2.5 then 1 else 0 end as is_high_tide, case when precipitation > 50 then 1 else 0 end as is_heavy_rain,
 case when est > 2.5 and precipitation > 50 then 1 else 0 end as tide_rain_sync, case when precipitation > 10 then 1 else 0 end as is_burst from obs_sparse_tide""",
 "obs_hourly", {"obs_sparse_tide": """select h.loc, h."time", h.est, s.precipitation from obs_hourly h join obs_sparse s on s.loc=h.loc and s."time"=h."time" """}))
def threshold_flags(spark, d):
    rows = rel.obs_sparse(spark, d).select("loc", "time", "precipitation").join(rel.tide_hourly(spark, d), ["loc", "time"])
    return rows.select(
        "loc", "time",
        *[c.alias(n) for n, c in risk.threshold_flags("est", "precipitation").items()],
        numeric.flag(F.col("precipitation") > config.RAIN_BURST).alias("is_burst"),
    )
