"""Time axes, roll-ups, logs, calendar columns and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.catalog.registry import oracle, query
from hydrolake.catalog.series_queries import as_of_time
from hydrolake.functions import calendar, numeric, risk, text
from hydrolake.operators import alerts, ranking, rollups, stats, timegrid
from hydrolake.plans import datasets, features, outlook
from hydrolake.sources import relations as rel

AS_OF = """(select date_trunc('hour', max(ts)) - interval 14 day from events)"""


@query(oracle("time:t", """select unnest(generate_series((select date_trunc('hour', min(ts)) from events), (select date_trunc('hour', max(ts)) - interval 1 hour from events), interval 1 hour)) as "time" """))
def hour_axis(spark, d):
    e = rel.table(spark, d, "events")
    bounds = e.agg(
        F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("start"),
        (F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz") - F.expr("interval 1 hour")).alias("end"),
    )
    return timegrid.axis_of(bounds)


HOURLY_COLUMNS = "loc time:t precipitation:d soil_moisture_surface:d soil_moisture_root:d wind_speed:d upstream_precipitation:d"


@query(oracle(HOURLY_COLUMNS, "select * from obs_hourly", "obs_hourly"))
def gap_fill_hourly(spark, d):
    defaults = {**config.HOURLY_DEFAULTS, "upstream_precipitation": 0.0}
    return timegrid.gap_fill(rel.obs_sparse(spark, d), defaults)


@query(oracle("loc time:t precipitation:d soil_moisture_surface:d soil_moisture_root:d wind_speed:d rain_rolling_24h:d rain_rolling_3h:d wind_speed_max_24h:d", f"""
select loc, unnest(generate_series({AS_OF} - interval 3 day, {AS_OF} + interval 14 day, interval 1 hour)) as "time", 0 as precipitation, 0.4 as soil_moisture_surface,
 0.4 as soil_moisture_root, 2.0 as wind_speed, 0 as rain_rolling_24h, 0 as rain_rolling_3h, 2.0 as wind_speed_max_24h from (select distinct loc from gauge_events)""", "gauge_events"))
def fallback_series(spark, d):
    locs = rel.gauge_events(spark, d).select("loc").distinct()
    return timegrid.fallback_series(locs, as_of_time(spark, d), config.HOURLY_DEFAULTS)


@query(oracle("loc tanggal:t rain_sum_imputed:d rain_intensity_max:d soil_moisture_surface_mean:d soil_moisture_root_mean:d", """
select loc, cast("time" as date) as tanggal, sum(precipitation) as rain_sum_imputed, max(precipitation) as rain_intensity_max,
 avg(soil_moisture_surface) as soil_moisture_surface_mean, avg(soil_moisture_root) as soil_moisture_root_mean from obs_hourly group by 1, 2""", "obs_hourly"))
def daily_rollup(spark, d):
    return rollups.daily_rollup(rel.obs_hourly(spark, d))


V6_DAILY = """select loc, cast("time" as date) as tanggal, max(r3) as rain_intensity_3h, sum(case when precipitation > 10 then 1 else 0 end) as rain_burst_count,
 sum(case when hour("time") >= 22 or hour("time") <= 6 then precipitation else 0 end) as night, sum(precipitation) as rain, max(wind_speed) as wind_speed_max
 from (select *, sum(precipitation) over (partition by loc order by "time" rows between 2 preceding and current row) as r3 from obs_hourly) group by 1, 2"""
V6_UP = """select loc, cast("time" + interval 6 hour as date) as tanggal, sum(upstream_precipitation) as upstream_rain_6h from obs_hourly group by 1, 2"""


@query(oracle("loc tanggal:t rain_intensity_3h:d rain_burst_count:i hour_risk_factor:d wind_speed_max:d upstream_rain_6h:d", """
select v.loc, v.tanggal, rain_intensity_3h, rain_burst_count, least(greatest(1.0::double + 0.2::double*night/(rain + 1e-5::double), 0.8), 1.2) as hour_risk_factor, wind_speed_max,
 coalesce(upstream_rain_6h, 0) as upstream_rain_6h from v left join up u on u.loc=v.loc and u.tanggal=v.tanggal""", "obs_hourly", {"v": V6_DAILY, "up": V6_UP}))
def daily_v6_features(spark, d):
    h = rel.obs_hourly(spark, d)
    rain = h.groupBy("loc", F.to_date("time").alias("tanggal")).agg(F.sum("precipitation").alias("rain"))
    days = rollups.daily_hydrology(h).join(rain, ["loc", "tanggal"]).join(rollups.upstream_lagged(h), ["loc", "tanggal"], "left")
    return days.select(
        "loc", "tanggal", "rain_intensity_3h", "rain_burst_count",
        rollups.hour_risk(F.col("night_rain_total"), F.col("rain")).alias("hour_risk_factor"), "wind_speed_max",
        F.coalesce("upstream_rain_6h", F.lit(0.0)).alias("upstream_rain_6h"),
    )


@query(oracle("loc time:t precipitation:d upstream_precipitation:d", """
select l.loc, l."time", l.precipitation, coalesce(u.upstream_precipitation, 0) as upstream_precipitation from obs_sparse l left join obs_sparse u on u.loc = l.loc and u."time" + interval 6 hour = l."time" """, "obs_sparse"))
def upstream_lagged(spark, d):
    o = rel.obs_sparse(spark, d)
    up = timegrid.shift_time(o.select("loc", "time", "upstream_precipitation"), config.UPSTREAM_LAG_HOURS)
    # hours that are dry upstream have no row there
    found = o.select("loc", "time", "precipitation").join(up, ["loc", "time"], "left")
    return found.withColumn("upstream_precipitation", F.coalesce("upstream_precipitation", F.lit(0.0)))


@query(oracle("loc time:t month:i month_sin:d month_cos:d is_rainy_season:i day_of_week:i is_weekend:i is_rainy_outlook:i hour_risk_factor:d", """
select loc, "time", month("time") as month, sin(2*pi()*month("time")/12) as month_sin, cos(2*pi()*month("time")/12) as month_cos,
 case when month("time") in (11,12,1,2,3) then 1 else 0 end as is_rainy_season, isodow("time") - 1 as day_of_week, case when isodow("time") >= 6 then 1 else 0 end as is_weekend,
 case when month("time") in (11,12,1,2,3,4) then 1 else 0 end as is_rainy_outlook, case when hour("time") >= 22 or hour("time") <= 6 then 1.2 else 1.0 end as hour_risk_factor
from (select l_suppkey as loc, l_shipdate + to_hours(l_orderkey % 24) as "time", l_orderkey, l_linenumber from lineitem)"""))
def calendar_features(spark, d):
    li = rel.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("loc"), F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int))").alias("time")
    )
    return li.select(
        "loc", "time",
        *[c.alias(n) for n, c in calendar.calendar_columns("time").items()],
        calendar.is_rainy_season("time", config.OUTLOOK_RAINY_MONTHS).alias("is_rainy_outlook"),
        calendar.night_factor("time").alias("hour_risk_factor"),
    )


@query(oracle("o_orderkey hari", """
select o_orderkey, (['Senin','Selasa','Rabu','Kamis','Jumat','Sabtu','Minggu'])[isodow(o_orderdate)] || ', ' || strftime(o_orderdate, '%d') || ' ' ||
 (['Jan','Feb','Mar','Apr','Mei','Jun','Jul','Agust','Sep','Okt','Nov','Des'])[month(o_orderdate)] as hari from orders"""))
def format_id_date(spark, d):
    return rel.table(spark, d, "orders").select("o_orderkey", text.format_id_date("o_orderdate").alias("hari"))


@query(oracle("event_id ts:t local:t", "select event_id, ts, ts + interval 8 hour as local from events"))
def local_time(spark, d):
    return rel.table(spark, d, "events").select("event_id", "ts", calendar.local_time("ts").alias("local"))


@query(oracle(HOURLY_COLUMNS, f"""select * from obs_hourly where "time" >= date_trunc('day', {AS_OF}) and "time" < date_trunc('day', {AS_OF}) + interval 1 day""", "obs_hourly"))
def day_slice(spark, d):
    start = F.date_trunc("day", as_of_time(spark, d)).cast("timestamp_ntz")
    h = rel.obs_hourly(spark, d).drop("est")
    return h.where((F.col("time") >= start) & (F.col("time") < start + F.expr("interval 1 day")))


@query(oracle(HOURLY_COLUMNS, f"""select * from obs_hourly where "time" >= {AS_OF} qualify row_number() over (partition by loc order by "time") <= 48""", "obs_hourly"))
def next_48h(spark, d):
    now = as_of_time(spark, d)
    h = rel.obs_hourly(spark, d).drop("est")
    # dense hours: the first 48 rows from now are the next 48 hours
    return h.where((F.col("time") >= now) & (F.col("time") < now + F.expr("interval 48 hours")))


@query(oracle("loc time:t precipitation:d wind_speed:d", f"""select * from obs_sparse where "time" >= {AS_OF} - interval 72 hour""", "obs_sparse"))
def recent_weather(spark, d):
    o = rel.obs_sparse(spark, d).select("loc", "time", "precipitation", "wind_speed")
    return rollups.recent_weather(o, 72, as_of_time(spark, d), "time")


@query(oracle("loc time:t precipitation:d est:d", f"""
select loc, "time", precipitation, est from (select *, row_number() over (partition by loc order by abs(epoch_us("time") - epoch_us({AS_OF} + interval 20 minute)), "time") as rn from
 (select o.loc, o."time", o.precipitation, h.est from obs_sparse o join obs_hourly h on h.loc=o.loc and h."time"=o."time")) where rn = 1""", "obs_hourly"))
def nearest_row(spark, d):
    o = rel.obs_sparse(spark, d).select("loc", "time", "precipitation").join(rel.tide_hourly(spark, d), ["loc", "time"])
    return timegrid.nearest_row(o, as_of_time(spark, d) + F.expr("interval 20 minutes"))


@query(oracle("loc ts:t value:d", f"""
select loc, ts, value from gauge_events where event_type='view' and ts <= {AS_OF} and ts >= {AS_OF} - interval 24 hour
qualify row_number() over (partition by loc order by ts desc) = 1""", "gauge_events"))
def latest_within(spark, d):
    e = rel.gauge_events(spark, d).where(F.col("event_type") == "view").select("loc", "ts", "value")
    return timegrid.latest_before(e, as_of_time(spark, d), "24 hours", time="ts")


@query(oracle("id timestamp:t latitude:d longitude:d rain_24h:d tide_level:d probability:d risk_level", """
select p.id, "timestamp", b.lat as latitude, b.lon as longitude, rain_24h, tide_level, probability, risk_level from pred_log p join buildings b on b.id = p.loc""", "pred_log buildings"))
def prediction_log_rows(spark, d):
    from hydrolake.sources import logs

    p = rel.pred_log(spark, d)
    sites = rel.buildings(spark, d).select(F.col("id").alias("loc"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    rows = logs.prediction_rows(p.join(sites, "loc"), key="id", at="timestamp")
    return rows.select("id", "timestamp", "latitude", "longitude", "rain_24h", "tide_level", "probability", "risk_level")


@query(oracle("timestamp:t temperature:d humidity:d precipitation:d rain:d pressure:d wind_speed:d source", """
select "time" as "timestamp", 20 + soil_moisture_surface*10 as temperature, soil_moisture_root*100 as humidity, precipitation, precipitation as rain, 1000 + loc as pressure, wind_speed, 'open-meteo' as source from obs_sparse""", "obs_sparse"))
def weather_log_rename(spark, d):
    from hydrolake.sources import logs

    raw = rel.obs_sparse(spark, d).select(
        F.col("time").alias("timestamp"),
        (F.col("soil_moisture_surface") * 10 + 20).alias("temperature_2m"),
        (F.col("soil_moisture_root") * 100).alias("relative_humidity_2m"),
        "precipitation", F.col("precipitation").alias("rain"),
        (F.col("loc") + 1000).cast("double").alias("surface_pressure"),
        F.col("wind_speed").alias("wind_speed_10m"),
    )
    return logs.weather_rows(raw).drop("id")


@query(oracle("name n_rows", "select 'predictions' as name, count(*) as n_rows from pred_log union all select 'weather_records', count(*) from obs_sparse", "pred_log obs_sparse"))
def log_stats(spark, d):
    return rollups.log_stats(rel.pred_log(spark, d), rel.obs_sparse(spark, d))


@query(oracle("id timestamp:t loc depth_cm:d probability:d risk_level", 'select * from pred_log order by "timestamp" desc, id desc limit 100', "pred_log"))
def recent_predictions(spark, d):
    log = rel.pred_log(spark, d).select("id", "timestamp", "loc", "depth_cm", "probability", "risk_level")
    return rollups.recent_predictions(log, 100)


@query(oracle("loc tanggal:t status_siaga label:i is_flood:i", """
select loc, tanggal, status_siaga, case status_siaga when 'Aman' then 0 when 'Air Meluap' then 1 when 'Banjir' then 2 end as label,
 case when status_siaga in ('Air Meluap','Banjir') then 1 when status_siaga = 'Aman' then 0 end as is_flood from status_reports""", "status_reports"))
def class_labels(spark, d):
    return datasets.class_labels(rel.status_reports(spark, d)).select("loc", "tanggal", "status_siaga", "label", "is_flood")


@query(oracle("loc tanggal:t status_siaga encoded:i", "select loc, tanggal, status_siaga, dense_rank() over (order by status_siaga) - 1 as encoded from obs_daily", "obs_daily"))
def label_encode(spark, d):
    return ranking.label_encode(rel.obs_daily(spark, d).select("loc", "tanggal", "status_siaga"), "status_siaga")


@query(oracle("loc tanggal:t report_id status_siaga", """
select loc, tanggal, report_id, status_siaga from status_reports qualify row_number() over (partition by loc, tanggal order by report_id, line) = 1""", "status_reports"))
def dedupe_daily(spark, d):
    r = ranking.dedupe(rel.status_reports(spark, d), ["loc", "tanggal"], ["report_id", "line"])
    return r.select("loc", "tanggal", "report_id", "status_siaga")


@query(oracle("loc tanggal:t status_siaga rain_sum_imputed:d pasut_msl_max:d is_banjir:i", """
select o.loc, o.tanggal, r.status_siaga, o.rain_sum_imputed, o.pasut_msl_max, case when r.status_siaga = 'Banjir' then 1 else 0 end as is_banjir
from obs_daily o left join (select * from status_reports qualify row_number() over (partition by loc, tanggal order by report_id, line) = 1) r on r.loc=o.loc and r.tanggal=o.tanggal""", "obs_daily status_reports"))
def label_left_join(spark, d):
    first = ranking.dedupe(rel.status_reports(spark, d), ["loc", "tanggal"], ["report_id", "line"]).select("loc", "tanggal", "status_siaga")
    flagged = first.withColumn("is_banjir", numeric.flag(F.col("status_siaga") == "Banjir"))
    daily = rel.obs_daily(spark, d).drop("status_siaga")
    with_label = datasets.label_left_join(daily, first)
    return datasets.join_reports(with_label, flagged).select("loc", "tanggal", "status_siaga", "rain_sum_imputed", "pasut_msl_max", "is_banjir")


@query(oracle("status_siaga n first_date:t last_date:t ratio:d", "select status_siaga, count(*) as n, min(tanggal) as first_date, max(tanggal) as last_date, count(*)::double / (select count(*) from obs_daily) as ratio from obs_daily group by 1", "obs_daily"))
def class_distribution(spark, d):
    return ranking.class_distribution(rel.obs_daily(spark, d), "status_siaga", "tanggal")


@query(oracle("status_siaga n weight:d", "select status_siaga, count(*) as n, (select count(*) from obs_daily)::double / ((select count(distinct status_siaga) from obs_daily) * count(*)) as weight from obs_daily group by 1", "obs_daily"))
def class_weights(spark, d):
    return ranking.class_weights(rel.obs_daily(spark, d), "status_siaga")


@query(oracle("loc tanggal:t tide_rain_interaction:d soil_saturation_index:d is_high_tide:i is_heavy_rain:i", """
select loc, tanggal, pasut_msl_max*rain_sum_imputed as tide_rain_interaction, (soil_moisture_surface_mean+soil_moisture_root_mean)/2 as soil_saturation_index,
 case when pasut_msl_max > 2.5 then 1 else 0 end as is_high_tide, case when rain_sum_imputed > 50 then 1 else 0 end as is_heavy_rain from obs_daily""", "obs_daily"))
def interaction_features(spark, d):
    return rel.obs_daily(spark, d).select("loc", "tanggal", *[c.alias(n) for n, c in datasets.interaction_columns().items()])


WD = "partition by loc order by tanggal rows between 6 preceding and current row"


@query(oracle("loc tanggal:t rain_cumsum_7d:d drain_series:d drain_single:d", f"""
select loc, tanggal, s as rain_cumsum_7d, least(greatest(s/200.0::double, 0), 2) as drain_series, s/200.0::double as drain_single from (select loc, tanggal, sum(rain_sum_imputed) over ({WD}) as s from obs_daily)""", "obs_daily"))
def drain_capacity(spark, d):
    from hydrolake.catalog.series_queries import daily
    from hydrolake.operators import rolling

    s = rolling.daily_cumsum(daily(spark, d), ns=(7,))
    single = F.col("rain_cumsum_7d") / F.lit(config.DRAIN_CAPACITY_MM)
    return s.select("loc", "tanggal", "rain_cumsum_7d", numeric.clip(single, 0, 2).alias("drain_series"), single.alias("drain_single"))


SPARSE_INPUT = """select loc, tanggal, case when loc % 7 = 0 then null else rain_sum_imputed end as rain_rolling_24h, rain_intensity_max, pasut_msl_max,
 case when loc % 3 = 0 then null else soil_moisture_surface_mean end as soil_moisture_surface_mean, rain_sum_imputed/2 as hujan_lag1, rain_sum_imputed/4 as rain_lag2 from obs_daily"""
FILLED = """select loc, tanggal, coalesce(rain_rolling_24h, 0) as r, coalesce(rain_intensity_max, 0) as i, coalesce(pasut_msl_max, 0) as t, coalesce(soil_moisture_surface_mean, 0.45::double) as ss, 0.45::double as sr,
 coalesce(hujan_lag1, 0) as l1, coalesce(rain_lag2, 0) as l2 from sparse"""


def sparse_input(spark, d):
    """Daily rows as a caller might send them: aliases, absent columns, NULLs."""
    o = rel.obs_daily(spark, d)
    return o.select(
        "loc", "tanggal",
        F.when(F.col("loc") % 7 != 0, F.col("rain_sum_imputed")).alias("rain_rolling_24h"),
        "rain_intensity_max", "pasut_msl_max",
        F.when(F.col("loc") % 3 != 0, F.col("soil_moisture_surface_mean")).alias("soil_moisture_surface_mean"),
        (F.col("rain_sum_imputed") / 2).alias("hujan_lag1"),
        (F.col("rain_sum_imputed") / 4).alias("rain_lag2"),
    )


VECTOR = """select loc, tanggal, r as rain_sum_imputed, i as rain_intensity_max, ss as soil_moisture_surface_mean, sr as soil_moisture_root_mean, t as pasut_msl_max,
 l1 as rain_lag1, l2 as rain_lag2, 0 as rain_lag3, 0 as rain_lag4, 0 as rain_lag5, 0 as rain_lag6, 0 as rain_lag7, (ss+sr)/2 as soil_saturation_index, r+l1+l2 as rain_cumsum_3d, r+l1+l2 as rain_cumsum_7d,
 t*r as tide_rain_interaction, case when t > 2.5 then 1 else 0 end as is_high_tide, case when r > 50 then 1 else 0 end as is_heavy_rain, r + 0.85::double*l1 + power(0.85::double,2)*l2 as api_7day,
 0 as month_sin, 1 as month_cos, 1 as is_rainy_season, 0 as is_weekend, 0 as prev_flood_30d, 0 as prev_meluap_30d, i*3 as rain_intensity_3h, 0 as rain_burst_count, 0 as soil_saturation_trend,
 case when t > 2.5 and r > 50 then 1 else 0 end as tide_rain_sync, 0 as consecutive_rain_days, 1.0 as hour_risk_factor, (r+l1+l2)/200.0::double as drain_capacity_index, 0 as upstream_rain_6h, 0 as wind_speed_max,
 0 as rainfall_acceleration, 2.0 as elevation_m, 50.0 as drainage_capacity from filled"""
ALL_D = " ".join(f"{c}:d" for c in config.FEATURES_V7)


@query(oracle("loc tanggal:t " + ALL_D, VECTOR, "obs_daily", {"sparse": SPARSE_INPUT, "filled": FILLED}))
def daily_feature_vector(spark, d):
    return features.daily_features(sparse_input(spark, d), keep=["loc", "tanggal"], per_row=True)


@query(oracle("loc tanggal:t rain:d soil_surface:d soil_root:d rain_lag1:d rain_lag3:d elevation_m:d", """
select loc, tanggal, rain_rolling_24h as rain, soil_moisture_surface_mean as soil_surface, 0.45 as soil_root, hujan_lag1 as rain_lag1, 0 as rain_lag3, 2.0 as elevation_m from sparse""", "obs_daily", {"sparse": SPARSE_INPUT}))
def feature_defaults(spark, d):
    """Defaults by absent column: a present NULL stays NULL."""
    df = sparse_input(spark, d)
    return df.select(
        "loc", "tanggal",
        features.chain(df, "rain_sum_imputed", "rain_rolling_24h").alias("rain"),
        features.chain(df, "soil_moisture_surface_mean", default=0.45).alias("soil_surface"),
        features.chain(df, "soil_moisture_root_mean", default=0.45).alias("soil_root"),
        features.chain(df, "rain_lag1", "hujan_lag1").alias("rain_lag1"),
        features.chain(df, "rain_lag3", "hujan_lag3").alias("rain_lag3"),
        features.chain(df, "elevation_m", default=2.0).alias("elevation_m"),
    )


@query(oracle("loc tanggal:t rain_intensity_max:d soil_moisture_surface_mean:d pasut_msl_max:d n_missing:i", f"""
select loc, tanggal, coalesce(rain_intensity_max, 0) as rain_intensity_max, coalesce(soil_moisture_surface_mean, 0) as soil_moisture_surface_mean, coalesce(pasut_msl_max, 0) as pasut_msl_max, {len(config.FEATURES_V7) - 4} as n_missing, from sparse""", "obs_daily", {"sparse": SPARSE_INPUT}))
def select_model_features(spark, d):
    out, missing = features.select_model_features(sparse_input(spark, d), config.FEATURES_V7, keep=["loc", "tanggal"])
    return out.drop("rain_lag2").withColumn("n_missing", F.lit(len(missing)))


@query(oracle("id legacy_label level color", """
select id, case when probability > 0.65 then 'BAHAYA BANJIR' else 'AMAN' end as legacy_label, case when probability > 0.65 then 'WASPADA' else 'NORMAL' end as level,
 case when probability > 0.65 then 'yellow' else 'green' end as color from pred_log""", "pred_log"))
def legacy_status_map(spark, d):
    p = rel.pred_log(spark, d).select("id", F.when(F.col("probability") > config.FLOOD_PROBABILITY, "BAHAYA BANJIR").otherwise("AMAN").alias("legacy_label"))
    return p.select("id", "legacy_label", risk.legacy_level("legacy_label").alias("level"), risk.legacy_color("legacy_label").alias("color"))


TODAY = f"cast({AS_OF} as date)"
OUTLOOK = f"""select f.*, case when depth_cm < 20 then 'AMAN' when depth_cm < 50 then 'WASPADA' when depth_cm < 100 then 'SIAGA' else 'AWAS' end as label,
 case when depth_cm < 20 then 'green' when depth_cm < 50 then 'yellow' when depth_cm < 100 then 'orange' else 'red' end as color from (
select d.loc, d.tanggal, (['Senin','Selasa','Rabu','Kamis','Jumat','Sabtu','Minggu'])[isodow(d.tanggal)] || ', ' || strftime(d.tanggal, '%d') || ' ' ||
 (['Jan','Feb','Mar','Apr','Mei','Jun','Jul','Agust','Sep','Okt','Nov','Des'])[month(d.tanggal)] as hari,
 d.rain as rain_sum_imputed, d.tide as pasut_msl_max, d.rain + {" + ".join(f"coalesce(d{k}.rain,0)" for k in range(1, 7))} as rain_cumsum_7d,
 d.rain + {" + ".join(f"power(0.85::double,{k})*coalesce(d{k}.rain,0)" for k in range(1, 8))} as api_7day, case when d.rain > 10 then d.rain/4 else 0 end as rain_intensity_3h,
 case when isodow(d.tanggal) >= 6 then 1 else 0 end as is_weekend, case when month(d.tanggal) in (11,12,1,2,3,4) then 1 else 0 end as is_rainy_season,
 least(300, 2*d.peak + 20*greatest(d.tide-2.5::double, 0)) as depth_cm
from days d {" ".join(f"left join days d{k} on d{k}.loc=d.loc and d{k}.tanggal = d.tanggal - {k}" for k in range(1, 8))}
where d.tanggal >= {TODAY} qualify dense_rank() over (partition by d.loc order by d.tanggal) <= 7) f"""
DAYS = """select loc, cast("time" as date) as tanggal, sum(precipitation) as rain, max(precipitation) as peak, max(est) as tide from obs_hourly group by 1, 2"""


@query(oracle("loc tanggal:t hari rain_sum_imputed:d pasut_msl_max:d rain_cumsum_7d:d api_7day:d rain_intensity_3h:d is_weekend:d is_rainy_season:d depth_cm:d label color kartu",
              f"select *, label || ' ' || printf('%.0f', depth_cm) || ' cm' as kartu from ({OUTLOOK})", "obs_hourly", {"days": DAYS}))
def forecast_7day(spark, d):
    today = F.to_date(as_of_time(spark, d))
    return outlook.forecast_outlook(rel.obs_hourly(spark, d), today)


@query(oracle("loc all_dry", "select loc, sum(precipitation) = 0 as all_dry from obs_hourly group by 1", "obs_hourly"))
def dry_series(spark, d):
    return outlook.any_rain(rel.obs_hourly(spark, d))


@query(oracle("risk_level actual_outcome n:i agree:i", """
select risk_level, outcome as actual_outcome, count(*) as n, sum(case when (outcome in ('Banjir','Air Meluap')) = (risk_level <> 'AMAN') then 1 else 0 end) as agree from (
 select p.id, p.risk_level, o.actual_outcome as outcome, o."timestamp" - p."timestamp" as gap from pred_log p
  asof join (select loc, "timestamp", min_by(actual_outcome, id) as actual_outcome from pred_log where actual_outcome is not null group by all) o on p.loc = o.loc and p."timestamp" <= o."timestamp")
where gap <= interval 24 hour group by 1, 2""", "pred_log"))
def feedback_agreement(spark, d):
    p = rel.pred_log(spark, d)
    made = p.select("loc", F.col("timestamp").alias("time"), "risk_level")
    seen = p.where(F.col("actual_outcome").isNotNull()).select("loc", F.col("timestamp").alias("time"), "id", "actual_outcome")
    return alerts.feedback_agreement(made, seen)


@query(oracle("n:i p10:d median:d p90:d", """
select count(*) as n, quantile_cont(l_extendedprice::double, 0.1) as p10, quantile_cont(l_extendedprice::double, 0.5) as median, quantile_cont(l_extendedprice::double, 0.9) as p90 from lineitem"""))
def price_percentiles(spark, d):
    """One group of all rows, large enough for the sketch to bracket the ranks."""
    p = stats.exact_percentiles(rel.table(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.9], [])
    return p.select("n", *[F.col("q")[k].alias(c) for k, c in enumerate(("p10", "median", "p90"))])
