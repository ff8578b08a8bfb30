"""Bands, reasons, alerts, scenarios, sources and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.catalog.registry import oracle, query
from hydrolake.catalog.rollup_queries import AS_OF, sparse_input, SPARSE_INPUT
from hydrolake.catalog.series_queries import STATUS_ORACLE, as_of_time
from hydrolake.functions import risk, sqlfuncs
from hydrolake.operators import alerts, metrics, ranking, timegrid
from hydrolake.plans import datasets, features, outlook, scoring
from hydrolake.sources import files, logs, relations as rel


def band(names: list[str], col: str = "depth_cm") -> str:
    return f"case when {col} < 20 then '{names[0]}' when {col} < 50 then '{names[1]}' when {col} < 100 then '{names[2]}' else '{names[3]}' end"


PARTS = [[b[i] for b in config.RISK_BANDS] for i in range(4)]


@query(oracle("id depth_cm:d level label color recommendation", f"""
select id, depth_cm, {band(PARTS[0])} as level, {band(PARTS[1])} as label, {band(PARTS[2])} as color, {band(PARTS[3])} as recommendation from pred_log""", "pred_log"))
def risk_levels(spark, d):
    p = rel.pred_log(spark, d)
    return p.select("id", "depth_cm", risk.risk_level("depth_cm").alias("level"), risk.risk_label("depth_cm").alias("label"),
                    risk.risk_color("depth_cm").alias("color"), risk.recommendation("depth_cm").alias("recommendation"))


@query(oracle("id level label", f"select id, {band(PARTS[0])} as level, {band(PARTS[1])} as label from pred_log", "pred_log"))
def risk_levels_sql(spark, d):
    """The same bands through the registered SQL functions."""
    sqlfuncs.register(spark)
    return rel.pred_log(spark, d).select("id", F.expr("risk_level(depth_cm)").alias("level"), F.expr("risk_label(depth_cm)").alias("label"))


REASONS = """select id, rain, tide, elev,
 case when rain > 150 then 'Hujan Ekstrem' when rain > 50 then 'Hujan Deras' else '' end as wet,
 concat_ws(', ', case when rain > 150 then 'Hujan Ekstrem (' || printf('%.1f', rain) || 'mm)' when rain > 50 then 'Hujan Deras (' || printf('%.1f', rain) || 'mm)' end,
  case when tide - 2.8::double > 0 then 'Pasang Laut Tinggi (' || printf('%.1f', tide) || 'm)' end, case when elev < 5 then 'Topografi Rendah (' || elev::varchar || 'm)' end) as txt, depth_cm
 from (select id, rain_24h as rain, tide_level as tide, (id % 16)/2.0::double as elev, depth_cm from pred_log)"""


@query(oracle("id main_factor reasoning", """
select id, case when wet <> '' and tide - 2.8::double > 0 then wet || ' & Rob' when wet <> '' then wet when tide - 2.8::double > 0 then 'Pasang Rob' else 'Tidak Ada' end as main_factor,
 case when txt <> '' then txt when depth_cm > 10 then 'Akumulasi Air Permukaan' else 'Kondisi Kondusif' end as reasoning from rs""", "pred_log", {"rs": REASONS}))
def risk_reasons(spark, d):
    p = rel.pred_log(spark, d).withColumn("elev", (F.col("id") % 16) / 2.0)
    return p.select("id", risk.main_factor("rain_24h", "tide_level").alias("main_factor"),
                    risk.reasons("depth_cm", "rain_24h", "tide_level", "elev").alias("reasoning"))


@query(oracle("id probability:d level color action", """
select id, probability, case when probability >= 0.85 then 'AWAS' when probability >= 0.7 then 'SIAGA' when probability >= 0.5 then 'WASPADA' else 'AMAN' end as level,
 case when probability >= 0.85 then 'red' when probability >= 0.7 then 'orange' when probability >= 0.5 then 'yellow' else 'green' end as color,
 case when probability >= 0.85 then '🚨 Evakuasi' when probability >= 0.7 then '⚠️ Siaga' else '✅ Pantau' end as action from pred_log""", "pred_log"))
def probability_bands(spark, d):
    p = rel.pred_log(spark, d)
    return p.select("id", "probability", risk.probability_band("probability").alias("level"), risk.probability_color("probability").alias("color"),
                    risk.probability_action("probability").alias("action"))


@query(oracle("id status_text recommendation", f"""
select id, case {band(PARTS[0])} when 'WASPADA' then 'SIAGA III (WASPADA)' when 'SIAGA' then 'SIAGA II (DARURAT)' when 'AWAS' then 'SIAGA I (AWAS)' else {band(PARTS[1])} end as status_text,
 upper({band(PARTS[3])}) as recommendation from pred_log""", "pred_log"))
def command_status(spark, d):
    p = rel.pred_log(spark, d).withColumns(risk.assessment_columns("depth_cm"))
    return p.select("id", risk.command_status("level", "label").alias("status_text"), F.upper("recommendation").alias("recommendation"))


@query(oracle("id risk_level", "select id, risk_level from pred_log where risk_level in ('SIAGA', 'AWAS')", "pred_log"))
def alert_gate(spark, d):
    return alerts.alert_gate(rel.pred_log(spark, d), status="risk_level").select("id", "risk_level")


@query(oracle("loc risk_level timestamp:t depth_cm:d", """
select loc, risk_level, "timestamp", depth_cm from pred_log where risk_level in ('SIAGA','AWAS') qualify row_number() over (partition by loc, risk_level order by "timestamp") = 1""", "pred_log"))
def alert_dedupe(spark, d):
    p = alerts.alert_gate(rel.pred_log(spark, d).select("loc", "risk_level", "timestamp", "depth_cm"), status="risk_level")
    return alerts.first_alerts(p, ("loc", "risk_level"), "timestamp")


RULE = "━" * 20
MESSAGE = f"""case risk_level when 'AMAN' then '✅' when 'WASPADA' then '⚠️' when 'SIAGA' then '🟠' when 'AWAS' then '🔴' else 'ℹ️' end || ' *PERINGATAN BANJIR - ' || risk_level || '*' || chr(10) || '{RULE}' || chr(10) || chr(10)
 || '📍 *Lokasi:* ' || site || chr(10) || '🌊 *Kedalaman:* ' || printf('%.0f', depth_cm) || ' cm' || chr(10) || '⏰ *Waktu:* ' || strftime("timestamp", '%d/%m/%Y %H:%M') || ' WITA' || chr(10) || chr(10)
 || '📋 *Penyebab:*' || chr(10) || case when actual_outcome is null then 'Data cuaca dan pasang surut' else actual_outcome end || chr(10) || chr(10)
 || '🎯 *Rekomendasi:*' || chr(10) || case when risk_level = 'SIAGA' then 'Pantau kondisi secara berkala' else {band(PARTS[3])} end || chr(10) || chr(10) || '{RULE}' || chr(10) || '_Sumber: Sistem Peringatan Dini Banjir_'"""
SITE_VALUES = "select * from (values " + ", ".join(f"({i}, '{s[0]}')" for i, s in enumerate(config.SITES)) + ") s(site_id, site)"


@query(oracle("id message", f"select id, {MESSAGE} as message from pred_log join sites on site_id = loc % 5 where risk_level in ('SIAGA','AWAS')", "pred_log", {"sites": SITE_VALUES}))
def alert_messages(spark, d):
    p = alerts.alert_gate(rel.pred_log(spark, d), status="risk_level")
    named = p.join(files.sites(spark).select("site_id", F.col("site").alias("location")), F.col("site_id") == F.col("loc") % 5)
    rows = named.select("id", "location", F.col("risk_level").alias("status"), "depth_cm", F.coalesce("actual_outcome", F.lit("")).alias("reasoning"),
                        F.when(F.col("risk_level") != "SIAGA", risk.recommendation("depth_cm")).alias("recommendation"), "timestamp")
    return alerts.alert_messages(rows, "timestamp").select("id", "message")


@query(oracle("site lat:d lon:d runoff:d n:i mean_depth:d", "select site, lat, lon, runoff, count(*) as n, avg(depth_cm) as mean_depth from pred_log join sites on site_id = loc % 5 group by all", "pred_log",
              {"sites": "select * from (values " + ", ".join(f"({i}, '{s[0]}', {s[1]}, {s[2]}, {s[3]})" for i, s in enumerate(config.SITES)) + ") s(site_id, site, lat, lon, runoff)"}))
def sites_dim(spark, d):
    """Logged predictions per monitoring site; the log is aggregated before it meets the dimension."""
    per = rel.pred_log(spark, d).groupBy((F.col("loc") % 5).alias("site_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("depth_cm").alias("mean_depth"))
    return files.sites(spark).join(per, "site_id").select("site", "lat", "lon", "runoff", "n", "mean_depth")


FRONTS = """select p.id, case when rain_24h > 100 or u.s > 50 then 'KRITIS' when rain_24h > 50 or u.s > 20 then 'GANGGUAN' else 'AMAN' end as meteo_status,
 case when tide_level > 2.5 then 'OVERFLOW' when tide_level > 2.0 then 'PASANG TINGGI' else 'SURUT/AMAN' end as tide_status,
 case when h.soil_moisture_surface > 0.6 then 'JENUH' else 'KERING' end as land_status, case when h.soil_moisture_surface > 0.5 then 'Jenuh Air' else 'Normal' end as soil_status
from pred_log p join obs_hourly h on h.loc = p.loc and h."time" = date_trunc('hour', p."timestamp")
join (select loc, "time", sum(upstream_precipitation) over (partition by loc order by "time" rows between 5 preceding and current row) as s from obs_hourly) u on u.loc=p.loc and u."time"=h."time" """


@query(oracle("id meteo_status tide_status land_status soil_status", FRONTS, "pred_log obs_hourly"))
def operational_fronts(spark, d):
    from hydrolake.operators import rolling, series

    h = rolling.rolling(series.hour_index(rel.obs_hourly(spark, d)), "upstream_precipitation", 6, F.sum, "upstream_recent")
    h = h.select("loc", "time", "upstream_recent", F.col("soil_moisture_surface").alias("soil_moisture"))
    p = rel.pred_log(spark, d).withColumn("time", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return outlook.status_cards(p.join(h, ["loc", "time"]).withColumn("tide_max", F.col("tide_level"))).select(
        "id", "meteo_status", "tide_status", "land_status", "soil_status")


@query(oracle("id spatial_boost:d upstream_boost:d runoff_boost:d total_boost:d", """
select id, s as spatial_boost, u as upstream_boost, r as runoff_boost, s + u + r as total_boost from (
select id, case when id % 60000 > 5000 and rain_24h > 20 then least(0.15, (id % 60000)/50000.0::double*0.10::double) else 0 end as s, case when depth_cm > 20 then 0.10::double else 0 end as u,
 case when ru > 0.8 then 0.05::double when ru < 0.6 then -0.05::double else 0 end as r from (select id, rain_24h, depth_cm, (id % 10)/10.0::double as ru from pred_log))""", "pred_log"))
def heuristic_boost(spark, d):
    p = rel.pred_log(spark, d).withColumns({"acc": (F.col("id") % 60000).cast("double"), "runoff": (F.col("id") % 10) / 10.0})
    return p.select("id", *[c.alias(n) for n, c in risk.heuristic_boost("acc", "rain_24h", "depth_cm", "runoff").items()])


SCENARIOS = [
    {"scenario": "base"},
    {"scenario": "dry", "rain_sum_imputed": 0.0, "rain_intensity_max": 0.0},
    {"scenario": "storm", "rain_sum_imputed": 150.0, "rain_intensity_max": 50.0, "soil_moisture_surface_mean": 0.6},
    {"scenario": "surge", "pasut_msl_max": 3.8},
    {"scenario": "storm_surge", "rain_sum_imputed": 150.0, "rain_intensity_max": 50.0, "pasut_msl_max": 3.8},
]
SCN = "select * from (values ('base', null::double, null::double, null::double, null::double), ('dry', 0, 0, null, null), ('storm', 150, 50, 0.6, null), ('surge', null, null, null, 3.8), ('storm_surge', 150, 50, null, 3.8)) s(scenario, r, i, s, t)"


@query(oracle("scenario loc tanggal:t rain_sum_imputed:d soil_saturation_index:d depth_cm:d label", f"""
select *, {band(PARTS[1])} as label from (select scenario, loc, tanggal, coalesce(r, rain_sum_imputed) as rain_sum_imputed, (coalesce(s, soil_moisture_surface_mean)+soil_moisture_root_mean)/2 as soil_saturation_index,
 least(300, 2*coalesce(i, rain_intensity_max) + 20*greatest(coalesce(t, pasut_msl_max) - 2.5::double, 0)) as depth_cm from obs_daily cross join scn)""", "obs_daily", {"scn": SCN}))
def what_if_grid(spark, d):
    return outlook.what_if_scores(rel.obs_daily(spark, d).drop("status_siaga"), SCENARIOS, ["loc", "tanggal"]).select(
        "scenario", "loc", "tanggal", "rain_sum_imputed", "soil_saturation_index", "depth_cm", "label")


@query(oracle("loc tanggal:t variant pasut_msl_max:d rain_cumsum_7d:d rain_cumsum_3d:d depth_cm:d", f"""
select *, least(300, 2*peak + 20*greatest(pasut_msl_max - 2.5::double, 0)) as depth_cm from (select d.loc, d.tanggal, variant, d.peak, case when variant='datum_offset' then greatest(0, d.tide - 2.8::double) else d.tide end as pasut_msl_max,
 case when variant='low_history' then 10 else d.rain + {" + ".join(f"coalesce(d{k}.rain,0)" for k in range(1, 7))} end as rain_cumsum_7d, case when variant='low_history' then 5 else d.rain + coalesce(d1.rain,0) + coalesce(d2.rain,0) end as rain_cumsum_3d
from days d {" ".join(f"left join days d{k} on d{k}.loc=d.loc and d{k}.tanggal = d.tanggal - {k}" for k in range(1, 7))} cross join (select unnest(['base','datum_offset','low_history']) as variant)
where d.tanggal >= cast({AS_OF} as date) and d.tanggal < cast({AS_OF} as date) + 7)""", "obs_hourly", {"days": 'select loc, cast("time" as date) as tanggal, sum(precipitation) as rain, max(precipitation) as peak, max(est) as tide from obs_hourly group by 1, 2'}))
def outlook_variants(spark, d):
    today = F.to_date(as_of_time(spark, d))
    v = outlook.variants(outlook.outlook_inputs(outlook.forecast_days(rel.obs_hourly(spark, d), today)))
    return scoring.score_rows(v, keep=["loc", "tanggal", "variant"]).select("loc", "tanggal", "variant", "pasut_msl_max", "rain_cumsum_7d", "rain_cumsum_3d", "depth_cm")


@query(oracle("loc tanggal:t depth_cm:d level label color main_factor reasoning recommendation", f"""
select loc, tanggal, depth_cm, {band(PARTS[0])} as level, {band(PARTS[1])} as label, {band(PARTS[2])} as color, {band(PARTS[3])} as recommendation,
 case when wet <> '' and tide - 2.8::double > 0 then wet || ' & Rob' when wet <> '' then wet when tide - 2.8::double > 0 then 'Pasang Rob' else 'Tidak Ada' end as main_factor,
 concat_ws(', ', case when wet <> '' then wet || ' (' || printf('%.1f', rain) || 'mm)' end, case when tide - 2.8::double > 0 then 'Pasang Laut Tinggi (' || printf('%.1f', tide) || 'm)' end, 'Topografi Rendah (2.0m)') as reasoning
from (select loc, tanggal, least(300, 2*rain_intensity_max + 20*greatest(pasut_msl_max - 2.5::double, 0)) as depth_cm, rain_sum_imputed as rain, pasut_msl_max as tide,
 case when rain_sum_imputed > 150 then 'Hujan Ekstrem' when rain_sum_imputed > 50 then 'Hujan Deras' else '' end as wet from obs_daily)""", "obs_daily"))
def daily_assessment(spark, d):
    scored = scoring.score_rows(rel.obs_daily(spark, d).drop("status_siaga"), keep=["loc", "tanggal"])
    return scored.select("loc", "tanggal", "depth_cm", "level", "label", "color", "main_factor", "reasoning", "recommendation")


SAR = """select loc, ts, -10 - value/10 as vh, event_id from (select user_id // 5 as loc, * from events where event_type = 'click' and event_id % 3 <> 0)"""
HYBRID = f"""select s.loc, s.status, case when vh < -18 then 'SATELIT' when alpha > 0 then 'RADAR' end as source, case when vh < -18 then 'TERKONFIRMASI SATELIT' when alpha > 0 then 'TERKONFIRMASI RADAR' end as label,
 case when vh < -18 then 'Sentinel-1 (Real-time) (' || printf('%.1f', (epoch_us({AS_OF}) - epoch_us(sar_at))/3600000000.0::double) || ' jam lalu)' when alpha > 0 then 'Hujan Terdeteksi (' || strftime(radar_at, '%H:%M') || ')' end as detail,
 case when vh < -18 then '#2ecc71' when alpha > 0 then '#3498db' end as color_hex
from (select loc, status from ({STATUS_ORACLE}) where "time" = {AS_OF} and status <> 'AMAN') s
left join (select loc, vh, ts as sar_at from sar where ts <= {AS_OF} and ts >= {AS_OF} - interval 30 day qualify row_number() over (partition by loc order by ts desc) = 1) a on a.loc=s.loc
left join (select loc, floor(value) as alpha, ts as radar_at from gauge_events where event_type <> 'click' and ts <= {AS_OF} and ts > {AS_OF} - interval 10 hour qualify row_number() over (partition by loc order by ts desc) = 1) r on r.loc=s.loc"""


@query(oracle("loc status source label detail color_hex", HYBRID, "obs_hourly", {"sar": SAR}))
def hybrid_validation(spark, d):
    now = as_of_time(spark, d)
    status = scoring.score_series(rel.obs_hourly(spark, d)).where(F.col("time") == now).select("loc", "status")
    e = rel.table(spark, d, "events").withColumn("loc", F.expr("user_id div 5"))
    sar = e.where(F.col("event_type") == "click").select(
        "loc", F.col("ts").alias("time"), (F.lit(-10) - F.col("value") / 10).alias("vh"),
        F.when(F.col("event_id") % 3 == 0, "EW").otherwise("IW").alias("mode"), F.array(F.lit("VV"), F.lit("VH")).alias("polarisation"))
    radar = e.where(F.col("event_type") != "click").select("loc", F.col("ts").alias("time"), F.floor("value").alias("alpha"))
    # readings are sparse here, so radar images stay valid for ten hours
    return alerts.hybrid_validation(status, sar, radar, now, radar_limit="10 hours")


# --- targets and reports ---------------------------------------------------------------------


@query(oracle("loc tanggal:t base_depth:d label_depth:d", """
select loc, tanggal, x as base_depth, x + case status_siaga when 'Banjir' then 50 when 'Air Meluap' then 10 else 0 end as label_depth
from (select *, 2*rain_intensity_max + 20*greatest(pasut_msl_max - 2.5::double, 0) as x from obs_daily)""", "obs_daily"))
def depth_target(spark, d):
    """Noise-free targets, without and with the class base. Noise is covered by a test."""
    labelled = datasets.class_labels(rel.obs_daily(spark, d))
    plain = datasets.depth_target(labelled, noise=False, by_label=False, digits=12).withColumnRenamed("water_depth_cm", "base_depth")
    return datasets.depth_target(plain, noise=False, digits=12).select("loc", "tanggal", "base_depth", F.col("water_depth_cm").alias("label_depth"))


HASH = "md5('{salt}:' || loc || ':' || tanggal::varchar)"


def unit(salt: str) -> str:
    return f"(('0x' || substr({HASH.format(salt=salt)}, 1, 8))::ubigint / 4294967296.0::double)"


@query(oracle("loc tanggal:t water_depth_cm:d", f"""
select loc, tanggal, greatest(0, x + case when x > 0 then {unit('42noise')}*10 - 5 else 0 end) as water_depth_cm from (select *, case status_siaga when 'Banjir' then floor(50 + {unit('42base')}*51) when 'Air Meluap' then floor(10 + {unit('42base')}*21) else 0 end
 + 2*rain_intensity_max + 20*greatest(pasut_msl_max - 2.5::double, 0) as x from obs_daily)""", "obs_daily"))
def depth_target_noise(spark, d):
    labelled = datasets.class_labels(rel.obs_daily(spark, d))
    return datasets.depth_target(labelled, digits=12).select("loc", "tanggal", "water_depth_cm")


CONTRIB = ["rain_sum_imputed", "rain_intensity_max", "soil_moisture_surface_mean", "pasut_msl_max", "rain_cumsum_3d", "api_7day", "rain_lag1"]
CONTRIB_SQL = """select loc, tanggal, rain_sum_imputed - 30 as rain_sum_imputed, rain_intensity_max - 8 as rain_intensity_max, soil_moisture_surface_mean - 0.5::double as soil_moisture_surface_mean,
 pasut_msl_max - 2.5::double as pasut_msl_max, rain_sum_imputed*0.5::double - 20 as rain_cumsum_3d, rain_intensity_max*0.25::double - 1 as api_7day, soil_moisture_root_mean - 0.25::double as rain_lag1 from obs_daily"""


@query(oracle("loc tanggal:t rank:i feature display contribution:d direction sign_rank:i", """
select *, case when contribution > 0 then 'Increase Risk' else 'Decrease Risk' end as direction, case feature when 'rain_sum_imputed' then 'Rain Sum Imputed' when 'rain_intensity_max' then 'Rain Intensity Max'
 when 'soil_moisture_surface_mean' then 'Soil Moisture Surface Mean' when 'pasut_msl_max' then 'Pasut Msl Max' when 'rain_cumsum_3d' then 'Rain Cumsum 3D' when 'api_7day' then 'Api 7Day' else 'Rain Lag1' end as display
from (select loc, tanggal, feature, contribution, row_number() over (partition by loc, tanggal order by abs(contribution) desc, feature) as rank,
 case when contribution <> 0 then row_number() over (partition by loc, tanggal, sign(contribution) order by abs(contribution) desc, feature) end as sign_rank
 from (unpivot c on rain_sum_imputed, rain_intensity_max, soil_moisture_surface_mean, pasut_msl_max, rain_cumsum_3d, api_7day, rain_lag1 into name feature value contribution))
where rank <= 4 or sign_rank <= 2""", "obs_daily", {"c": CONTRIB_SQL}))
def top_contributions(spark, d):
    o = rel.obs_daily(spark, d)
    c = o.select("loc", "tanggal", (F.col("rain_sum_imputed") - 30).alias("rain_sum_imputed"), (F.col("rain_intensity_max") - 8).alias("rain_intensity_max"),
                 (F.col("soil_moisture_surface_mean") - 0.5).alias("soil_moisture_surface_mean"), (F.col("pasut_msl_max") - 2.5).alias("pasut_msl_max"),
                 (F.col("rain_sum_imputed") * 0.5 - 20).alias("rain_cumsum_3d"), (F.col("rain_intensity_max") * 0.25 - 1).alias("api_7day"), (F.col("soil_moisture_root_mean") - 0.25).alias("rain_lag1"))
    return ranking.top_contributions(c, ["loc", "tanggal"], CONTRIB, k=4, signed=2)


IMPORTANCE = """select loc, feature, importance from (unpivot (select loc, abs(corr(rain_sum_imputed, f))::double as rain_sum_imputed, abs(corr(rain_intensity_max, f)) as rain_intensity_max, abs(corr(pasut_msl_max, f)) as pasut_msl_max,
 abs(corr(soil_moisture_surface_mean, f)) as soil_moisture_surface_mean from (select *, case when status_siaga = 'Aman' then 0 else 1 end as f from obs_daily) group by loc) on rain_sum_imputed, rain_intensity_max, pasut_msl_max, soil_moisture_surface_mean into name feature value importance)"""


@query(oracle("loc top_text max_importance:d", """
select loc, string_agg(feature || '=' || printf('%.3f', importance), ', ' order by rn) as top_text, max(importance) as max_importance from (select *, row_number() over (partition by loc order by importance desc, feature) as rn from imp) where rn <= 3 group by 1""",
 "obs_daily", {"imp": IMPORTANCE}))
def top_importance(spark, d):
    """Importance of a feature at a site: correlation with flooding, by size."""
    y = F.when(F.col("status_siaga") == "Aman", 0).otherwise(1)
    names = ["rain_sum_imputed", "rain_intensity_max", "pasut_msl_max", "soil_moisture_surface_mean"]
    wide = rel.obs_daily(spark, d).groupBy("loc").agg(*[F.abs(F.corr(F.col(n), y)).alias(n) for n in names])
    return ranking.top_importance(wide.unpivot(["loc"], names, "feature", "importance").na.drop(), 3, by=["loc"])


# --- sources ---------------------------------------------------------------------------------


@query(oracle("loc time:t precipitation:d soil_surface:d wind:d", """select loc, "time", precipitation, soil_moisture_surface as soil_surface, wind_speed as wind from obs_hourly""", "obs_hourly"))
def json_arrays_to_rows(spark, d):
    """One response document per site and day, written as JSON text and parsed back."""
    h = rel.obs_hourly(spark, d)
    cells = F.array_sort(F.collect_list(F.struct(F.date_format("time", "yyyy-MM-dd'T'HH:mm").alias("t"), "precipitation", "soil_moisture_surface", "wind_speed")))
    per_day = h.groupBy("loc", F.to_date("time").alias("day")).agg(cells.alias("c"))  # at most 24 hours each
    hourly = F.struct(
        F.transform("c", lambda s: s["t"]).alias("time"), F.transform("c", lambda s: s["precipitation"]).alias("precipitation"),
        F.transform("c", lambda s: s["soil_moisture_surface"]).alias("soil_moisture_0_to_1cm"), F.transform("c", lambda s: s["wind_speed"]).alias("wind_speed_10m"))
    raw = per_day.select("loc", F.to_json(F.struct(hourly.alias("hourly"))).alias("value"))
    return files.json_arrays_to_rows(raw, "hourly", {"precipitation": "precipitation", "soil_moisture_0_to_1cm": "soil_surface", "wind_speed_10m": "wind"}, keep=["loc"])


@query(oracle("NAMOBJ mean_elev:d risk_pct:d n_vertices:i lon:d lat:d", "select zone as \"NAMOBJ\", mean_elev, risk_pct, 5 as n_vertices, lon0 as lon, lat0 as lat from zones", "zones"))
def geojson_features(spark, d):
    """Zones written as GeoJSON features and read back."""
    z = rel.zone_rings(rel.zones(spark, d)).withColumnRenamed("zone", "NAMOBJ")
    text = files.feature_text(z, ["NAMOBJ", "mean_elev", "risk_pct"])
    f = files.geojson_features(text, {"NAMOBJ": "string", "mean_elev": "double", "risk_pct": "double"})
    return f.select("NAMOBJ", "mean_elev", "risk_pct", F.size("ring").alias("n_vertices"), F.col("ring")[0]["lon"].alias("lon"), F.col("ring")[0]["lat"].alias("lat"))


DIRTY = """select id, "timestamp", risk_level, probability, rain_24h, depth_cm, id % 7 = 3 as ragged from pred_log"""


@query(oracle("waktu:t status probabilitas:d hujan_hari_ini:d akumulasi_3_hari:d ragged", """
select date_trunc('second', "timestamp") as waktu, risk_level as status, case when not ragged then round(probability*100, 3)/100 end as probabilitas, rain_24h as hujan_hari_ini, depth_cm as akumulasi_3_hari, ragged from dirty""", "pred_log", {"dirty": DIRTY}))
def clean_prediction_log(spark, d):
    """The prediction log as a person would have kept it - percent signs, mixed case, lost columns - cleaned."""
    p = rel.pred_log(spark, d)
    lost = F.col("id") % 7 == 3
    pct = F.concat(F.round(F.col("probability") * 100, 3).cast("string"), F.lit("%"))
    dirty = p.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Waktu"),
        F.when(lost, F.initcap(F.lower("risk_level"))).otherwise(F.col("risk_level")).alias("Status"),
        F.when(lost, F.col("rain_24h").cast("string")).otherwise(pct).alias("Probabilitas"),
        F.when(lost, F.col("depth_cm").cast("string")).otherwise(F.col("rain_24h").cast("string")).alias("Hujan Hari Ini"),
        F.when(~lost, F.col("depth_cm").cast("string")).alias("Akumulasi 3 Hari"),
    )
    return logs.clean_prediction_log(dirty)


RUNS = """select 'run_' || loc as run, count(*)::double as n_samples, avg(depth_cm) as mean_depth, max(probability) as max_probability from pred_log group by loc"""


@query(oracle("run n_samples:d mean_depth:d max_probability:d is_best", "select *, run = (select run from runs order by mean_depth desc, run limit 1) as is_best from runs", "pred_log", {"runs": RUNS}))
def run_metrics_pivot(spark, d):
    """Per-site summaries logged as long run rows, then pivoted; the best run by mean depth marked."""
    per = rel.pred_log(spark, d).groupBy("loc").agg(F.count(F.lit(1)).alias("n"), F.avg("depth_cm").alias("m"), F.max("probability").alias("p"))
    run = F.concat(F.lit("run_"), F.col("loc"))
    rows = F.concat(files.run_rows(run, "param", {"n_samples": F.col("n")}), files.run_rows(run, "metric", {"mean_depth": F.col("m"), "max_probability": F.col("p")}))
    long = per.select(F.inline(rows))
    best = files.best_run(long, "mean_depth").select("run").scalar()
    return files.pivot_runs(long, ["n_samples", "mean_depth", "max_probability"]).withColumn("is_best", F.col("run") == best)
