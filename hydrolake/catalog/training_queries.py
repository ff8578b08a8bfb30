"""Training tables, resampling, evaluation and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.catalog.registry import oracle, query
from hydrolake.catalog.rollup_queries import V6_UP
from hydrolake.catalog.series_queries import LAG_API, STREAK, rows_between
from hydrolake.operators import metrics, neighbours, ranking, stats
from hydrolake.plans import datasets, features, models
from hydrolake.sources import relations as rel

WD = "partition by loc order by tanggal"
FLOATS = set(config.FEATURES_V6) - {"is_high_tide", "is_heavy_rain", "is_rainy_season", "is_weekend", "prev_flood_30d", "prev_meluap_30d", "tide_rain_sync"}


def typed(names) -> str:
    return " ".join(f"{n}:d" if n in FLOATS else f"{n}:i" for n in names)


# --- datasets --------------------------------------------------------------------------------


def durations(spark, d):
    """Daily rain, wet hours and tide as in the first tables, some values missing."""
    o = rel.obs_daily(spark, d)
    return o.select("loc", "tanggal", F.when(F.col("loc") % 4 != 1, F.col("rain_sum_imputed")).alias("curah_hujan_mm"),
                    F.when(F.col("loc") % 4 != 2, F.col("rain_intensity_max")).alias("durasi_hujan_jam"), "pasut_msl_max")


DUR = """select loc, tanggal, coalesce(case when loc % 4 <> 1 then rain_sum_imputed end, 0) as curah_hujan_mm, coalesce(case when loc % 4 <> 2 then rain_intensity_max end, 0) as durasi_hujan_jam, pasut_msl_max from obs_daily"""
V1_COLUMNS = "curah_hujan_mm durasi_hujan_jam pasut_msl_max pasut_slope hujan_lag1 hujan_lag2 hujan_lag3 hujan_3days pasut_max_lag1"


@query(oracle("loc tanggal:t " + " ".join(f"{c}:d" for c in V1_COLUMNS.split()), f"""
select loc, tanggal, curah_hujan_mm, durasi_hujan_jam, pasut_msl_max, coalesce(pasut_msl_max - lag(pasut_msl_max) over ({WD}), 0) as pasut_slope,
 {", ".join(f"coalesce(lag(curah_hujan_mm, {k}) over ({WD}), 0) as hujan_lag{k}" for k in (1, 2, 3))},
 list_reduce(list(curah_hujan_mm) over ({WD} rows between unbounded preceding and current row), lambda a, x: a*0.85::double + x) as hujan_3days,
 coalesce(lag(pasut_msl_max) over ({WD}), pasut_msl_max) as pasut_max_lag1 from dur""", "obs_daily", {"dur": DUR}))
def dataset_v1(spark, d):
    return datasets.dataset_v1(durations(spark, d)).select("loc", "tanggal", *V1_COLUMNS.split())


@query(oracle("loc tanggal:t curah_hujan_mm:d durasi_hujan_jam:d pasut_msl_max:d hujan_kemarin:d hujan_akumulasi_3hari:d", f"""
select * from (select loc, tanggal, curah_hujan_mm, durasi_hujan_jam, pasut_msl_max, lag(curah_hujan_mm) over ({WD}) as hujan_kemarin,
 case when count(curah_hujan_mm) {rows_between(3, WD)} = 3 then sum(curah_hujan_mm) {rows_between(3, WD)} end as hujan_akumulasi_3hari
 from (select loc, tanggal, case when loc % 4 <> 1 then rain_sum_imputed end as curah_hujan_mm, case when loc % 4 <> 2 then rain_intensity_max end as durasi_hujan_jam, pasut_msl_max from obs_daily))
where curah_hujan_mm is not null and durasi_hujan_jam is not null and hujan_kemarin is not null and hujan_akumulasi_3hari is not null""", "obs_daily"))
def dataset_v0(spark, d):
    return datasets.dataset_v0(durations(spark, d))


def event_days(spark, d):
    """Daily rows on the hourly gauges' own dates and places: rain summed from the hours, label by rain."""
    from hydrolake.operators import rollups

    daily = rollups.daily_rollup(rel.obs_hourly(spark, d))
    tide = rel.obs_hourly(spark, d).groupBy("loc", F.to_date("time").alias("tanggal")).agg(F.max("est").alias("pasut_msl_max"))
    r = F.col("rain_sum_imputed")
    return daily.join(tide, ["loc", "tanggal"]).withColumn("status_siaga", F.when(r > 50, "Banjir").when(r > 20, "Air Meluap").otherwise("Aman"))


EVENT_DAYS = """select loc, cast("time" as date) as tanggal, sum(precipitation) as rain_sum_imputed, max(precipitation) as rain_intensity_max, avg(soil_moisture_surface) as soil_moisture_surface_mean,
 avg(soil_moisture_root) as soil_moisture_root_mean, max(est) as pasut_msl_max, case when sum(precipitation) > 50 then 'Banjir' when sum(precipitation) > 20 then 'Air Meluap' else 'Aman' end as status_siaga from obs_hourly group by 1, 2"""


@query(oracle("loc tanggal:t status_siaga rain_sum_imputed:d rain_intensity_max:d soil_moisture_surface_mean:d soil_moisture_root_mean:d", """
select l.loc, l.tanggal, l.status_siaga, e.rain_sum_imputed, e.rain_intensity_max, e.soil_moisture_surface_mean, e.soil_moisture_root_mean from
 (select loc, tanggal + interval 1 day as tanggal, status_siaga from e) l left join e on e.loc=l.loc and e.tanggal=l.tanggal::date""", "obs_hourly", {"e": EVENT_DAYS}))
def dataset_v2(spark, d):
    """Labels reach one day past the archive, so the last label of a site finds no weather."""
    labels = event_days(spark, d).select("loc", (F.date_add("tanggal", 1)).cast("timestamp_ntz").alias("at"), "status_siaga")
    labels = labels.withColumn("tanggal", F.to_date("at"))
    out = datasets.dataset_v2(labels, rel.obs_hourly(spark, d))
    return out.select("loc", F.col("at").alias("tanggal"), "status_siaga", "rain_sum_imputed", "rain_intensity_max", "soil_moisture_surface_mean", "soil_moisture_root_mean")


V3_COLUMNS = ["rain_sum_imputed", "rain_intensity_max", "rain_rolling_3h", "soil_moisture_surface_mean", "soil_moisture_root_mean", "pasut_msl_max", *[f"hujan_lag{k}" for k in range(1, 8)], "api_7day"]


@query(oracle("loc tanggal:t " + " ".join(f"{c}:d" for c in V3_COLUMNS), f"""
select loc, tanggal, rain_sum_imputed, rain_intensity_max, rain_intensity_max*3 as rain_rolling_3h, soil_moisture_surface_mean, soil_moisture_root_mean, pasut_msl_max,
 {", ".join(f"coalesce(lag(rain_sum_imputed, {k}) over ({WD}), 0) as hujan_lag{k}" for k in range(1, 8))}, rain_sum_imputed + {LAG_API} as api_7day from obs_daily""", "obs_daily"))
def dataset_v3(spark, d):
    return datasets.dataset_v3(rel.obs_daily(spark, d)).select("loc", "tanggal", *V3_COLUMNS)


def v4_sql(source: str) -> str:
    return f"""select *, rain_sum_imputed + {LAG_API} as api_7day, {", ".join(f"coalesce(lag(rain_sum_imputed, {k}) over ({WD}), 0) as rain_lag{k}" for k in range(1, 8))},
 sum(rain_sum_imputed) {rows_between(3, WD)} as rain_cumsum_3d, sum(rain_sum_imputed) {rows_between(7, WD)} as rain_cumsum_7d, pasut_msl_max*rain_sum_imputed as tide_rain_interaction,
 (soil_moisture_surface_mean+soil_moisture_root_mean)/2 as soil_saturation_index, case when pasut_msl_max > 2.5 then 1 else 0 end as is_high_tide, case when rain_sum_imputed > 50 then 1 else 0 end as is_heavy_rain,
 sin(2*pi()*month(tanggal)/12) as month_sin, cos(2*pi()*month(tanggal)/12) as month_cos, case when month(tanggal) in (11,12,1,2,3) then 1 else 0 end as is_rainy_season, case when isodow(tanggal) >= 6 then 1 else 0 end as is_weekend,
 coalesce(sum(case when label = 2 then 1 else 0 end) over ({WD} rows between 30 preceding and 1 preceding), 0) as prev_flood_30d, coalesce(sum(case when label >= 1 then 1 else 0 end) over ({WD} rows between 30 preceding and 1 preceding), 0) as prev_meluap_30d
from (select *, case status_siaga when 'Aman' then 0 when 'Air Meluap' then 1 when 'Banjir' then 2 end as label from {source})"""


V4_COLUMNS = "loc tanggal:t " + typed(config.FEATURES_V4) + " label:i status_siaga"


@query(oracle(V4_COLUMNS, v4_sql("obs_daily"), "obs_daily"))
def dataset_v4(spark, d):
    return datasets.dataset_v4(rel.obs_daily(spark, d))


V6_DAILY = """select loc, cast("time" as date) as tanggal, max(r3) as rain_intensity_3h, sum(case when precipitation > 10 then 1 else 0 end) as rain_burst_count,
 sum(case when hour("time") >= 22 or hour("time") <= 6 then precipitation else 0 end) as night, max(wind_speed) as wind_speed_max
 from (select *, sum(precipitation) over (partition by loc order by "time" rows between 2 preceding and current row) as r3 from obs_hourly) group by 1, 2"""
V6_SQL = f"""select v.*, h.rain_intensity_3h, h.rain_burst_count, coalesce(soil_saturation_index - lag(soil_saturation_index, 3) over (partition by v.loc order by v.tanggal), 0) as soil_saturation_trend,
 case when pasut_msl_max > 2.5 and rain_sum_imputed > 50 then 1 else 0 end as tide_rain_sync, st.days as consecutive_rain_days, least(greatest(1 + 0.2::double*h.night/(rain_sum_imputed + 1e-5::double), 0.8), 1.2) as hour_risk_factor,
 least(greatest(rain_cumsum_7d/200, 0), 2) as drain_capacity_index, coalesce(u.upstream_rain_6h, 0) as upstream_rain_6h, h.wind_speed_max, coalesce(rain_intensity_max - lag(rain_intensity_max) over (partition by v.loc order by v.tanggal), 0) as rainfall_acceleration
from ({v4_sql("e")}) v join v6d h on h.loc=v.loc and h.tanggal=v.tanggal left join up u on u.loc=v.loc and u.tanggal=v.tanggal join st on st.loc=v.loc and st.tanggal=v.tanggal"""
V6_EXTRA = {"e": EVENT_DAYS, "v6d": V6_DAILY, "up": V6_UP, "st": STREAK.format(t="tanggal", name="days", rain="rain_sum_imputed", rel="e")}


def v6(spark, d):
    h = rel.obs_hourly(spark, d)
    return datasets.dataset_v6(event_days(spark, d), h, h.select("loc", "time", "upstream_precipitation"))


@query(oracle("loc tanggal:t " + typed(config.FEATURES_V6) + " label:i status_siaga", V6_SQL, "obs_hourly", V6_EXTRA))
def dataset_v6(spark, d):
    return v6(spark, d)


@query(oracle("loc tanggal:t water_depth_cm:d " + typed(config.FEATURES_V6) + " elevation_m:d drainage_capacity:d label:i status_siaga", f"""
select *, 2*rain_intensity_max + 20*greatest(pasut_msl_max - 2.5::double, 0) as water_depth_cm, 2.0 as elevation_m, 50.0 as drainage_capacity from ({V6_SQL})""", "obs_hourly", V6_EXTRA))
def dataset_v7(spark, d):
    return datasets.dataset_v7(v6(spark, d), noise=False, by_label=False, digits=12)


# --- preparation -----------------------------------------------------------------------------

GAPPY = """select loc, tanggal, case when loc % 3 <> 0 then rain_sum_imputed end as rain_sum_imputed, case when loc % 5 <> 0 then pasut_msl_max end as pasut_msl_max, tanggal < date '2000-01-01' as is_train from obs_daily"""


def gappy(spark, d):
    return rel.obs_daily(spark, d).select(
        "loc", "tanggal", F.when(F.col("loc") % 3 != 0, F.col("rain_sum_imputed")).alias("rain_sum_imputed"),
        F.when(F.col("loc") % 5 != 0, F.col("pasut_msl_max")).alias("pasut_msl_max"), (F.col("tanggal") < F.lit("2000-01-01").cast("date")).alias("is_train"))


@query(oracle("loc tanggal:t rain_sum_imputed:d pasut_msl_max:d", """
select loc, tanggal, coalesce(rain_sum_imputed, (select avg(rain_sum_imputed) from g where is_train)) as rain_sum_imputed, coalesce(pasut_msl_max, (select avg(pasut_msl_max) from g where is_train)) as pasut_msl_max from g""", "obs_daily", {"g": GAPPY}))
def mean_impute(spark, d):
    g = gappy(spark, d)
    return stats.mean_impute(g.where("is_train"), ["rain_sum_imputed", "pasut_msl_max"], g).drop("is_train")


@query(oracle("loc tanggal:t rain_sum_imputed:d pasut_msl_max:d", """
select loc, tanggal, (rain_sum_imputed - (select avg(rain_sum_imputed) from g where is_train))/(select stddev_pop(rain_sum_imputed) from g where is_train) as rain_sum_imputed,
 (pasut_msl_max - (select avg(pasut_msl_max) from g where is_train))/(select stddev_pop(pasut_msl_max) from g where is_train) as pasut_msl_max from g""", "obs_daily", {"g": GAPPY}))
def standardize(spark, d):
    g = gappy(spark, d)
    return stats.standardize(g.where("is_train"), ["rain_sum_imputed", "pasut_msl_max"], g).drop("is_train")


KEYED = "row_number() over (partition by status_siaga order by md5('42:' || loc || ':' || tanggal::varchar)) as rk, count(*) over (partition by status_siaga) as n"


@query(oracle("loc tanggal:t status_siaga is_train:i", f"select loc, tanggal, status_siaga, case when rk <= round(n*0.8::double) then 1 else 0 end as is_train from (select *, {KEYED} from obs_daily)", "obs_daily"))
def stratified_split(spark, d):
    return ranking.stratified_split(rel.obs_daily(spark, d).select("loc", "tanggal", "status_siaga"), "status_siaga", ["loc", "tanggal"])


@query(oracle("loc tanggal:t is_train:i", """select loc, tanggal, case when row_number() over (order by md5('42:' || loc || ':' || tanggal::varchar)) <= round((select count(*) from obs_daily)*0.8::double) then 1 else 0 end as is_train from obs_daily""", "obs_daily"))
def plain_split(spark, d):
    return ranking.plain_split(rel.obs_daily(spark, d).select("loc", "tanggal"), ["loc", "tanggal"])


@query(oracle("loc tanggal:t status_siaga fold:i", f"select loc, tanggal, status_siaga, (rk - 1) % 10 as fold from (select *, {KEYED} from obs_daily)", "obs_daily"))
def kfold_assign(spark, d):
    return ranking.kfold_assign(rel.obs_daily(spark, d).select("loc", "tanggal", "status_siaga"), "status_siaga", ["loc", "tanggal"])


@query(oracle("loc tanggal:t status_siaga copy:i", f"""
select loc, tanggal, status_siaga, unnest(range(1, (m // n + case when rk <= m % n then 1 else 0 end + 1)::bigint)) as copy from (select *, max(n) over () as m from (select *, {KEYED} from obs_daily))""", "obs_daily"))
def upsample_classes(spark, d):
    return ranking.upsample(rel.obs_daily(spark, d).select("loc", "tanggal", "status_siaga"), "status_siaga", ["loc", "tanggal"])


@query(oracle("loc tanggal:t rain_sum_imputed:d", "select loc, tanggal, rain_sum_imputed from obs_daily order by md5('42:' || (loc || '/' || tanggal::varchar)) limit 10", "obs_daily"))
def preview_rows(spark, d):
    o = rel.obs_daily(spark, d).select("loc", "tanggal", "rain_sum_imputed").withColumn("key", F.concat_ws("/", F.col("loc").cast("string"), F.col("tanggal").cast("string")))
    return ranking.preview(o, "key", 10).drop("key")


NEAR = """select a.id, a.y, b.id as neighbour, list_distance(a.x, b.x) as distance, row_number() over (partition by a.id order by list_distance(a.x, b.x), b.id) as rank from vectors a join vectors b on a.id <> b.id {on} qualify rank <= {k}"""


@query(oracle("id rank:i neighbour distance:d", NEAR.format(on="and a.y = b.y", k=3), "vectors"))
def knn_minority(spark, d):
    """Three nearest rows of the same class, for every class."""
    return neighbours.knn(rel.vectors(spark, d), 3, within="y")


def unit(salt: str, parts: str) -> str:
    return f"(('0x' || substr(md5('42{salt}:' || {parts}), 1, 8))::ubigint / 4294967296.0::double)"


GROWN = f"""select id, copy, y, list_transform(range(1, len(x) + 1), lambda i: x[i] + (p[i] - x[i]) * u) as x from (
 select d.id, d.copy, d.y, d.x, p.x as p, d.u from (
  select id, y, x, copy, {unit('gap', "id || ':' || copy")} as u, floor({unit('nn', "id || ':' || copy")}*least(3, n-1)) + 1 as rank from (
   select id, y, x, n, unnest(range(1, ((m-n) // n + case when rk <= (m-n) % n then 1 else 0 end + 1)::bigint)) as copy from (
    select *, max(n) over () as m from (select id, y, x, row_number() over (partition by y order by md5('42:' || id)) as rk, count(*) over (partition by y) as n from vectors)))) d
 join near on near.id = d.id and near.rank = d.rank join vectors p on p.id = near.neighbour)
union all select id, 0, y, x from vectors"""
# sums over all coordinates, one of them weighted by place, so that every coordinate counts
WHOLE = "id, copy, y, x[1] as first, x[-1] as last, list_sum(x) as total, list_sum(list_transform(range(1, len(x) + 1), lambda i: i * x[i])) as placed"
VECTOR_COLUMNS = "id copy:i y first:d last:d total:d placed:d"


def whole_vectors(df):
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return df.select("id", "copy", "y", F.col("x")[0].alias("first"), F.element_at("x", -1).alias("last"), add(F.col("x")).alias("total"),
                     add(F.transform("x", lambda v, i: v * (i + 1))).alias("placed"))


@query(oracle(VECTOR_COLUMNS, f"select {WHOLE} from grown", "vectors", {"near": NEAR.format(on="and a.y = b.y", k=3), "grown": GROWN}))
def smote(spark, d):
    return whole_vectors(neighbours.smote(rel.vectors(spark, d), k=3))


@query(oracle("id y", """
select id, y from vectors v where y = (select y from vectors group by y order by count(*), y limit 1) or not exists (select 1 from near n join vectors b on b.id = n.neighbour where n.id = v.id and b.y <> v.y)""", "vectors", {"near": NEAR.format(on="", k=3)}))
def enn_filter(spark, d):
    return neighbours.enn_filter(rel.vectors(spark, d), 3).select("id", "y")


@query(oracle(VECTOR_COLUMNS, f"""
select {WHOLE} from rows r where y = (select y from rows group by y order by count(*), y limit 1) or not exists (
 select 1 from around n join rows b on b.row_id = n.neighbour where n.row_id = r.row_id and b.y <> r.y)""", "vectors", {
    "near": NEAR.format(on="and a.y = b.y", k=3), "grown": GROWN,
    "rows": "select *, ('0x' || substr(md5('42row:' || id || ':' || copy), 1, 15))::bigint as row_id from grown",
    "around": "select a.row_id, b.row_id as neighbour from rows a join rows b on a.row_id <> b.row_id qualify row_number() over (partition by a.row_id order by list_distance(a.x, b.x), b.row_id) <= 3"}))
def smote_enn(spark, d):
    """Oversampled and cleaned rows, originals and copies."""
    return whole_vectors(neighbours.smote_enn(rel.vectors(spark, d)))


# --- evaluation ------------------------------------------------------------------------------

CONF = """select y, case when score >= 0.01 then 1 else 0 end as p from scored"""


@query(oracle("class:i precision:d recall:d f1:d support:i accuracy:d f1_macro:d f1_weighted:d target_met", """
select *, sum(tp) over () / sum(support) over () as accuracy, avg(f1) over () as f1_macro, sum(f1*support) over () / sum(support) over () as f1_weighted, f1 >= 0.9 as target_met from (
select class, precision, recall, coalesce(2*precision*recall/nullif(precision+recall, 0), 0) as f1, support, tp from (
select c.class, coalesce(sum(case when p=class and y=class then 1 else 0 end)::double / nullif(sum(case when p=class then 1 else 0 end), 0), 0) as precision,
 coalesce(sum(case when p=class and y=class then 1 else 0 end)::double / nullif(sum(case when y=class then 1 else 0 end), 0), 0) as recall, sum(case when y=class then 1 else 0 end) as support, sum(case when p=class and y=class then 1 else 0 end)::double as tp
from conf cross join (select unnest([0, 1]) as class) c group by 1))""", "scored", {"conf": CONF}))
def confusion_metrics(spark, d):
    flagged = rel.scored(spark, d).withColumn("p", metrics.apply_threshold("score", 0.01))
    report = metrics.class_report(flagged, "y", "p")
    total = metrics.summary(report).select(F.struct("accuracy", "f1_macro", "f1_weighted").alias("s")).scalar()
    return report.select("class", "precision", "recall", "f1", "support", *[total.getField(c).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")],
                         (F.col("f1") >= metrics.TARGET_F1).alias("target_met"))


AUC_SQL = "select sum(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0 end)/count(*) as auc, count(distinct a.id) as n_pos, count(distinct b.id) as n_neg from {t} a join {t} b on a.y = 1 and b.y = 0"


@query(oracle("auc:d n_pos:i n_neg:i", AUC_SQL.format(t="scored"), "scored"))
def roc_auc(spark, d):
    return metrics.roc_auc(rel.scored(spark, d), "y", "score")


OUTCOMES = "select id, probability as score, case when actual_outcome = 'Banjir' then 1 else 0 end as y from pred_log"
# rank-sum form of the same area, for the larger table
RANK_AUC = "select (sum(case when y=1 then r end) - sum(y)*(sum(y)+1)/2.0::double)/(sum(y)*sum(1-y)) as auc from (select y, rank() over (order by score) + (count(*) over (partition by score) - 1)/2.0::double as r from outcomes)"


@query(oracle("auc:d", RANK_AUC, "pred_log", {"outcomes": OUTCOMES}))
def roc_auc_log(spark, d):
    """Area of the logged probabilities against the reported floods."""
    p = rel.pred_log(spark, d).select("id", F.col("probability").alias("score"), F.when(F.col("actual_outcome") == "Banjir", 1).otherwise(0).alias("y"))
    return metrics.roc_auc(p, "y", "score").select("auc")


@query(oracle("auc_weighted:d", """
select sum(auc*n)/sum(n) as auc_weighted from (select c, (sum(case when y=c then r end) - sum((y=c)::int)*(sum((y=c)::int)+1)/2.0::double)/(sum((y=c)::int)*sum((y<>c)::int)) as auc, sum((y=c)::int) as n from (
 select c, y, rank() over (partition by c order by s) + (count(*) over (partition by c, s) - 1)/2.0::double as r from (
 select label as y, 0 as c, -rain as s from m union all select label, 1, least(rain, 60-rain) from m union all select label, 2, rain from m)) group by c)""",
 "obs_daily", {"m": "select case status_siaga when 'Aman' then 0 when 'Air Meluap' then 1 else 2 end as label, rain_sum_imputed as rain from obs_daily"}))
def roc_auc_multiclass(spark, d):
    m = datasets.class_labels(rel.obs_daily(spark, d)).select("label", F.col("rain_sum_imputed").alias("rain"))
    m = m.select("label", (-F.col("rain")).alias("s0"), F.least(F.col("rain"), 60 - F.col("rain")).alias("s1"), F.col("rain").alias("s2"))
    return metrics.roc_auc_multiclass(m, "label", {0: "s0", 1: "s1", 2: "s2"})


PR = """select score as threshold, tp/(tp+fp) as precision, tp/np as recall, 2*(tp/(tp+fp))*(tp/np)/(tp/(tp+fp) + tp/np + 1e-10::double) as f1 from (
 select score, sum(p) over (order by score desc)::double as tp, sum(n) over (order by score desc)::double as fp, sum(p) over ()::double as np from (select score, sum(y) as p, sum(1-y) as n from {t} group by 1))"""


@query(oracle("threshold:d precision:d recall:d f1:d", PR.format(t="scored") + " order by f1 desc, threshold limit 1", "scored", digits=8), digits=8)
def best_threshold(spark, d):
    return metrics.best_threshold(rel.scored(spark, d), "y", "score")


@query(oracle("threshold:d precision:d recall:d f1:d", PR.format(t="outcomes"), "pred_log", {"outcomes": OUTCOMES}))
def pr_curve(spark, d):
    p = rel.pred_log(spark, d).select(F.col("probability").alias("score"), F.when(F.col("actual_outcome") == "Banjir", 1).otherwise(0).alias("y"))
    return metrics.pr_curve(p, "y", "score").select("threshold", "precision", "recall", "f1")


@query(oracle("mae:d rmse:d r2:d n:i", "select avg(abs(y-p)) as mae, sqrt(avg((y-p)*(y-p))) as rmse, 1 - avg((y-p)*(y-p))/var_pop(y) as r2, count(*) as n from (select rain_sum_imputed as y, rain_intensity_max*4 as p from obs_daily)", "obs_daily"))
def regression_metrics(spark, d):
    o = rel.obs_daily(spark, d).select(F.col("rain_sum_imputed").alias("y"), (F.col("rain_intensity_max") * 4).alias("p"))
    return metrics.regression_metrics(o, "y", "p")


# --- models at full size (rows only; model_queries.py has those that SQL fits again) ------------

MODEL_FEATURES = config.FEATURES_V4


def training_rows(spark, d):
    rows = datasets.dataset_v4(rel.obs_daily(spark, d)).select("loc", "tanggal", *MODEL_FEATURES, "label")
    return rows.withColumn("is_flood", F.when(F.col("label") >= 1, 1).otherwise(0))


def held_out(spark, d, spec, label="is_flood"):
    from hydrolake.session import cut_lineage

    split = cut_lineage(ranking.stratified_split(training_rows(spark, d), label, ["loc", "tanggal"]))
    model = models.fit(split.where("is_train = 1"), spec, MODEL_FEATURES, label, stored=True)
    return model, split.where("is_train = 0")


def scored_report(spark, d, spec):
    model, test = held_out(spark, d, spec)
    return models.evaluate(models.positive_probability(model, test), "is_flood")


@query()
def train_rf(spark, d):
    return scored_report(spark, d, models.RANDOM_FOREST)


@query()
def train_gbt(spark, d):
    return scored_report(spark, d, models.BOOSTED)


@query()
def train_gbt_3class(spark, d):
    """Boosting of the three classes with balanced weights; the report of the held-out rows, class by class."""
    model, test = held_out(spark, d, models.BOOSTED_3_CLASSES, "label")
    named = (F.array_position("score", F.array_max("score")) - 1).cast("int")
    return metrics.class_report(model.predict(test).withColumn("named", named), "label", "named").select("class", "precision", "recall", "f1", "support")


@query()
def tuned_model(spark, d):
    """Boosting and regression stacked, the threshold tuned on out-of-fold scores and applied to the held-out rows."""
    from hydrolake.session import cut_lineage

    split = cut_lineage(ranking.stratified_split(training_rows(spark, d), "is_flood", ["loc", "tanggal"]))
    trained = models.train_ensemble(split.where("is_train = 1"), [models.BOOSTED, models.LOGISTIC], MODEL_FEATURES, "is_flood", ["loc", "tanggal"])
    scored = trained.transform(split.where("is_train = 0"))
    return models.evaluate(scored, "is_flood", "score", trained.threshold).withColumn("threshold", F.lit(trained.threshold))


@query()
def train_lr(spark, d):
    return scored_report(spark, d, models.LOGISTIC)


@query()
def train_depth_model(spark, d):
    from hydrolake.session import cut_lineage

    rows = datasets.depth_target(datasets.dataset_v4(rel.obs_daily(spark, d)))
    split = cut_lineage(ranking.plain_split(rows.select("loc", "tanggal", *MODEL_FEATURES, "water_depth_cm"), ["loc", "tanggal"]))
    model = models.fit(split.where("is_train = 1"), models.DEPTH_MODEL, MODEL_FEATURES, "water_depth_cm", stored=True)
    return metrics.regression_metrics(model.predict(split.where("is_train = 0"), 0, "prediction"), "water_depth_cm", "prediction")


@query()
def feature_importances(spark, d):
    model, _ = held_out(spark, d, models.RANDOM_FOREST)
    return models.importances(model)


STACK_SPECS = [models.RANDOM_FOREST, models.BOOSTED, models.LOGISTIC]


@query()
def stacked_model(spark, d):
    """Fitted on the training part only; the report is of the held-out part."""
    from hydrolake.session import cut_lineage

    split = cut_lineage(ranking.stratified_split(training_rows(spark, d), "is_flood", ["loc", "tanggal"]))
    ensemble = models.stack(split.where("is_train = 1"), STACK_SPECS, MODEL_FEATURES, "is_flood", ["loc", "tanggal"])
    return models.evaluate(ensemble.transform(split.where("is_train = 0")), "is_flood")


@query()
def compare_models(spark, d):
    return models.compare(training_rows(spark, d), STACK_SPECS, MODEL_FEATURES, "is_flood", ["loc", "tanggal"])
