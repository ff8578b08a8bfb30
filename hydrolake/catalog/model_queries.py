"""Fitted tree ensembles: their nodes and what they predict. The oracles fit the same trees again in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake.catalog.registry import oracle, query
from hydrolake.catalog.risk_queries import PARTS, band
from hydrolake.catalog.series_queries import DAYSUM, HOURLY_ORACLE, STREAK, W
from hydrolake.functions import risk
from hydrolake.plans import learners, models, scoring
from hydrolake.sources import relations as rel

FEATURES = ["rain_sum_imputed", "rain_intensity_max", "soil_moisture_surface_mean", "soil_moisture_root_mean", "pasut_msl_max"]
#: Small enough that SQL can grow the same trees again, level by level.
DEPTH = learners.Boosting("depth", rounds=4, depth=3, step=0.3, loss="squared", l2=0.0)
FLOOD = learners.Boosting("flood", rounds=3, depth=3, step=0.3, loss="logistic", l2=1.0)
#: A split counts as best from this share of the best gain on; the first feature, then the lowest cut is taken.
TIE = learners.TIE


def growth(spec: learners.Boosting, rows: str, bins: int = learners.BINS) -> dict[str, str]:
    """CTEs that bin ``rows`` (id, the features, y) and boost them: ``nodes`` (tree, node, feature, cut, value, cover), ``start``."""
    long = " union all ".join(f"select id, {i} as f, {c}::double as v from rows" for i, c in enumerate(FEATURES))
    out = {
        "rows": rows,
        "long": long,
        "ranked": "select f, v, row_number() over (partition by f order by v) - 1 as place, count(*) over (partition by f) as n, max(v) over (partition by f) as top from long",
        "picked": f"select distinct f, v from ranked where v < top and list_contains([floor((k / {bins}::double) * (n - 1))::bigint for k in range(1, {bins})], place)",
        "cuts": "select f, v as cut, row_number() over (partition by f order by v) - 1 as b, count(*) over (partition by f) as n_cuts from picked",
        "cut_lists": "select f, list(cut order by cut) as cl from cuts group by f",
        "x": "select id, long.f, len(list_filter(cl, lambda c: c < v)) as bin from long join cut_lists on long.f = cut_lists.f",
        "start": "select avg(y) as base from rows" if spec.loss == "squared" else "select ln(avg(y) / (1 - avg(y))) as base from rows",
        "p0": "select id, y, base as p from rows cross join start",
    }
    least = spec.least_child
    for t in range(spec.rounds):
        slope = "p - y as g, 1.0::double as h" if spec.loss == "squared" else "1/(1+exp(-p)) - y as g, (1/(1+exp(-p)))*(1 - 1/(1+exp(-p))) as h"
        out[f"g{t}"] = f"select id, {slope} from p{t}"
        out[f"n{t}_0"] = "select id, 1 as node, true as open from rows"
        for d in range(spec.depth):
            k = f"{t}_{d}"
            out[f"h{k}"] = f"select node, f, bin, sum(g) as g, sum(h) as h from n{k} n join g{t} on n.id = g{t}.id join x on x.id = n.id where open group by 1, 2, 3"
            out[f"c{k}"] = f"""select node, f, bin, sum(g) over w as gl, sum(h) over w as hl, sum(g) over a as ga, sum(h) over a as ha from h{k}
 window w as (partition by node, f order by bin), a as (partition by node, f)"""
            out[f"s{k}"] = f"""select node, c.f, bin, cut, gl*gl/(hl+{spec.l2}) + (ga-gl)*(ga-gl)/(ha-hl+{spec.l2}) - ga*ga/(ha+{spec.l2}) as gain
 from c{k} c join cuts on cuts.f = c.f and cuts.b = c.bin where hl >= {least} and ha - hl >= {least}"""
            out[f"b{k}"] = f"""select node, min(f * 1000 + bin) as best from (select *, max(gain) over (partition by node) as most from s{k}) where most > 1e-12 and gain >= most * {TIE!r} group by node"""
            out[f"n{t}_{d + 1}"] = f"""select n.id, case when b.node is null then n.node else 2 * n.node + case when x.bin > b.best % 1000 then 1 else 0 end end as node, b.node is not null as open
 from n{k} n left join b{k} b on n.node = b.node and n.open left join x on x.id = n.id and x.f = b.best // 1000"""
        last = f"n{t}_{spec.depth}"
        out[f"leaf{t}"] = f"select node, -{spec.step}::double * sum(g) / (sum(h) + {spec.l2}) as value, sum(h) as cover from {last} n join g{t} on n.id = g{t}.id group by node"
        out[f"p{t + 1}"] = f"select p.id, y, p + value as p from p{t} p join {last} n on n.id = p.id join leaf{t} l on l.node = n.node"
    inner = " union all ".join(
        f"select {t} as tree, b.node, best // 1000 as feature, cut, 0.0::double as value, c.ha as cover from b{t}_{d} b join cuts on f = best // 1000 and cuts.b = best % 1000 "
        f"join (select distinct node, max(ha) over (partition by node) as ha from c{t}_{d} where f = 0) c on c.node = b.node" for t in range(spec.rounds) for d in range(spec.depth))
    leaves = " union all ".join(f"select {t}, node, -1, 0.0::double, value, cover from leaf{t}" for t in range(spec.rounds))
    out["nodes"] = f"{inner} union all {leaves}"
    return out


def descent(spec: learners.Boosting, table: str) -> dict[str, str]:
    """CTEs that walk every row of ``table`` (row id ``rid`` and the features) down all trees: ``summed`` (rid, s)."""
    out = {
        "entered": f"select rid, [{', '.join(f'{c}::double' for c in FEATURES)}] as x from {table}",
        "w0": f"select rid, x, tree, 1 as node from entered cross join (select unnest(range({spec.rounds})) as tree)",
    }
    for d in range(spec.depth):
        out[f"w{d + 1}"] = f"""select rid, x, w.tree, case when n.feature < 0 then w.node else 2 * w.node + case when x[n.feature + 1] > n.cut then 1 else 0 end end as node
 from w{d} w join nodes n on n.tree = w.tree and n.node = w.node"""
    out["summed"] = f"select rid, max(base) + sum(n.value) as s from w{spec.depth} w join nodes n on n.tree = w.tree and n.node = w.node cross join start group by rid"
    return out


DEPTH_ROWS = f"""select row_number() over (order by loc, tanggal) as id, {', '.join(FEATURES)},
 coalesce(rain_intensity_max, 0) * 2.0::double + greatest(coalesce(pasut_msl_max, 0) - 2.5::double, 0.0::double) * 20.0::double as y from obs_daily"""
FLOOD_ROWS = f"select row_number() over (order by loc, tanggal) as id, {', '.join(FEATURES)}, case when status_siaga = 'Aman' then 0 else 1 end as y from obs_daily"


def fitted_depth(spark, d):
    rows = rel.obs_daily(spark, d).withColumn("depth", risk.formula_depth("rain_intensity_max", "pasut_msl_max"))
    return models.fit(rows, DEPTH, FEATURES, "depth")


def fitted_flood(spark, d):
    rows = rel.obs_daily(spark, d).withColumn("flood", F.when(F.col("status_siaga") == "Aman", 0).otherwise(1))
    return models.fit(rows, FLOOD, FEATURES, "flood")


NODE_COLUMNS = "tree:i node:i feature:i cut:d value:d cover:d"


@query(oracle(NODE_COLUMNS, "select * from nodes", "obs_daily", growth(DEPTH, DEPTH_ROWS)))
def depth_tree_nodes(spark, d):
    """The trees of a boosted regression, node by node."""
    return _node_rows(fitted_depth(spark, d))


@query(oracle(NODE_COLUMNS, "select * from nodes", "obs_daily", growth(FLOOD, FLOOD_ROWS), digits=4), digits=4)
def flood_tree_nodes(spark, d):
    """The trees of a boosted classifier, node by node."""
    return _node_rows(fitted_flood(spark, d))


def _node_rows(model):
    whole = [F.col(c).cast("long").alias(c) for c in ("tree", "node", "feature")]
    return model.nodes.select(*whole, "cut", "value", "cover")


@query(oracle("loc tanggal:t score:d", "select loc, tanggal, 1 / (1 + exp(-s)) as score from days join summed on rid = did", "obs_daily", {
    **growth(FLOOD, FLOOD_ROWS), "days": "select row_number() over (order by loc, tanggal) as did, * from obs_daily", **descent(FLOOD, "(select *, did as rid from days)")}))
def flood_probabilities(spark, d):
    """Probability of a flood by a fitted classifier, every day of every place."""
    return models.positive_probability(fitted_flood(spark, d), rel.obs_daily(spark, d)).select("loc", "tanggal", "score")


_WET = "case when rain_sum_imputed > 150 then 'Hujan Ekstrem' when rain_sum_imputed > 50 then 'Hujan Deras' else '' end"


@query(oracle("loc tanggal:t depth_cm:d level label main_factor", f"""
select loc, tanggal, depth_cm, {band(PARTS[0])} as level, {band(PARTS[1])} as label,
 case when wet <> '' and tide - 2.8::double > 0 then wet || ' & Rob' when wet <> '' then wet when tide - 2.8::double > 0 then 'Pasang Rob' else 'Tidak Ada' end as main_factor
from (select loc, tanggal, least(300, greatest(0, s)) as depth_cm, pasut_msl_max as tide, {_WET} as wet from days join summed on rid = did)""", "obs_daily", {
    **growth(DEPTH, DEPTH_ROWS), "days": "select row_number() over (order by loc, tanggal) as did, * from obs_daily", **descent(DEPTH, "(select *, did as rid from days)")}))
def daily_model_assessment(spark, d):
    """Daily assessment by a fitted depth model."""
    scored = scoring.score_rows(rel.obs_daily(spark, d).drop("status_siaga"), fitted_depth(spark, d), keep=["loc", "tanggal"])
    return scored.select("loc", "tanggal", "depth_cm", "level", "label", "main_factor")


@query(oracle("loc time:t depth_cm:d status rain_rolling_24h:d est:d precipitation:d", f"""
select *, case when depth_cm < 20 then 'AMAN' when depth_cm < 50 then 'WASPADA' when depth_cm < 100 then 'SIAGA' else 'AWAS' end as status from (
 select loc, "time", rain_sum_imputed as rain_rolling_24h, pasut_msl_max as est, rain_intensity_max as precipitation,
  avg(greatest(0, s)) over ({W} rows between 1 preceding and 1 following) as depth_cm from hours join summed on rid = hid)""", "obs_hourly obs_daily", {
    "daysum": DAYSUM, "streaks": STREAK.format(t='"time"', name="wet_hours", rain="precipitation", rel="obs_hourly"), "hourly": HOURLY_ORACLE,
    "hours": 'select row_number() over (order by loc, "time") as hid, * from hourly', **growth(DEPTH, DEPTH_ROWS), **descent(DEPTH, "(select *, hid as rid from hours)")}))
def hourly_model_status(spark, d):
    """Hourly status by a fitted depth model instead of the formula."""
    scored = scoring.score_series(rel.obs_hourly(spark, d), fitted_depth(spark, d))
    return scored.select("loc", "time", "depth_cm", "status", "rain_rolling_24h", "est", "precipitation")
