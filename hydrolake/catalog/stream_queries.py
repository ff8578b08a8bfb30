"""Streaming jobs run over the event files until all are read; the sink's table is the result.

A window is final once the watermark (last event time minus the allowed lateness) has passed its end,
so the oracles keep exactly those windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydrolake.catalog.registry import oracle, query
from hydrolake.operators import series
from hydrolake.session import shared_folder
from hydrolake.sources import relations as rel
from hydrolake.streaming import jobs

LAST = "(select max(ts) - interval 2 hour from events)"


#: Slices of time into which a replay cuts the events.
SLICES = 4


def replayed(spark, d, base):
    """The events cut into slices of time, each of which makes a micro-batch; those without a time come first.

    A slice is written by as many tasks as the input has parts, and read as so many files.
    """
    events = rel.table(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(t.alias("t")).approxQuantile("t", [k / SLICES for k in range(1, SLICES)], 0.01)
    files = max(1, events.rdd.getNumPartitions())
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events.where(t.isNull() | (t <= cuts[0]) if low is None else t > low) if cuts else events
        (part if high is None or low is None else part.where(t <= high)).repartition(files).write.mode("append").parquet(f"{base}/in")
    return jobs.read_gauges(spark, f"{base}/in", files_per_batch=files)


def run(spark, d, start, source=None, replay=False):
    """Drain the stream into a fresh folder below the shared one and read it back."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    readings = replayed(spark, d, base) if replay else jobs.read_gauges(spark, d, "events.parquet")
    q = start(source(readings) if source else readings, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def times(df, column="window"):
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return df.withColumns({"start": ntz(f"{column}.start"), "end": ntz(f"{column}.end")}).drop(column)


HOURS = """select loc, "time" as start, "time" + interval 1 hour as "end", sum(case when event_type='purchase' then value end) as rain, max(case when event_type='signup' then value end) as wind, count(*) as n from gauge_events group by 1, 2"""


@query(oracle("loc start:t end:t rain:d wind:d n", f'select * from hours where "end" <= {LAST}', "gauge_events", {"hours": HOURS}))
def stream_hourly(spark, d):
    return times(run(spark, d, jobs.start_hourly)).select("loc", "start", "end", "rain", "wind", "n")


@query(oracle("loc end:t rain:d n:i", f"""
select g.loc, g."end", sum(h.rain) as rain, sum(h.n) as n from (select distinct loc, unnest(generate_series("end", "end" + interval 23 hour, interval 1 hour)) as "end" from hours) g
join hours h on h.loc = g.loc and h."end" <= g."end" and h."end" > g."end" - interval 24 hour where g."end" <= {LAST} group by 1, 2""", "gauge_events", {"hours": HOURS}))
def stream_rolling(spark, d):
    return times(run(spark, d, jobs.start_rolling)).select("loc", "end", "rain", "n")


SPELLS = """select loc, min(ts) as start, max(ts) + interval 1 hour as "end", count(*) as n, sum(value) as rain from (
 select *, sum(new) over (partition by loc order by ts) as spell from (select *, case when ts - lag(ts) over (partition by loc order by ts) < interval 1 hour then 0 else 1 end as new from gauge_events where event_type='purchase' and value > 0)) group by loc, spell"""


@query(oracle("loc start:t end:t n rain:d", f"select * from spells", "gauge_events", {"spells": SPELLS}))
def wet_spell_sessions(spark, d):
    e = rel.gauge_events(spark, d).select("loc", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    return times(jobs.wet_spell_sessions(e), "session_window").select("loc", "start", "end", "n", "rain")


@query(oracle("loc start:t end:t n rain:d", "select * from spells where \"end\" <= (select max(ts) - interval 2 hour from events where event_type='purchase' and value > 0)", "gauge_events", {"spells": SPELLS}))
def wet_spells(spark, d):
    return times(run(spark, d, jobs.start_wet_spells), "session_window").select("loc", "start", "end", "n", "rain")


@query(oracle("loc hour:i api:d", """
select e.loc, l.hour, sum(e.value * power(0.85::double, l.hour - e.hour)) as api from (select loc, epoch_us("time") // 3600000000 as hour, value from gauge_events where event_type='purchase' and value > 0) e
join (select loc, max(epoch_us("time") // 3600000000) as hour from gauge_events where event_type='purchase' and value > 0 group by 1) l on l.loc = e.loc group by 1, 2""", "gauge_events"))
def stream_api(spark, d):
    states = run(spark, d, jobs.start_api)
    return states.groupBy("loc").agg(F.max_by("hour", "batch_id").alias("hour"), F.max_by("api", "batch_id").alias("api"))


DEPTH = "(2*value/4)"
STATUS = f"case when {DEPTH} < 20 then 'AMAN' when {DEPTH} < 50 then 'WASPADA' when {DEPTH} < 100 then 'SIAGA' else 'AWAS' end"


@query(oracle("event_id loc depth_cm:d status", f"select event_id, user_id // 5 as loc, {DEPTH} as depth_cm, {STATUS} as status from events where event_type='purchase' and value > 0"))
def stream_log(spark, d):
    return run(spark, d, jobs.start_log).select("event_id", "loc", "depth_cm", "status")


SCORED = f"select user_id // 5 as loc, {STATUS} as status, ts from events where event_type='purchase' and value > 0 and {DEPTH} >= 50"
ALERTS = """select loc, status, min(ts) as ts from scored group by all
union all select a.loc, a.status, (select min(s.ts) from scored s where s.loc = a.loc and s.status = a.status and s.ts >= a.ts + interval 6 hour) from alerts a where a.ts is not null"""


@query(f"with recursive scored as materialized ({SCORED}), alerts as ({ALERTS}) select loc, status, ts::varchar as ts from alerts where ts is not null")
def stream_alerts(spark, d):
    alerts = run(spark, d, jobs.start_alerts, jobs.scored_frame, replay=True)
    return alerts.select("loc", "status", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(oracle("loc start:t rain:d upstream_rain:d", """
select r.loc, r.start, r.rain, coalesce(u.upstream_rain, 0) as upstream_rain from (select loc, "time" as start, sum(value) as rain from gauge_events where event_type='purchase' group by 1, 2) r
left join (select loc, "time" + interval 6 hour as start, sum(value) as upstream_rain from gauge_events where event_type='error' group by 1, 2) u on u.loc = r.loc and u.start = r.start
where r.start + interval 1 hour <= least((select max(ts) from events where event_type='purchase'), (select max(ts) + interval 6 hour from events where event_type='error')) - interval 2 hour""", "gauge_events"))
def stream_upstream(spark, d):
    return times(run(spark, d, jobs.start_upstream, replay=True)).select("loc", "start", "rain", "upstream_rain")
