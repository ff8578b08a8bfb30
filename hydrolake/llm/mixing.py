"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame operations only).

Slot i of the schedule stands at frac((i + 0.5) * golden ratio) on the line of cumulative target weights and so
belongs to one source; its rank among that source's slots names the block of tokens it takes. A source's documents,
shuffled by a hash, lie end to end and are cut into blocks of equal token counts; when the blocks run out they start
over. A source's last slot takes only what is left of its target. As slots keep the proportions up to a few blocks, a
source that still lacks slots at the end of the schedule gets them as closing slots, and slots beyond its target
lapse, so the words taken equal the target rounded.

Targets: ``share`` of all sizes, dealt by weight; a target stops at ``most`` times its source's size, and the excess
is dealt again by weight. This is min(most * size, level * weight) with the one level that spends the whole budget,
found from running sums over the sources in order of size / weight (one row per source).

No task holds a source: slots and documents are numbered within small ranges and shifted by the sums of the
ranges before. Defined cases: null text has size 0; a null source is a source of its own, the last; documents of
size 0 and sources without words take 0 words; repeated rows are documents of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolake.llm.common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
GOLDEN = 0.6180339887498949
#: Slots and documents numbered in one task at once.
RANGE = 1024
#: Cells of the weight line by which slots meet sources.
CELLS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, weight, target from source, source_size; one row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    # the level if exactly the sources before this one are full; it rises to the right one and falls behind it
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / open_weight).withColumn("_level", F.max("_level").over(everything))
    return s.select("source", "source_size", "weight", F.least("cap", F.col("_level") * F.col("weight")).alias("target"))


def _placed(docs: DataFrame) -> DataFrame:
    """Each row's first token on its source's line, in shuffled order."""
    n = docs.agg(F.count("*")).first()[0]
    buckets = max(1, n // RANGE + 1)
    # an order that is the same in every run: by hash, then id; the hash's leading digits name the range
    d = docs.withColumn("_h", F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    d = d.withColumn("_bucket", F.floor(F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / float(16**12) * buckets).cast("long"))
    sums = d.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("start", F.col("_ahead") + F.col("_in"))
        .drop("_h", "_bucket", "_in", "_s", "_b", "_ahead")
    )


def _schedule(goals: DataFrame, block: int, n_slots: int) -> DataFrame:
    """source, block, take: tokens that each slot takes from the head of its block."""
    spark = goals.sparkSession
    line = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    g = goals.withColumn("_from", F.coalesce(F.sum("goal").over(line), F.lit(0)) / F.sum("goal").over(Window.partitionBy()))
    g = g.withColumn("_to", F.lead("_from", 1, 2.0).over(Window.orderBy("_from", F.col("goal"), F.col("source").isNull(), F.col("source"))))
    g = g.where("goal > 0")
    cells = g.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * CELLS), F.floor(F.least(F.col("_to"), F.lit(0.9999999999)) * CELLS))))
    slots = spark.range(n_slots).select(F.col("id").alias("_slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("_x"))
    slots = slots.withColumn("_cell", F.floor(F.col("_x") * CELLS))
    owned = slots.join(cells, "_cell").where("_x >= _from and _x < _to").select("source", "_slot")
    owned = owned.withColumn("_range", F.floor(F.col("_slot") / RANGE))
    # rank of a slot among its source's: number inside a range of slots, shifted by the ranges before
    counts = owned.groupBy("source", "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_n", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "_range").orderBy("_slot")
    ranked = (
        owned.withColumn("_in", F.row_number().over(inside) - 1)
        .join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .select("source", (F.col("_ahead") + F.col("_in")).alias("rank"))
    )
    blocks = F.ceil(F.col("source_size") / block)
    over = F.greatest(F.col("goal") - F.col("source_size"), F.lit(0))
    g = g.withColumn("_blocks", blocks)
    # a second round over the blocks begins when the first is used up
    g = g.withColumn("_need", F.when(over > 0, F.col("_blocks") + F.ceil(over / block)).otherwise(F.ceil(F.col("goal") / block)))
    had = counts.groupBy("_s").agg(F.sum("_n").alias("_had"))
    closing = (
        g.join(had, F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumn("_had", F.coalesce("_had", F.lit(0)))
        .where("_had < _need")
        .select("source", F.explode(F.sequence(F.col("_had"), F.col("_need") - 1)).alias("rank"))
    )
    g = g.select(F.col("source").alias("_s"), "source_size", "goal", "_blocks", "_need")
    all_slots = ranked.unionByName(closing).join(g, F.col("source").eqNullSafe(F.col("_s"))).where("rank < _need")
    number = F.col("rank") % F.col("_blocks")
    done = F.floor(F.col("rank") / F.col("_blocks")) * F.col("source_size") + number * block  # tokens taken by the slots before
    length = F.least(F.lit(block), F.col("source_size") - number * block)
    return all_slots.select("source", number.alias("block"), F.least(length, F.col("goal") - done).alias("take"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, with source and ``start``, its place on its source's line.

    ``carry`` names columns that are handed through, such as a row number by which repeated rows are told apart. Words are taken from a document's head on; taken mod size words belong to an incomplete last copy.
    """
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *carry))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(per_source, weights, share, most).withColumn("goal", F.round("target").cast("long")))
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # about as many slots as documents, 16,384 at least where there are words enough
    budget = int(share * total)
    block = max(1, budget // max(n, 1 << 14))
    visits = _schedule(goals, block, -(-budget // block) if budget else 0)
    placed = _placed(sized)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    placed = stored(placed.withColumn("_row", F.monotonically_increasing_id()))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("start"), F.col("block") * block)
    overlap = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take")) - a
    v = visits.groupBy("source", "block", "take").agg(F.count("*").alias("_times"))
    v = v.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "take", "_times")
    took = (
        pieces.join(v, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
        .groupBy("_row")
        .agg(F.sum(F.greatest(overlap, F.lit(0)) * F.col("_times")).alias("taken"))
    )
    g = goals.select(F.col("source").alias("_s"), "source_size", "target")
    return (
        placed.join(took, "_row", "left")
        .join(g, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "start", *carry)
    )


ORACLE = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::bigint as size from documents),
 s as (select source, sum(size)::bigint as source_size from d group by source),
 w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight,
        2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as budget from s),
 x as (select max(level) as level from (select (any_value(a.budget) - coalesce(sum(b.cap) filter (b.cap / b.weight < a.cap / a.weight), 0))
        / sum(b.weight) filter (b.cap / b.weight >= a.cap / a.weight) as level from w a cross join w b group by a.source)),
 t as (select source, source_size, least(cap, (select level from x) * weight) as target from w),
 p as (select d.*, coalesce(sum(size) over (partition by source order by md5('mix' || doc_id::varchar), doc_id
        rows between unbounded preceding and 1 preceding), 0)::bigint as start from d)
select p.doc_id, p.size, t.source_size, round(t.target, 3) as target,
 (greatest(0, least(p.start + p.size, round(t.target)) - p.start)
  + greatest(0, least(p.start + p.size, round(t.target) - t.source_size) - p.start))::bigint as taken
from p join t on p.source is not distinct from t.source
"""
