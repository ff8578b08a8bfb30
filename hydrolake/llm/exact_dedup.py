"""Exact duplicates by deterministic block naming (DataFrame operations only).

A text without its white space is cut into blocks of ``block`` code points. The distinct blocks are sorted, and a
block's place in that order is its integer name; then adjacent pairs of a text's names are sorted and named in the
same way, again and again, until each text has one name. Equal names mean equal texts and nothing else: no step
relies on a hash to be free of collisions.

The order of blocks is by (64-bit hash, content): the hash deals blocks evenly and stands for the content wherever no
other block has the same hash, so contents are shuffled once, behind a map-side distinct. Blocks that do share a hash
are found by that same shuffle, numbered by their content, and told apart by that number from then on. A pair of names
is 16 bytes and needs no hash. Texts of equal length take part in equally many rounds; a last block without partner
pairs with -1, which is no name. So (number of rounds, last name) identifies a text.

Hot groups: copies meet in map-side distincts and in joins that Spark splits; no window or list holds a group. Texts
that are finished leave the rounds, so the rows of a round halve each time.

Defined cases: null text counts as empty, all empty or blank texts are one group; a text of any length is handled whole;
of equal rows (same length, same id) exactly one is kept; an id that is null is the largest; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolake.llm.common import stored

#: Code points of a block.
BLOCK = 1024
BLANK = r"[ \t-\r]+"
NO_PARTNER = -1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def blocks(text: Column, block: int = BLOCK) -> Column:
    """The text in pieces of ``block`` code points, the last one shorter; an empty text is one empty piece."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces)


def _block_rows(texts: DataFrame, block: int, code: Callable[[Column], Column]) -> DataFrame:
    cut = texts.select(F.explode(blocks(F.col("text"), block)).alias("block"))
    return cut.select(code(F.col("block")).alias("h"), "block")


def _sharing(texts: DataFrame, block: int, code: Callable[[Column], Column]) -> DataFrame:
    """h, block, place: blocks whose hash other blocks have too, numbered by content. Hardly ever any."""
    rows = _block_rows(texts, block, code)
    shared = stored(rows.distinct().groupBy("h").count().where("count > 1").select("h"))
    found = rows.join(shared, "h", "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("h").orderBy("block")) - 1
    return stored(found.withColumn("place", place))


def _named(pairs: DataFrame) -> DataFrame:
    """Rows with the integer name of (a, b): its place in the sorted order of all distinct (a, b).

    The order is dealt by ranges and written once; a place is the range's number and the place inside it.
    """
    keys = pairs.select("a", "b").distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    names = stored(keys.withColumn("name", F.monotonically_increasing_id()))
    names = names.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "name")
    return pairs.join(names, (pairs["a"] == names["_a"]) & (pairs["b"] == names["_b"])).drop("a", "b", "_a", "_b")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
               code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """row, doc_id, n_points, text_sha256, rounds, name of every row; (rounds, name) is equal where the normalised texts are.

    ``code`` is the hash that stands for a block; any function of the block gives the same groups.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw"))
    texts = raw.select("doc_id", F.length(F.coalesce("_raw", F.lit(""))).cast("long").alias("n_points"), normalised(F.col("_raw")).alias("text"))
    sharing = _sharing(texts.select("text"), block, code)
    # the number of a row is given before its blocks are, in the one job that writes them
    rows = texts.withColumn("row", F.monotonically_increasing_id()).withColumn("_blocks", blocks(F.col("text"), block))
    cut = rows.select(
        "row", "doc_id", "n_points", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.size("_blocks").alias("left"), F.posexplode("_blocks").alias("pos", "block")
    ).withColumn("a", code(F.col("block")))
    told = sharing.select(F.col("h").alias("_h"), F.col("block").alias("_block"), "place")
    cut = cut.join(told, (F.col("a") == F.col("_h")) & (F.col("block") == F.col("_block")), "left")
    head = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    cut = stored(cut.select("row", "pos", "left", head("doc_id"), head("n_points"), head("text_sha256"), "a", F.coalesce("place", F.lit(0)).cast("long").alias("b")))
    most = cut.agg(F.max("left")).first()[0] or 1
    now, done, rounds = stored(_named(cut.select("row", "pos", "left", "a", "b"))), None, 0
    while True:
        # a text is finished when one name is left of it
        ended = now.where("left = 1").select("row", F.lit(rounds).alias("rounds"), "name")
        done = ended if done is None else done.unionByName(ended)
        if most <= 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            now.where("left > 1")
            .groupBy("row", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("left") + 1, 1).alias("left"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NO_PARTNER)).cast("long").alias("b"))
        )
        now, most, rounds = stored(_named(stored(pairs))), (most + 1) // 2, rounds + 1
    heads = cut.where("pos = 0").select("row", "doc_id", "n_points", "text_sha256")
    return heads.join(done, "row")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document, dropped ones too: row, doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Of equal texts the row with the most code points in its original text stays, then the one of the smallest id.
    """
    rows = stored(identified(docs, id_col, text_col, block))
    # the best row is the least of (shorter by, null id, id, row)
    rank = F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = rows.groupBy("rounds", "name").agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
    groups = groups.select(F.col("rounds").alias("_rounds"), F.col("name").alias("_name"), "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("_best"))
    met = rows.join(groups, (rows["rounds"] == groups["_rounds"]) & (rows["name"] == groups["_name"]))
    return met.select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("_best")).alias("kept"), "text_sha256", "n_points")


ORACLE = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', '', 'g')) as text_sha256,
   regexp_replace(coalesce(text, ''), '[ \t-\r]+', '', 'g') as t from documents),
 g as (select *, row_number() over w as place, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size
  from d window w as (partition by t order by n desc, doc_id nulls last))
select doc_id, keep_id, group_size::bigint as group_size, place = 1 as kept, text_sha256 from g
"""
