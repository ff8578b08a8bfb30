"""Merkle manifest of a dataset with nested-interval labels.

Every node of a tree carries the interval of leaf ranks that it covers, [lo, hi). A node of level k starts at a
multiple of ``arity``^k, so lo and the level name the bucket in which a child meets its parent: lo div arity^(k+1).
A parent is kept with its run of children; the children of the run whose interval is not the node's own, that is the
parent's interval without the node's, are the node's siblings. Hashes go up level by level (one grouping each, of at most
``arity`` rows a group); the siblings of all ancestors come down by one containment join a level, so what is attached to
a node is shared by all leaves below it and no leaf is joined once per level.

The documents of a source, in the order of their ids, are the leaves of its tree; the roots of these trees, in the
order of the sources, are the leaves of the tree above. A hot source is no group anywhere: leaves are numbered by
ranges, and all keys are (source, bucket).

Defined cases: a null field enters its hash as ``-``, so it differs from every value; a null source is a source of its
own, the first; rows of one id are ordered by their leaf, and equal rows give equal leaves; a document with a null id is
the first of its source and is never tampered with; texts of any length are hashed whole; an empty table gives an empty
result; columns other than the five fields are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import crc32_sql, stored
from hydrolake.llm.ordering import numbered

ARITY = 3
#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: Column) -> Column:
    """sha256 as 32 bytes; shown as lowercase hex wherever it is hashed again or returned."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def shown(value: Column) -> Column:
    return F.lower(F.hex(value))


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*[framed(f) for f in fields]))


def joined(digests: Column) -> Column:
    """The hex texts of an array of digests, end to end."""
    return F.array_join(F.transform(digests, shown), "")


def grow(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The nodes of all trees by level: tree, n (leaves of the tree), lo, hi, hash, kids (lo, hi, hash of the children), own.

    ``leaves``: tree, n, lo, hash and ``own``, what else a leaf carries; nodes above have none. The node that covers
    [0, n) is the root and has no parent.
    """
    kid = "array<struct<lo:bigint,hi:bigint,hash:binary>>"
    now = leaves.select("tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "hash", F.lit(None).cast(kid).alias("kids"), "own")
    levels, width = [stored(now)], 1
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while width < most:
        width *= arity
        runs = (
            levels[-1]
            .where("hi - lo < n")
            .groupBy("tree", "n", F.floor(F.col("lo") / width).alias("bucket"))
            .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "hash"))).alias("kids"))
        )
        up = runs.select(
            "tree", "n", F.element_at("kids", 1)["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
            digest(joined(F.col("kids")["hash"])).alias("hash"), "kids", F.lit(None).cast(leaves.schema["own"].dataType).alias("own"),
        )
        levels.append(stored(up))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """The root of every tree; a lone leaf is its tree's root."""
    found = [nodes.where("hi - lo = n") for nodes in levels]
    return reduce(DataFrame.unionByName, found)


def attach(levels: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with the siblings on their way up: tree, lo, hash, own, top, path.

    ``above``: _tree, top, path of every tree: what its root hands down. A path is an array from the leaf upwards of
    (before, after): the hex texts of the siblings that stand before and after the node.
    """
    columns = ["tree", "n", "lo", "hi", "hash", "kids", "own", "top", "path"]
    now, width = None, arity ** len(levels)
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        tips = nodes.where("hi - lo = n")
        found = tips.join(above, tips["tree"].eqNullSafe(above["_tree"])).select(*columns)
        if now is not None:
            parents = now.where("kids is not null").select(
                F.col("tree").alias("_tree"), F.floor(F.col("lo") / width).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_run"), "top", "path"
            )
            inner = nodes.where("hi - lo < n")
            inside = inner["tree"].eqNullSafe(parents["_tree"]) & (F.floor(F.col("lo") / width) == F.col("_bucket")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            met = inner.join(parents, inside)
            # the parent's interval without the node's own
            before = F.filter("_run", lambda s: s["hi"] <= F.col("lo"))
            after = F.filter("_run", lambda s: s["lo"] >= F.col("hi"))
            step = F.array(F.struct(joined(before["hash"]).alias("before"), joined(after["hash"]).alias("after")))
            found = found.unionByName(met.withColumn("path", F.concat(step, F.col("path"))).select(*columns))
        now, width = stored(found) if k else found, width // arity
    return now.select("tree", "lo", "hash", "own", "top", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["before"], shown(h), s["after"])))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, other_text: Column | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path, other of every row; digests as bytes.

    ``other`` is the leaf of the row with ``other_text`` for its text (null without it), to be checked against the root.
    """
    fields = [F.col(f) for f in FIELDS]
    other = F.lit(None).cast("binary") if other_text is None else leaf_of([other_text if f == "text" else F.col(f) for f in FIELDS])
    hashed = docs.select(F.col("source").alias("tree"), "doc_id", leaf_of(fields).alias("hash"), other.alias("other"), F.monotonically_increasing_id().alias("_tie"))
    leaves = numbered(hashed, ["tree"], ["doc_id", "hash", "_tie"], "lo", "n")
    levels = grow(leaves.select("tree", "n", "lo", "hash", F.struct("doc_id", "other").alias("own")), arity)
    # the tree above: its leaves are the subroots, in the order of the sources
    sub = roots(levels).select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "hash")
    upper = grow(numbered(sub, ["tree"], ["source"], "lo", "n").select("tree", "n", "lo", "hash", F.struct("source").alias("own")), arity)
    end = F.array().cast("array<struct<before:string,after:string>>")
    top = attach(upper, roots(upper).select(F.col("tree").alias("_tree"), F.col("hash").alias("top"), end.alias("path")), arity)
    handed = stored(top.select(F.col("own.source").alias("_tree"), F.struct(F.col("top").alias("root"), F.col("hash").alias("subroot")).alias("top"), "path"))
    found = attach(levels, handed, arity)
    return found.select(
        F.col("own.doc_id").alias("doc_id"), F.col("tree").alias("source"), F.col("hash").alias("leaf"),
        F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), "path", F.col("own.other").alias("other"),
    )


def verified(found: DataFrame) -> DataFrame:
    """The manifest as hex texts, with the proof's digest, the root folded from ``other`` and whether it is the root."""
    again = folded(F.col("other"), F.col("path"))
    return found.withColumn("_again", again).select(
        "doc_id", *[shown(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        shown(F.col("_again")).alias("folded_root"), (F.col("_again") == F.col("root")).alias("verified"),
    )


def without_newlines(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The tampering of the registered query: line feeds go from the texts of ids whose crc32 is even."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))


_H = "case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
_LEAF = " || ".join(_H.format(c=c) for c in FIELDS)
_OTHER = " || ".join(_H.format(c="other_text" if c == "text" else c) for c in FIELDS)
# Trees of the groups g of ``leaves`` (g, j, m, h): all nodes, and what stands before and after each in its run.
_TREE = """
 {u}(g, level, j, m, h) as (select g, 0, j, m, h from {leaves}
   union all select g, level + 1, j // 3, (m + 2) // 3, sha256(string_agg(h, '' order by j)) from {u} where m > 1 group by g, level, j // 3, (m + 2) // 3),
 {u}s as materialized (select x.g, x.level, x.j, coalesce(string_agg(y.h, '' order by y.j) filter (y.j < x.j), '') as before,
   coalesce(string_agg(y.h, '' order by y.j) filter (y.j > x.j), '') as after
  from {u} x join {u} y on x.g = y.g and x.level = y.level and x.j // 3 = y.j // 3 where x.m > 1 group by 1, 2, 3)"""

ORACLE = f"""
with recursive c as (select *, case when source is null then 'n' else 's' || source end as g,
   case when {crc32_sql("doc_id::varchar")} % 2 = 0 then replace(text, chr(10), '') else text end as other_text from documents),
 hashed as (select *, sha256({_LEAF}) as h, sha256({_OTHER}) as other from c),
 leaf as materialized (select row_number() over (order by g, doc_id nulls first, h) as id, doc_id, source, g, h, other,
   row_number() over (partition by g order by doc_id nulls first, h) - 1 as j, count(*) over (partition by g) as m from hashed),{_TREE.format(u="u", leaves="leaf")},
 source as (select distinct g, source from leaf),
 subroot as materialized (select 'top' as g, u.g as tree, row_number() over (order by source nulls first) - 1 as j, count(*) over () as m, u.h
  from u join source on u.g = source.g where u.m = 1),{_TREE.format(u="v", leaves="subroot")},
 step as (select leaf.id, us.level as k, before, after from leaf join us on us.g = leaf.g and us.j = leaf.j // (3 ** us.level)::bigint
  union all select leaf.id, 1000 + vs.level, before, after from leaf join subroot on leaf.g = subroot.tree
   join vs on vs.j = subroot.j // (3 ** vs.level)::bigint),
 path as (select id, string_agg(before || after, '' order by k) as proof, list({{'b': before, 'a': after}} order by k) as steps from step group by id),
 done as (select doc_id, leaf.h as leaf, subroot.h as subroot, (select h from v where m = 1) as root, sha256(coalesce(proof, '')) as proof_sha256,
   list_reduce(list_concat([{{'b': other, 'a': ''}}], coalesce(steps, [])), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b as folded_root
  from leaf join subroot on leaf.g = subroot.tree left join path on path.id = leaf.id)
select *, folded_root = root as verified from done
"""
