"""URL filter: a trie over reversed host labels, then path segments; the longest matching rule decides.

A rule (host, path, verdict) fits its host and all its subdomains where the url's path starts with the
rule's path. Of several that fit, the one with most host labels wins, then the one with the longest path;
of equal rules block wins. Rules are broadcast as a trie up to MAX_RULES of them; a longer list is joined on
the (host suffix, path prefix) pairs of each url, which gives the same verdicts.

Defined cases: url null or without ``://``: host and path are empty, no rule; a host with a port or a user
keeps it, as the labels are taken literally; without a rule the verdict is allow for a url that has a host
and block for one that has none. Extra columns are dropped unless named as id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are sent to every worker; more are joined.
MAX_RULES = 200_000


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the top level down, each node's "/" leading to a trie of path segments.

    A rule's last segment that has no slash behind it is kept as the key of a prefix, under "*".
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("." + label, {})
        node = node.setdefault("/", {})
        whole, _, rest = path.rpartition("/")
        for segment in whole.split("/") if "/" in path else []:
            node = node.setdefault("/" + segment, {})
        key = ("*", rest)
        old = node.get(key)
        node[key] = (f"{host}{path}", "block" if old and old[1] == "block" else verdict)
    return root


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule of most host labels, then of the longest path."""
    node = trie
    levels = []
    for label in reversed(host.split(".")) if host else []:
        node = node.get("." + label)
        if node is None:
            break
        levels.append(node)
    for node in reversed(levels):
        at, place, deeper = node.get("/"), 0, []
        while at is not None:
            deeper.append((at, place))
            cut = path.find("/", place)
            if cut < 0:
                break
            at = at.get("/" + path[place:cut])
            place = cut + 1
        for at, place in reversed(deeper):
            found = [(len(k[1]), v) for k, v in at.items() if k[0] == "*" and path.startswith(k[1], place)]
            if found:
                return max(found)[1]
    return None


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every row. rules: columns host, path, verdict."""
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rules = rules.select("host", "path", "verdict").distinct()
    some = rules.limit(MAX_RULES + 1).collect()
    found = _by_trie(urls, [tuple(r) for r in some], id_col) if len(some) <= MAX_RULES else _by_join(urls, rules, id_col)
    method = F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit("allow"))
    return found.select(id_col, "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.arrow_udf("rule string, verdict string")
    def decide(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = shared.value
        for hosts, paths in parts:
            found = [look_up(trie, h, p) or (None, None) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["rule", "verdict"])

    return urls.withColumn("_found", decide("host", "path")).select(id_col, "host", "path", "_found.rule", "_found.verdict")


def _by_join(urls: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """Every host suffix with every path prefix that ends at a slash or at the end, joined with the rules.

    A rule's path is split after its last slash; what stands behind is compared as a prefix.
    """
    keyed = urls.withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    parts = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.concat_ws("/", F.slice(parts, F.lit(1), k)), F.lit("/"))),
    )
    keys = keyed.withColumn("_host", F.explode(suffixes)).withColumn("_dir", F.explode(prefixes))
    r = rules.select(
        F.col("host").alias("_host"), F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("_dir"), F.col("path").alias("_path"),
        F.concat("host", "path").alias("rule"), "verdict",
    )
    hit = keys.join(r, ["_host", "_dir"]).where(F.col("path").startswith(F.col("_path")))
    rank = F.struct(F.size(F.split("_host", r"\.")), F.length("_path"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    best = hit.groupBy("_row").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_best"))
    return keyed.join(best, "_row", "left").select(id_col, "host", "path", "_best.rule", "_best.verdict")
