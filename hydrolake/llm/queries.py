"""Registered queries of the operators, over whole tables and with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import (
    conversation_repair, exact_dedup, fuzzy_hash, importance, language_id, license_scan, merkle, mixing, near_duplicates, neighbour_graph, packing, recurrent_lm, url_filter,
)
from hydrolake.llm.common import fold, table


def vocabulary() -> str:
    """The public tokenizer file of the packing query; every worker has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The contract's rules: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_SQL = """
with p as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
 h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
 r(rule_host, rule_path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
   ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
 m as (select page_id, arg_max(rule_host || rule_path, length(rule_host) * 1000 + length(rule_path)) as rule,
   arg_max(verdict, length(rule_host) * 1000 + length(rule_path)) as verdict
  from h join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1)
select h.page_id, host, path, rule, coalesce(verdict, case when host = '' then 'block' else 'allow' end) as verdict
from h left join m on h.page_id = m.page_id
"""


#: Exact similarity of all pairs that share a shingle, and the smallest id that links reach.
NEAR_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^ \\t-\\r]+') as ws from documents),
 s as materialized (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
   else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end) as g from w),
 n as materialized (select doc_id, count(*) as n from s group by 1),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
 l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
 r(doc_id, root) as (select a, b from l union select r.doc_id, l.b from r join l on l.a = r.root)
select d.doc_id, coalesce((select min(root) from r where r.doc_id = d.doc_id), d.doc_id) as class_id,
 (select count(*) from l where l.a = d.doc_id) as n_links, coalesce((select n from n where n.doc_id = d.doc_id), 0) as n_shingles
from documents d
"""


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(table(spark, sf_dir, "documents"))


def op2_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_graph.search(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(fold("doc_id") != 0))
    found = language_id.identify(docs.select("doc_id", "text", (fold("doc_id") == 0).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.drop("text")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.joined(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


def op9_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_hash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(conversations), conversations)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_newlines()))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_recurrent_lm, op2_neighbour_graph, op3_language_id, op4_license_scan, op5_url_filter, op6_source_mix, op7_importance,
        op8_near_duplicates, op9_fuzzy_hash, op10_packing, op11_exact_dedup, op12_conversation_repair, op13_merkle_manifest, pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op5_url_filter": URL_SQL, "op6_source_mix": mixing.ORACLE, "op8_near_duplicates": NEAR_SQL,
    "op11_exact_dedup": exact_dedup.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE, "op13_merkle_manifest": merkle.ORACLE,
}
