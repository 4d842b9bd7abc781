"""The ten operators on the driver's tables, with their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import binpack, html, langid, maxent, maxsketch, mixing, packing, pivot_join, runs, simhash, suffix, topk, urlfilter
from logloom.llm.urlfilter import Rule

#: Target shares of the sources; all others share the rest equally.
MIX_TARGETS = {"src0": 0.2}
URL_RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_read(spark, sf_dir, "documents"), langid.split_of("doc_id", 7) != 2)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_join.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages)).select("page_id", "url", "text", "n_chars")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), MIX_TARGETS)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rest = langid.split_of("doc_id", 4)
    filters = langid.learn(docs, rest != 2)
    return langid.predict(docs.select("doc_id", "text", (rest == 2).alias("held_out")), filters).select("doc_id", "held_out", "lang_pred", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_read(spark, sf_dir, "documents"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxsketch.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxent": op1_maxent,
    "op2_near_vectors": op2_near_vectors,
    "op3_repeats": op3_repeats,
    "op4_pack": op4_pack,
    "op5_main_text": op5_main_text,
    "op6_search": op6_search,
    "op7_mix": op7_mix,
    "op8_language": op8_language,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_runs": op11_runs,
    "op12_ranked": op12_ranked,
    "op13_best_fit": op13_best_fit,
}
ORACLES: dict[str, str] = {
    "op2_near_vectors": pivot_join.SQL,
    "op6_search": topk.SQL,
    "op7_mix": mixing.mix_sql(MIX_TARGETS),
    "op9_url_filter": urlfilter.filter_sql(URL_RULES),
    "op12_ranked": maxsketch.SQL,
}
