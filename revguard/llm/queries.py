"""Registered queries of the text operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revguard.llm import (collocations, decontam_tiling, html_extract, oracle, packing, quality_mcd, secret_scan, simhash,
                          suffix_dedup, token_rollup, token_store, url_filter, vector_codes, version_sketch)
from revguard.llm.common import new_folder, read_table
from revguard.llm.tokens import word_tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"), word_tokenizer_path())


@register
def op5_token_store(spark, sf_dir):
    folder = new_folder(spark, "token-store")
    token_store.write_store(read_table(spark, sf_dir, "documents", "doc_id", "text"), folder, word_tokenizer_path())
    return token_store.read_store(spark, folder, with_ids=False)


@register
def op10_simhash(spark, sf_dir):
    found = simhash.clustered(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op4_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.without_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register
def op2_quality_mcd(spark, sf_dir):
    found = quality_mcd.judged(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return found.select("doc_id", *quality_mcd.STATS, "base_failed", "kept")


@register
def op8_secret_scan(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_sample(docs)))
    counts = [F.size(F.filter("base", lambda s: s["rank"] == F.lit(rank))).cast("long").alias(f"n_{kind}")
              for rank, kind in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.as_text(F.col("spans")).alias("spans"))


@register
def op9_decontam_tiling(spark, sf_dir):
    found = decontam_tiling.contaminated(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                                         read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile", "coverage")


@register
def op1_html_extract(spark, sf_dir):
    return html_extract.extracted(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@register
def op6_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_TYPE)
    found = url_filter.judged(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


@register
def op7_token_rollup(spark, sf_dir):
    store = new_folder(spark, "token-rollup")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    for batch_id, changes in token_rollup.corpus_changes(docs):
        token_rollup.commit(changes, store, batch_id)
        if batch_id == 2:
            token_rollup.commit(changes, store, batch_id)  # a replay counts once
        if batch_id == 3:
            token_rollup.compact(spark, store, 2)
    return token_rollup.totals(spark, store)


@register
def op11_collocations(spark, sf_dir):
    return collocations.collocations(read_table(spark, sf_dir, "documents", "lang", "text"))


@register
def op12_version_sketch(spark, sf_dir):
    return version_sketch.fingerprinted(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op13_vector_codes(spark, sf_dir):
    return vector_codes.coded(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


ORACLE.update({"op2_quality_mcd": oracle.QUALITY, "op6_url_filter": oracle.url_filter(URL_RULES),
               "op7_token_rollup": oracle.ROLLUP, "op8_secret_scan": oracle.SECRETS,
               "op11_collocations": oracle.COLLOCATIONS, "op13_vector_codes": oracle.vector_codes()})
