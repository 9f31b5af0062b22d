"""The subpackage's queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, exact_dedup, html_text, language, license_scan, mixing, ngram_join, pii, token_files, url_filter
from graphloom.llm.oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.license_matches(_read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_files.token_counts(_read(spark, sf_dir, "documents"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.apply_rules(_read(spark, sf_dir, "pages"), rules)


def op5_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return language.identify_documents(docs, language.fit(docs))


def op5_language_id_pages(spark, sf_dir):
    """The same operator where markup, address suffix and host are at hand."""
    from pyspark.sql import functions as F

    pages, model = _read(spark, sf_dir, "pages"), language.fit(_read(spark, sf_dir, "documents"))
    host, _ = url_filter.host_and_path(F.coalesce(F.col("url"), F.lit("")))
    text = html_text.extract_text(pages).select("page_id", F.col("text").alias("body"))
    pages = pages.select("page_id", host.alias("host"), language.markup_language(F.col("html")).alias("markup")).join(text, "page_id")
    found = language.identify(pages, model, "page_id", "body", declared=F.col("markup"), host=F.col("host"), suffix=F.substring_index("host", ".", -1))
    return found.withColumnRenamed("id", "page_id")


def op6_decontamination(spark, sf_dir):
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark, sf_dir):
    return html_text.extract_text(_read(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark, sf_dir):
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), words=3, percent=90)


def op9_mixing(spark, sf_dir):
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.digest(pii.find_spans(_read(spark, sf_dir, "documents")))


def op10_pii_sanitised(spark, sf_dir):
    """The texts that the operator gives out."""
    return pii.sanitise(_read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_exact_dedup, op3_token_counts, op4_url_filter, op5_language_id, op5_language_id_pages,
        op6_decontamination, op7_html_extraction, op8_ngram_jaccard, op9_mixing, op10_pii, op10_pii_sanitised, pipeline,
    )
}
