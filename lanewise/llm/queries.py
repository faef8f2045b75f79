"""The registered queries of this subpackage, over whole tables with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import collocations, decontamination, divergence, html, licenses, mixing, neardup, pii, quality, spelling, tokens, topk, urls

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PII_KEY = "lanewise.pii.key"


def pii_key(spark: SparkSession) -> bytes:
    """The key of the session, where one is set; else a public one, good for tests only."""
    return (spark.conf.get(PII_KEY, None) or "not a secret").encode()


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which urls do rules and trees allow?"""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.filter_urls(pages, urls.UrlModel(urls.weak_labels(pages)))
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many greedy longest-match pieces is each document?"""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ten vectors are nearest to each query vector?"""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which licenses does each document name?"""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", *[f.name for f in licenses.FIELDS])


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents contain benchmark passages?"""
    found = decontamination.find_passages(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items_sha256",
        decontamination.is_contaminated().alias("contaminated"),
    )


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is each page's main text?"""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_text(pages, html.fit(pages)).select("row.page_id", "row.url", "text", "n_chars")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often does the mix take each document?"""
    report = mixing.mix_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data, and what was replaced."""
    done = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return done.select(
        "row.doc_id",
        F.col("new_text").alias("text"),
        F.size("kinds").cast("long").alias("n_replaced"),
        F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"),
    )


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are near duplicates, and how many others is each linked to?"""
    joined = neardup.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "class_id", "n_links", "n_texts")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents read like trusted text of their language?"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "row.lang", "n_grams", "perplexity", "least", "most", "keep")


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are written like the others of their language?"""
    judged = divergence.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words are one letter away from a far more frequent one?"""
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents")))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phrases of two or three words stick together most in each language?"""
    return collocations.collocations(table(spark, sf_dir, "documents"))
