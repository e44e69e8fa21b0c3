"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgefuse.llm import bpe, conversations, html_text, jaccard, mixing, perplexity, rules, substring, suffix_runs, toxicity, urls, vectors, whitening
from judgefuse.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages)


def op2_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return perplexity.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(toxicity.learnable()))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (~toxicity.learnable()).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


#: Token weights of the mixed corpus: trusted text by language, and a little of the rest.
MIX_TARGETS = {"en": 0.55, "de": 0.14, "fr": 0.14, "es": 0.14, "low": 0.03}


def mix_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows and their domain: the language of good text, else 'low'."""
    labels = table(spark, sf_dir, "labels").filter("quality in (0, 1)").select("doc_id", "quality")
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return labels.join(langs, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("lang"))
                                               .otherwise("low").alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.document_rates(docs, mix_labels(spark, sf_dir), MIX_TARGETS)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                    "base_failed", "distance", "kept")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(urls.captures_of(pages), urls.entries_of(pages))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_text(docs, tokenizer_path()))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.report(conversations.damage(rows), rows)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_runs.digests(suffix_runs.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_quality_perplexity, op3_toxicity, op4_mixing, op5_quality_rules,
    op6_embedding_near_dedup, op7_ngram_jaccard, op8_url_filter, op9_bpe, op10_substring_dedup,
    op11_conversation_repair, op12_embedding_whitening, op13_suffix_dedup)}
ORACLE_SQL = {"op6_embedding_near_dedup": vectors.NEAR_VECTORS_SQL, "op8_url_filter": urls.URL_FILTER_SQL}
