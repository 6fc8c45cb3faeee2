"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.llm import ann, bpe_codec, branch_merge, filter_audit, language_id, lm_score, near_dedup, oracles, packing, pii, quality_model, quality_rules, sharding, url_filter
from quiltwork.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by 2-word shingles at a similarity of 0.8."""
    return near_dedup.group(table(spark, sf_dir, "documents"), width=2, threshold=80)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learned from two thirds of the rows."""
    docs = table(spark, sf_dir, "documents")
    part = language_id.remainder(F.col("doc_id"), 3)
    model = language_id.fit(docs.where(part != 1))
    out = language_id.predict(docs, model)
    return out.select("doc_id", (language_id.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and risk-controlled verdict of all texts."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 contiguous shards of near equal bytes."""
    return sharding.by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts."""
    return lm_score.score(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts and back."""
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts, learned from three quarters of the labelled rows."""
    docs = table(spark, sf_dir, "documents")
    out = quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))
    held = language_id.remainder(F.col("doc_id"), 4) == 2
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Base counts, the base spans' digest and all spans as text."""
    found = pii.find(docs)
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all texts."""
    return personal_data(table(spark, sf_dir, "documents"))


def op12_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches L and R of all documents, merged."""
    return branch_merge.merge(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over all documents, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_near_dedup, op2_ann, op3_language_id, op4_quality_rules, op5_sharding, op6_packing, op7_lm_score, op8_url_filter, op9_bpe, op10_quality_model, op11_pii, op12_branch_merge, op13_filter_audit)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
