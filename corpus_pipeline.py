"""A corpus from raw documents to packed sequences: rules, classifier, near duplicates, passages, packing.

Every stage takes all that its predecessor kept and does what it decides; all but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import common, near_dedup, packing, quality_classifier, quality_rules, substring_dedup

#: SQL has no model or tokenizer: the stages are tested against brute-force versions.
ORACLE_SQL = None


def _with(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], made: list[str], then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """then(operator(docs)) with the columns of docs; those with the names `made` step aside meanwhile."""
    aside = {x: f"_aside_{x}" for x in docs.columns if x in made}
    out = then(operator(docs.withColumnsRenamed(aside)))
    return out.select(*(F.col(aside.get(x, x)).alias(x) for x in docs.columns))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]
    return _with(docs, quality_rules.quality_rules, made, lambda out: out.where("kept"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, predicts to be good; all of them where there
    are too few labels, or only of one kind, to train one."""
    known = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not known.net.fitted:
        return docs
    return _with(docs, lambda x: quality_classifier.score(x, known), ["held_out", "score", "predicted"], lambda out: out.where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id (of several texts under it, the least by
    digest; of equal rows, one). Rows that share a doc_id but not a text are judged each by its own text. Rows without doc_id or
    without words stay."""
    kept = near_dedup.near_dedup(docs, percent=80).where("first and n_shingles > 0 and doc_id is not null")
    kept = common.materialize(kept.select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).distinct())
    rows = docs.withColumns({"_kept_id": F.col("doc_id").cast("long"), "_kept_digest": near_dedup.digest_of(F.col("text"))})
    one = rows.join(kept, ["_kept_id", "_kept_digest"], "left_semi").dropDuplicates(["_kept_id", "_kept_digest"])
    loose = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return one.select(*docs.columns).unionByName(loose)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those without a repeat keep their text as it is."""
    def then(out: DataFrame) -> DataFrame:
        new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return out.withColumns(new)

    return _with(docs, substring_dedup.substring_dedup, ["n_words", "n_removed", "kept_text"], then)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the documents in sequences of at most 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near duplicates", near_duplicates), ("repeated passages", passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
