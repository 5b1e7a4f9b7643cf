"""The corpus pipeline: five stages over documents, each written as Parquet before the next reads it.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents (doc_id, text, lang, source, n_chars); extra columns pass through, whatever their names.

Edge cases, in all stages: an empty table gives an empty result; doc_id, lang and source may be null, and null and empty
texts have no words. By stage: texts without 20 words go in the first, so null and empty ones do; rows that repeat another
as a whole go in the second, as do all documents of a component but that of smallest id (a component without ids keeps one
row of each text that is smallest); equal windows are cut from all but the smallest id, and rows that share id and text are cut
alike; a document without words is never contaminated; the encoding of a null text is that of the empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from retroledger.llm import bpe, common, decontaminate, rules, simhash, substring

#: SimHash and decontamination cannot be written in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the hard rules and are no outlier of their language and source."""
    return rules.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component; rows that repeat it as a whole go too."""
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words that repeat an earlier window; documents that lose none keep their text as it is. A document that loses
    all words stays, with an empty text."""
    own = {c: f"_own_{c}" for c in docs.columns if c in substring.ADDED}
    cut = substring.deduplicate(docs.withColumnsRenamed(own))
    changed, kept = F.col("n_removed") > 0, F.col("kept_text")
    new = {"text": F.when(changed, kept).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*(new.get(c, F.col(own.get(c, c))).alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the contamination rule marks."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    read = bpe.encode(docs.select("doc_id", "text"), path, decoded_to="decoded")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encode", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
        if k > 0 and k < len(STAGES) - 1:
            common.forget(before)
    return docs
