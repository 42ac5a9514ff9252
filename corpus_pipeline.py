"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and gives a DataFrame;
all but the last give the columns of documents.

In every stage, rows without doc_id or text stay as they are up to packing, which leaves out rows without
doc_id; repeated rows share the fate of their doc_id; an empty table gives an empty table; columns beside
those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import jaccard, leaks, packing, store, suffix, toxicity

#: Ids that may be broadcast (16 MB); beyond, the same join shuffles.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among ids."""
    ids = ids.select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on the labels that are not held out does not reject. Empty texts stay."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, the one of the least doc_id.

    Empty texts are copies of nothing and stay.
    """
    base = store.scratch(spark, "jaccard")
    found = store.save(jaccard.jaccard_components(docs, k=5, num=4, den=5, base=base), store.scratch(spark, "groups"))
    store.remove(spark, base)
    return _without(docs, found.filter("component_id <> doc_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a 50-byte string of a smaller doc_id covers.

    Characters of which only a part stayed go too; n_chars follows the text. Rows without doc_id cannot be
    compared by it and stay as they are; a null text becomes an empty one.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    base = store.scratch(spark, "suffix")
    found = store.save(suffix.dedup_substrings(docs, carry=others, as_text=True, base=base), store.scratch(spark, "kept"))
    store.remove(spark, base)
    found = found.withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text"))
    kinds = docs.schema
    return found.select(*(F.col(c).cast(kinds[c].dataType).alias(c) for c in docs.columns)).unionByName(docs.filter("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Empty texts hold none and stay."""
    return _without(docs, leaks.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' ids, packed into windows of up to 2048. Null texts are empty; rows without doc_id are left out."""
    return packing.pack_documents(docs, "word_bpe_49k.json", end_id=1)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("benchmark_decontamination", drop_leaks), ("packing", pack)]

#: SQL can express neither a trained classifier nor a tokenizer; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = store.scratch(spark, "pipeline"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = f"{base}/{number}-{name}"
            docs = store.save(docs, path)
            if before:
                store.remove(spark, before)
            before = path
    return docs
