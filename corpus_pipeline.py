"""From raw documents to training pieces: toxicity, near duplicates, benchmark leaks, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next one. All but
the last return the columns of their input. A stage that removes rows decides by the text alone; where a text changes, n_chars follows.

Python workers live through all stages, and each keeps about the most it ever held. So a task has one Python step at a time, else an executor
keeps twice as many workers, and every stage sends small batches.

SQL can't express the stages, so ORACLE_SQL is None and tests compare them with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fst_pieces, noisy_toxicity, prob_minhash, secret_markov, wu_manber
from millrace.llm.common import free_name, small_batches, stored, table

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the cut-off. The classifier learns from the labelled rows of the training folds."""
    small_batches(spark)
    model, name = noisy_toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")), free_name("_toxicity", docs)
    return noisy_toxicity.score(docs, model, name).where(F.col(f"{name}.score") < noisy_toxicity.CUTOFF).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; rows without id stay, a repeated row stays once. Different texts of one id are documents of their
    own: all but the first by digest go by a large number in place of the id."""
    small_batches(spark)
    node, digest, least = (free_name(n, docs) for n in ("_node", "_digest", "_least"))
    named = docs.where("doc_id is not null")
    keyed = named.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias(digest))
    shared = stored(keyed.groupBy("doc_id").agg(F.min(digest).alias(least), F.max(digest).alias(digest)).where(F.col(least) != F.col(digest)).select("doc_id", least), "shared_ids")
    own = F.col("doc_id").cast("long")
    if not shared.isEmpty():  # else texts need not be moved to find the rows
        named = named.withColumn(digest, F.md5(F.coalesce("text", F.lit("")))).join(shared, "doc_id", "left")
        other = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", digest), F.lit(1 << 62))
        own = F.when(F.coalesce(F.col(digest) != F.col(least), F.lit(False)), other).otherwise(own)
    named = named.withColumn(node, own)
    groups = prob_minhash.near_duplicates(named.select(F.col(node).alias("doc_id"), "text"))
    gone = groups.where("doc_id <> group_id").select(F.col("doc_id").alias(node)).distinct()
    kept = named.join(gone, node, "left_anti").dropDuplicates([node]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    small_batches(spark)
    name = free_name("_leaks", docs)
    leaks = wu_manber.find_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), name)
    return leaks.where(F.size(f"{name}.hits") == 0).drop(name)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    small_batches(spark)
    name = free_name("_secrets", docs)
    found = secret_markov.find_secrets(docs, secret_markov.train(docs), name, mark=secret_markov.MARK)
    out = found.withColumn("text", F.col(f"{name}.redacted"))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(f"{name}.spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the piece ids, and whether decoding gives the normalised text back (which replace columns of these names)."""
    small_batches(spark)
    docs = docs.drop("n_pieces", "piece_ids", "round_trip")
    name = free_name("_pieces", docs)
    encoded = fst_pieces.encode(docs, name=name)
    return encoded.select(*docs.columns, F.size(f"{name}.ids").cast("long").alias("n_pieces"), F.col(f"{name}.ids").alias("piece_ids"),
                          F.col(f"{name}.round_trip").alias("round_trip"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
