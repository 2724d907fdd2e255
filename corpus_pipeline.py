"""The corpus pipeline: quality rules, near-duplicate removal, benchmark
decontamination, mixing to target weights, token files.

Each stage takes ``(spark, docs, sf_dir)``: ``docs`` is what the stage before it
returned, written and read again. All but the last return the columns of
``documents``, the mixture also where each row stands in it.

Edge cases: a null, empty or wordless text fails the base rule of the first stage; in
the second it is in no group and stays, rows equal in id and text stay once, and rows
that only share an id, or have none, stay apart; in the third it has no passage and
stays; in the mixture it isn't. Null ids and sources are kept as they are; a table
without rows gives none in each stage; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverseed.llm import decontaminate, mixing, near_dup, quality_rules, token_files
from riverseed.llm.common import stash, work_dir
from riverseed.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Where a row stands in the mixture.
PLACE = ["shard", "slot", "place"]
#: Words in a block of the mixture.
BLOCK_WORDS = 512


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, _ = quality_rules.quality(docs, labels, keep=COLUMNS)
    return rows.where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, 0.8): that of the
    smallest ``doc_id`` (null last) and then ``text_key``. Rows that share an id, or have
    none, are as good as any others; rows without words are in no group and stay."""
    least, repeated = near_dup.least_of_groups(docs)
    least = least.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    one = rows.where(worded).join(least, F.expr("doc_id <=> _id AND text_key = _key"), "left_semi")
    one = one.dropDuplicates(["doc_id", "text_key"]) if repeated else one
    return one.unionByName(rows.where(~worded)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    return rows.join(stash(hit, "hit"), F.expr("doc_id <=> _id AND text_key = _key"), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source: a row for each document's share of each block taken, and
    where in the mixture it stands."""
    return mixing.mix_documents(docs.select(*COLUMNS), block_words=BLOCK_WORDS).select(*COLUMNS, *PLACE)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as token files, one for each of its shards and in its order, and what
    they hold: a row for each of its rows."""
    out = work_dir(spark, "pipeline-tokens")
    token_files.write_token_files(docs, out, tokenizer_path(), order=mixing.ORDER, whole=True)
    return token_files.read_documents(spark, out)


STAGES = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token files", token_stage),
]

#: Learned rules, permutations and a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
