"""The queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, lm_score, mixing, near_dup, pii, quality_model, quality_rules, search, token_counts, token_files, warc, whitening
from .common import skew_join, stash, work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), out, tokenizer_path())
    return token_files.read_documents(spark, out)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2).drop("text_key")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, out = work_dir(spark, "arc"), work_dir(spark, "warc")
    warc.write_arc(_table(spark, sf_dir, "pages"), arcs)
    warc.convert(spark, arcs, out)
    rows = stash(warc.read_warc(spark, out), "warc-rows")
    to = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = rows.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long")).select(*out)
    return skew_join(rows.where("refers_to_id IS NOT NULL"), to, ["refers_to_id"], "left").select(*out).unionByName(own)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_score.lm_scores(_table(spark, sf_dir, "documents"), "crc32(cast(doc_id AS string)) % 7 != 2")
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of all documents under two tokenizers, deletes of the documents labelled
    toxic, and counts of the first tokenizer revised to those with an end id; two batches
    come twice, and the first ones are compacted in between."""
    files = {"word_bpe_49k": tokenizer_path(), "byte_bpe_50k": tokenizer_path("byte_bpe_50k.json")}
    keys = ["doc_id", "source", "lang"]
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    counts = stash(token_counts.token_lengths(_table(spark, sf_dir, "documents"), files, keys), "counts")
    gone = counts.join(toxic, "doc_id", "left_semi")
    left = counts.join(toxic, "doc_id", "left_anti")
    one = lambda rows, op, version, tokens=None, was=None: token_counts.changes(rows, op, version, F.col(version) if tokens is None else tokens, was)
    rollup = token_counts.Rollup(spark, work_dir(spark, "rollup"))
    batches = {
        "1-words": one(counts, "insert", "word_bpe_49k"),
        "2-bytes": one(counts, "insert", "byte_bpe_50k"),
        "3-toxic": one(gone, "delete", "word_bpe_49k").unionByName(one(gone, "delete", "byte_bpe_50k")),
        "4-revised": one(left, "revise", "word_bpe_49k", F.col("word_bpe_49k") + 1, F.col("word_bpe_49k")),
    }
    for name in ("1-words", "2-bytes", "2-bytes"):
        rollup.commit(name, batches[name])
    rollup.compact()
    for name in ("3-toxic", "1-words", "4-revised", "3-toxic"):
        rollup.commit(name, batches[name])
    return rollup.totals()


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_taken(_table(spark, sf_dir, "documents")).drop("source")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(_table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda x: x.k == n)).cast("long")
    return rows.select(
        "doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op11_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_fold = F.expr("crc32(cast(doc_id AS string)) % 5 = 0")
    rows = quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "crc32(cast(doc_id AS string)) % 5 != 0")
    return rows.select("doc_id", F.coalesce(in_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_main_text, op2_quality_rules, op3_token_files, op4_near_duplicates, op5_warc, op6_lm_scores, op7_token_counts, op8_mixture, op9_decontamination, op10_personal_data, op11_quality_scores, op12_ranked_search, op13_whitening)
}
