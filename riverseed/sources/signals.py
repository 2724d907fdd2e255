"""Readers of signals, sequences, pore models and mappings into plain tables.

Binary signal files (FAST5, POD5, BLOW5) need libraries that are not here; stage them as
Parquet of ``read_id, raw, digitisation, range, offset`` and use ``staged``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name endings by format.
FORMATS = {".fast5": "fast5", ".pod5": "pod5", ".pod": "pod5", ".slow5": "slow5", ".blow5": "blow5", ".parquet": "parquet"}


def format_of(path: str) -> str:
    """The format that a file's name tells; an error names the ones known."""
    name = os.path.basename(path.rstrip("/")).lower()
    for end, kind in FORMATS.items():
        if end in name:
            return kind
    raise ValueError(f"no signal format in {name!r}; known are {', '.join(FORMATS)}")


def calibrated(raw: Column, scale: Column, offset: Column, low: float = 30.0, high: float = 200.0, whole: bool = False) -> Column:
    """Samples ``(raw + offset) * scale`` strictly between the limits; ``whole`` cuts them
    to integers first, as files that keep calibrated samples in 16 bits do."""
    value = lambda x: (x + offset) * scale
    level = F.transform(raw, lambda x: value(x).cast("int").cast("double") if whole else value(x))
    return F.filter(level, lambda x: (x > low) & (x < high))


def staged(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``(read_id, signal)`` of staged Parquet files, in folders below ``path`` too."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.select("read_id", calibrated(F.col("raw"), F.col("range") / F.col("digitisation"), F.col("offset"), whole=whole).alias("signal"))


def slow5(spark: SparkSession, path: str) -> DataFrame:
    """``(read_id, signal)`` of SLOW5 text files. Header lines start with # or @; columns
    go by the first eight, which the format fixes."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.slow5").text(path)
    c = F.split("value", "\t")
    rows = rows.where(~F.col("value").rlike("^[#@]") & (F.trim("value") != "")).select(F.get(c, 0).alias("read_id"), *[F.get(c, i).cast("double").alias(n) for i, n in ((2, "digitisation"), (3, "offset"), (4, "range"))], F.split(F.get(c, 7), ",").cast("array<double>").alias("raw"))
    return rows.select("read_id", calibrated(F.col("raw"), F.col("range") / F.col("digitisation"), F.col("offset")).alias("signal"))


def samples(reads: DataFrame, key: str = "read_id") -> DataFrame:
    """``(read_id, pos, pa)`` rows of ``signal`` arrays."""
    return reads.select(F.col(key).alias("read_id"), F.posexplode("signal").alias("pos", "pa"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(name, comment, text)`` of FASTA files, gzip too: a record is what lies between
    line starts ``>``, so that long sequences are one row; U becomes T."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.expr(r"substring(v, length(regexp_extract(v, '^([^\\r\\n]*)', 1)) + 1)"), r"\s", "")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), F.translate(body, "Uu", "Tt").alias("text"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """``(name, comment, text, qual)`` of four-line FASTQ files. Records are cut where ``@``
    follows a line break, so that a file is read in splits. A quality line that starts with
    ``@`` comes out as a piece of its own, which the piece before it, lacking one, is joined
    to; at a split's end that is the first piece of the next split."""
    w = Window.partitionBy("file", "block").orderBy("at")
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("length")]
    lines = F.split(F.regexp_replace("value", r"[\r\n]+\z", ""), r"\r?\n")
    rows = spark.read.option("lineSep", "\n@").text(path).select(*block, F.monotonically_increasing_id().alias("at"), lines.alias("c")).where("c[0] <> '' OR size(c) > 1")
    first = rows.groupBy("file", "block").agg(F.min_by(F.get("c", 0), "at").alias("across")).withColumnRenamed("block", "end")
    rows = rows.withColumns({"next": F.lead(F.get("c", 0)).over(w), "end": F.col("block") + F.col("length"), "begins": (F.col("block") == 0) & F.lag("at").over(w).isNull()}).where("size(c) >= 3").join(first, ["file", "end"], "left")
    c = lambda i: F.get("c", i)
    qual = F.when(F.size("c") >= 4, c(3)).otherwise(F.concat(F.lit("@"), F.coalesce("next", "across")))
    head = F.when(F.col("begins"), F.regexp_replace(c(0), "^@", "")).otherwise(c(0))  # only a file's first @ is left
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), F.translate(c(1), "Uu", "Tt").alias("text"), qual.alias("qual"))


def pore_model(spark: SparkSession, path: str, level_column: int = 1) -> DataFrame:
    """``(kmer, code, level)`` of a pore model: tab-separated, an optional header line that
    starts with kmer. Codes are base-4 numbers of the k-mers; levels are z-scored."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("(?i)^(kmer|#)") & (F.trim("value") != "")).select(F.get(c, 0).alias("kmer"), F.get(c, level_column).cast("double").alias("x"))
    code = F.conv(F.translate(F.upper("kmer"), "ACGTU", "01233"), 4, 10).cast("long")
    stats = rows.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    return rows.select("kmer", code.alias("code"), ((F.col("x") - F.lit(stats.m)) / F.lit(stats.s)).alias("level"))


def paf(spark: SparkSession, path: str) -> DataFrame:
    """The twelve columns and the tags of PAF files; ``*`` is null."""
    c = F.split("value", "\t")
    kinds = {"qid": "string", "q_len": "long", "qs": "long", "qe": "long", "strand": "string", "tid": "string", "t_len": "long", "rs": "long", "re": "long", "n_match": "long", "block_len": "long", "mapq": "int"}
    cols = [F.when(F.get(c, i) != "*", F.get(c, i)).cast(t).alias(n) for i, (n, t) in enumerate(kinds.items())]
    tag = lambda name, kind: F.expr(f"try_cast(nullif(regexp_extract(value, '\\\\t{name}:[a-zA-Z]:([^\\\\t]*)', 1), '') AS {kind})").alias(name)
    return spark.read.text(path).where("trim(value) <> ''").select(*cols, *[tag(n, k) for n, k in (("mt", "double"), ("ci", "int"), ("sl", "int"), ("cm", "int"), ("nc", "int"), ("s1", "int"))])


def write_paf(lines: DataFrame, path: str) -> None:
    """PAF ``line`` rows as text files."""
    lines.select("line").write.text(path)
