"""Token counts kept by signed changes.

A change is ``(op, doc_id, source, lang, version, tokens, was)``: an insert adds a
document with ``tokens``, a delete takes one away, a revision replaces ``was`` by
``tokens``. A batch of changes is summed once into signed totals by source,
language and tokenizer version and written as the batch's folder. A batch is
committed by a marker file of its name; a batch that is already committed is
left alone, and an uncommitted folder (a lost driver's) is written anew and isn't
read. Totals are the sums over committed batches: additive, so batches may come
in any order. Compaction sums the committed batches into one folder and names them
in a file of its own; from then on that folder is read in their place, and their
names stay committed. Whether a reader sees the file or not, the totals are equal.

Counts come from tokenizer files: :func:`token_lengths` encodes whole texts.

Edge cases: null source, language or version are groups of their own; a null
count is 0, so is that of a null or empty text; an unknown ``op`` is an error; groups
that fall to no documents and no tokens are left out of the totals; repeated rows
count each; an empty batch commits and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, normal_uri, put_file, slices
from .token_files import WordEncoder

KEYS = ("source", "lang", "version")
DOUBLE = re.compile(r"\s\s")
CHANGES = "op string, doc_id long, source string, lang string, version string, tokens long, was long"


def signed(changes: DataFrame) -> DataFrame:
    """The signed totals of a batch of changes, pre-aggregated before the shuffle."""
    new, old = F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("was"), F.lit(0))
    bad = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("null"))))
    docs = F.when(F.col("op") == "insert", F.lit(1)).when(F.col("op") == "delete", F.lit(-1)).when(F.col("op") == "revise", F.lit(0)).otherwise(bad.cast("int"))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """Totals in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, normal_uri(folder)

    def _files(self, what: str) -> list[str]:
        from pyarrow import fs as afs

        fs, path = file_system(f"{self.folder}/{what}")
        files = fs.get_file_info(afs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in files if f.type == afs.FileType.File and not f.base_name.startswith("_"))

    def _compacted(self) -> dict:
        """The folder of the last compaction and the batches that it holds."""
        found = self._files("_compactions")
        if not found:
            return {"folder": None, "batches": []}
        fs, path = file_system(f"{self.folder}/_compactions/{found[-1]}")
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def committed(self) -> list[str]:
        return self._files("_commits")

    def compact(self) -> None:
        """Sum the committed batches into one folder that is read instead of them."""
        done, number = self.committed(), len(self._files("_compactions"))
        folder = f"compact-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.folder}/{folder}")
        body = json.dumps({"folder": folder, "batches": done}).encode()
        put_file(f"{self.folder}/_compactions/{number:08d}-{folder}", lambda s: s.write(body))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.committed():
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        put_file(f"{self.folder}/_commits/{batch}", lambda s: s.write(b""))
        return True

    def totals(self) -> DataFrame:
        old = self._compacted()
        fresh = sorted(set(self.committed()) - set(old["batches"]))
        folders = [*filter(None, [old["folder"]]), *[f"batch-{b}" for b in fresh]]
        schema = "source string, lang string, version string, docs long, tokens long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{x}" for x in folders])
        return parts.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")).where("docs != 0 OR tokens != 0")


def changes(rows: DataFrame, op: str, version: str, tokens: Column, was: Column | None = None) -> DataFrame:
    """Changes of one kind for ``rows`` (``doc_id``, ``source``, ``lang``)."""
    old = F.lit(None).cast("long") if was is None else was.cast("long")
    return rows.select(F.lit(op).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"), tokens.cast("long").alias("tokens"), old.alias("was"))


#: Pieces of texts whose lengths a worker remembers.
MEMORY = 500_000
_COUNTERS: dict = {}


class TokenCounter:
    """Numbers of tokens of whole texts, the fastest way that gives a tokenizer's own numbers:
    by words, if it never joins across white space; by pieces that begin with a space, if
    it joins a space only to what follows (texts with two white-space characters in a row
    are encoded whole); or all texts whole. Which one is tried on probes and on the first
    texts. Pieces are encoded once and then looked up."""

    def __init__(self, path: str):
        self.words = WordEncoder(path)  # its own: a setting of the tokenizer changes below
        self.tokenizer = self.words.tokenizer
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lengths: dict[str, int] = {}
        self.by_piece = self._agrees(["a b", " a", "a ", "the cat\nsat on it's 12 mats.", "x\ty", "é ü", ""])
        self.tried = False

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _agrees(self, texts: list[str]) -> bool:
        return self._by_piece(texts) == self._whole(texts)

    def _by_piece(self, texts: list[str]) -> list[int]:
        if len(self.lengths) > MEMORY:
            self.lengths = {}
        split = [None if DOUBLE.search(t) else t.replace(" ", "\x00 ").split("\x00") if "\x00" not in t else None for t in texts]
        fresh = list({p for ps in split if ps for p in ps if p not in self.lengths})
        self.lengths.update(zip(fresh, self._whole(fresh), strict=True))
        get = self.lengths.__getitem__
        whole = iter(self._whole([t for t, ps in zip(texts, split, strict=True) if ps is None]))
        return [next(whole) if ps is None else sum(map(get, ps)) for ps in split]

    def count(self, texts: list[str]) -> list[int]:
        n = self.words.encode(texts)[1].tolist() if self.words.by_word is not False else None
        if self.words.by_word:
            return n
        if not self.tried and texts:
            self.tried, self.by_piece = True, self.by_piece and self._agrees(texts[:20])
        return self._by_piece(texts) if self.by_piece else self._whole(texts)


def counter_for(path: str) -> TokenCounter:
    """The counter of this worker process, which outlives a task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_lengths(docs: DataFrame, tokenizers: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row and the number of tokens of its whole ``text`` by
    each tokenizer, ``{name: path of its file}``, as columns of those names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                texts = [t or "" for t in b.column("_text").to_pylist()]
                n = [pa.array(counter_for(p).count(texts), pa.int64()) for p in tokenizers.values()]
                yield pa.record_batch([*[b.column(c) for c in keep], *n], names=[*keep, *tokenizers])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = rows.select(*keep).schema
    for name in tokenizers:
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)
