"""Token ids as Arrow files of equal-length sequences.

A folder holds, for each shard of a range of ``doc_id`` (or of a given number), ``shard-N.arrow`` (the
Arrow stream format with a footer: record batches of ``ids``, a fixed-size list
of ``seq_len`` unsigned integers, and ``mask``, a fixed-size list of booleans,
false on the padding of a shard's last sequence) and ``shard-N.docs.arrow``
(``doc_id``, ``start`` in the shard, ``n_tokens``), and once ``manifest.json``
with each shard's first place. Buffers aren't compressed, so a memory-mapped
file gives any sequence and mask without a copy.

Documents follow each other in ascending ``doc_id`` (null first; rows of one id
by a hash of their text), each followed by ``end_id``. One shuffle by ranges
deals the texts out; a shard is written as it is encoded, batch by batch, under
a name of its own attempt, and named when whole.

Edge cases: null or empty text is only its end id; repeated rows are encoded
each; an empty table gives a manifest without shards.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, normal_uri, partitions, put_file, slices

#: Sequences in a record batch.
BATCH = 64
#: Words whose ids a worker remembers.
MEMORY = 1_000_000


class WordEncoder:
    """Ids of whole texts. Of a tokenizer that never joins characters across a space or
    line feed the ids of a word are computed once and then looked up; whether it is one
    is tried on probes and on the first texts, and if not, whole texts are encoded.

    New words are encoded together, with a mark between them that is a token of its
    own; words that hold the mark are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        ids = {c: self._ids(c) for c in "§¶†‡€¤"}
        self.mark = next((c for c, x in ids.items() if len(x) == 1 and self._ids(f"a {c} b").tolist().count(x[0]) == 1), None)
        self.mark_id = ids[self.mark][0] if self.mark else None
        self._forget()
        self.by_word: bool | None = True
        probes = ["a b", " a", "a ", "the  cat\nsat\n\non it's 12 mats.", "x\t y", ""]
        self.by_word = self._agrees(probes) and None  # None: the first texts decide

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _agrees(self, texts: list[str]) -> bool:
        """Whether words give the ids of the whole texts."""
        return np.array_equal(self._by_word(texts)[0], self._whole(texts)[0])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _forget(self) -> None:
        fresh: list[str] = []

        class Places(dict):
            def __missing__(self, word: str) -> int:
                at = self[word] = len(self)
                fresh.append(word)
                return at

        self.places, self.fresh = Places(), fresh
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        if not self.fresh:
            return
        parts, length = [], np.zeros(len(self.fresh), np.int64)
        alone = [i for i, w in enumerate(self.fresh) if self.mark is None or self.mark in w]
        cuts = [-1, *alone, len(self.fresh)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo + 1:
                ids = self._ids(f" {self.mark} ".join(self.fresh[lo + 1 : hi]))
                at = np.flatnonzero(ids == self.mark_id)
                length[lo + 1 : hi] = np.diff(np.r_[-1, at, len(ids)]) - 1
                parts.append(ids[ids != self.mark_id])
            if hi < len(self.fresh):
                parts.append(self._ids(self.fresh[hi]))
                length[hi] = len(parts[-1])
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.flat = np.concatenate([self.flat, *parts])
        self.fresh.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if self.by_word is None and texts:
            self.by_word = self._agrees(texts[:20])
        return self._by_word(texts) if self.by_word else self._whole(texts)

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.places) > MEMORY:
            self._forget()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))  # at least 1: an empty text is one empty word
        codes = np.fromiter(map(self.places.__getitem__, (w for ws in split for w in ws)), np.int64, int(n_words.sum()))
        self._learn()
        length = self.length[codes]
        first = np.cumsum(length) - length
        ids = self.flat[np.repeat(self.start[codes] - first, length) + np.arange(int(length.sum()))]
        return ids, np.add.reduceat(length, np.cumsum(n_words) - n_words) if len(split) else np.empty(0, np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """The encoder of this worker process, which outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _schema(seq_len: int, dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


def write_token_files(docs: DataFrame, out: str, tokenizer: str, seq_len: int = 2048, end_id: int = 1, order: list[str] | None = None, shards: int | None = None, whole: bool = False) -> list[dict]:
    """Encode ``docs`` (``doc_id``, ``text``) into the folder ``out`` and return the
    manifest's shards. ``order``: columns to go by instead of ``doc_id``; ``whole``: the
    first of them numbers the shards, from 0."""
    out = normal_uri(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = encoder_for(tokenizer)
        dtype = np.uint16 if encoder.size <= 1 << 16 else np.uint32
        shard = TaskContext.get().partitionId()
        schema, step = _schema(seq_len, dtype), seq_len * BATCH
        index: list[tuple] = []
        at = 0

        def all_batches():
            yield first
            yield from batches

        def write(stream) -> None:
            nonlocal at
            with pa.ipc.new_file(stream, schema) as sink:

                def put(ids: np.ndarray, real: int) -> None:
                    mask = np.arange(len(ids)) < real
                    sink.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), seq_len) for x in (ids, mask)], schema=schema))

                rest = np.empty(0, dtype)
                for whole in all_batches():
                    for b in slices(whole, "text"):
                        ids, n = encoder.encode([t or "" for t in b.column("text").to_pylist()])
                        ids = np.insert(ids.astype(dtype), np.cumsum(n), end_id)
                        n = n + 1
                        start = at + np.cumsum(n) - n
                        index.append((b.column("doc_id"), start, n))
                        at += len(ids)
                        rest = np.r_[rest, ids]
                        while len(rest) >= step:
                            put(rest[:step], step)
                            rest = rest[step:]
                if len(rest):
                    put(np.r_[rest, np.zeros(-len(rest) % seq_len, dtype)], len(rest))

        put_file(f"{out}/shard-{shard:06d}.arrow", write)
        table = pa.table({"doc_id": pa.chunked_array([x[0] for x in index], pa.int64()), "start": np.concatenate([x[1] for x in index]), "n_tokens": np.concatenate([x[2] for x in index])})

        def write_index(stream) -> None:
            with pa.ipc.new_file(stream, table.schema) as sink:
                sink.write_table(table, max_chunksize=1 << 16)

        put_file(f"{out}/shard-{shard:06d}.docs.arrow", write_index)
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([at], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    order = order or ["doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.xxhash64("text").alias("_tie"))
    by = [f"_o{i}" for i in range(len(order))]
    if whole:
        last = rows.agg(F.max(by[0])).first()[0]
        dealt = rows.repartitionById(1 if last is None else last + 1, F.col(by[0]).cast("int"))
    else:
        dealt = rows.repartitionByRange(shards or partitions(docs.sparkSession), *by)
    dealt = dealt.sortWithinPartitions(*by, "_tie").select("doc_id", "text")
    found = dealt.mapInArrow(run, "shard long, n_docs long, n_tokens long").collect()  # a row a shard
    manifest, at = [], 0
    for r in sorted(found):
        manifest.append({"shard": r.shard, "start": at, "n_docs": r.n_docs, "n_tokens": r.n_tokens})
        at += r.n_tokens
    body = json.dumps({"seq_len": seq_len, "end_id": end_id, "n_tokens": at, "shards": manifest}).encode()
    put_file(f"{out}/manifest.json", lambda s: s.write(body))
    return manifest


class TokenFile:
    """Random access to the sequences of one shard."""

    def __init__(self, uri: str):
        fs, path = file_system(normal_uri(uri))
        source = pa.memory_map(path) if type(fs).__name__ == "LocalFileSystem" else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.seq_len = self.reader.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``; the ids are a view of the file."""
        b = self.reader.get_batch(i // BATCH)
        return b.column("ids")[i % BATCH].values.to_numpy(), b.column("mask")[i % BATCH].values

    def batches(self) -> Iterator[np.ndarray]:
        """The ids of all sequences in turn, padding included, batch by batch."""
        for i in range(self.reader.num_record_batches):
            yield self.reader.get_batch(i).column("ids").flatten().to_numpy()


def read_documents(spark: SparkSession, out: str, digest=None) -> DataFrame:
    """Read a folder back: ``doc_id, start`` (in all shards), ``n_tokens, ids_crc32``
    for each document, from its files."""
    out = normal_uri(out)
    fs, path = file_system(f"{out}/manifest.json")
    with fs.open_input_stream(path) as f:
        manifest = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                name = f"{out}/shard-{row['shard']:06d}"
                fs, path = file_system(f"{name}.docs.arrow")
                docs = pa.ipc.open_file(fs.open_input_file(path))
                parts = TokenFile(f"{name}.arrow").batches()
                have, at = np.empty(0, np.uint32), 0  # ids from place `at` on
                for i in range(docs.num_record_batches):
                    d = docs.get_batch(i)
                    starts, n = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = []
                    for s, k in zip(starts.tolist(), n.tolist(), strict=True):
                        while at + len(have) < s + k:
                            have, at = np.r_[have[s - at :], next(parts)], s
                        crc.append(zlib.crc32(have[s - at : s - at + k].astype("<u4").tobytes()))
                    yield pa.record_batch([d.column("doc_id"), pa.array(starts + row["start"]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(m["shard"], m["start"]) for m in manifest["shards"]], "shard long, start long")
    return rows.repartition(len(manifest["shards"])).mapInArrow(run, schema)
