"""Binary files of token ids with a minimal perfect hash index.

A shard file holds, after a fixed header: the ids of its documents one after the other
(little-endian, two bytes each where the vocabulary allows), the documents' keys in order,
and an index from key to place: the bit sets of a minimal perfect hash, and for each of its
slots a stored fingerprint, the place of the document's first id, and the number of ids.
A lookup costs the same at any shard size; a key that isn't there fails by its fingerprint.

Documents are dealt to shards by ranges of doc_id, of which no range outgrows a task; every
shard is written by Spark's own committer, so lost executors leave no half file.  Null
texts count as empty; null ids come first; repeated ids are keyed by their occurrence.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.encoding import encoder
from corpuscle.llm.perfect_hash import PerfectHash, hashed
from corpuscle.llm.support import bounded_batches, id_and_text, mixed, new_path, written

MAGIC = b"TOKSHRD1"
HEADER = struct.Struct("<8sQQQQIIQ")  # magic, all bytes, part, number in the part, ids, id width, levels, documents
NULL_ID = -(1 << 63)
SHARD_BYTES = 16 << 20
TASK_BYTES = 24 << 20
_RECORD = np.dtype([("print", "<u8"), ("start", "<u8"), ("count", "<u8")])


def _key_hash(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(ids.astype(np.int64).view(np.uint64) + mixed(nth.astype(np.uint64)))


def _print(keys: np.ndarray) -> np.ndarray:
    return hashed(keys, 1000)


def occurrences(ids: np.ndarray) -> np.ndarray:
    """For each of the sorted ids, how many equal ones stand before it."""
    if not len(ids):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    at = np.arange(len(ids))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def pack_shard(part: int, number: int, ids: list[int], first_nth: int, payloads: list[bytes], width: int) -> bytes:
    keys = np.asarray(ids, np.int64)
    nth = occurrences(keys)
    nth[keys == keys[0]] += first_nth
    hashes = _key_hash(keys, nth)
    index = PerfectHash.build(hashes)
    counts = np.asarray([len(p) // width for p in payloads], np.int64)
    records = np.zeros(len(keys), _RECORD)
    slot = index.slots(hashes)
    records["print"][slot], records["start"][slot], records["count"][slot] = _print(hashes), np.cumsum(counts) - counts, counts
    body = b"".join([*payloads, keys.astype("<i8").tobytes(), nth.astype("<i8").tobytes(), np.asarray(index.sizes, "<u8").tobytes(), index.words.astype("<u8").tobytes(), records.tobytes()])
    return HEADER.pack(MAGIC, HEADER.size + len(body), part, number, int(counts.sum()), width, len(index.sizes), len(keys)) + body


class Shard:
    """Keyed access to a shard's bytes."""

    def __init__(self, data: bytes) -> None:
        magic, self.size, self.part, self.number, self.n_ids, width, levels, n = HEADER.unpack_from(data)
        if magic != MAGIC or self.size > len(data):
            raise ValueError("not a whole shard")
        at = HEADER.size

        def take(kind: str | np.dtype, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.ids = take(f"<u{width}", self.n_ids)
        self.keys, self.nth = take("<i8", n), take("<i8", n)
        sizes = take("<u8", levels)
        self.index = PerfectHash(sizes.astype(np.int64).tolist(), take("<u8", int(sizes.sum()) // 64))
        self.records = take(_RECORD, n)

    def find(self, keys: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and count of each key's ids; count -1 where the shard doesn't have the key."""
        hashes = _key_hash(keys, nth)
        slot = self.index.slots(hashes)
        found = self.records[np.maximum(slot, 0)] if len(self.records) else np.zeros(len(keys), _RECORD)
        good = (slot >= 0) & (found["print"] == _print(hashes))
        return found["start"].astype(np.int64), np.where(good, found["count"].astype(np.int64), -1)


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> None:
    """Write the ids of every text, each followed by ``end_id``, as shards under ``path`` in ascending doc_id order."""
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), docs.sparkSession.sparkContext.defaultParallelism if size > 8 * SHARD_BYTES else 1)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        end = np.asarray([end_id], words.kind).tobytes()
        part, number, held, ids, payloads = TaskContext.get().partitionId(), 0, 0, [], []
        last, nth = None, 0  # of the last shard: its last id, and how often that id has come

        def out() -> pa.RecordBatch:
            nonlocal number, held, last, nth
            shard = pack_shard(part, number, ids, nth if ids[0] == last else 0, payloads, words.width)
            same = sum(1 for i in ids if i == ids[-1])
            nth = same + (nth if ids[-1] == last else 0)
            last, number, held = ids[-1], number + 1, 0
            ids.clear()
            payloads.clear()
            return pa.record_batch({"value": pa.array([shard], pa.binary())})

        for batch in batches:
            for i, found in zip(batch.column(0).to_pylist(), words.in_steps(batch.column(1))):
                ids.append(NULL_ID if i is None else i)
                payloads.append(found.tobytes() + end)
                held += len(payloads[-1])
                if held >= SHARD_BYTES:
                    yield out()
        if ids:
            yield out()

    # Equal ids may straddle two tasks: the key's occurrence then starts again, and the part tells them apart.
    dealt = rows.repartitionByRange(tasks, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    dealt.mapInArrow(shards, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Of every document in the shards: its place in the whole, its number of ids, and their checksum.

    Each row is found through its shard's index.  Columns: doc_id, start, n_tokens, ids_crc32.
    """
    bounded_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = Shard(data.as_py())
                start, count = s.find(s.keys, s.nth)
                if (count < 0).any():
                    raise ValueError(f"shard {s.part}-{s.number}: a key isn't in its index")
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a : a + n]) for a, n in zip(start.tolist(), count.tolist())]
                yield pa.record_batch({
                    "doc_id": pa.array(s.keys, pa.int64(), mask=s.keys == NULL_ID), "part": pa.array([s.part] * len(crc), pa.int64()), "number": pa.array([s.number] * len(crc), pa.int64()),
                    "start": pa.array(start, pa.int64()), "n_tokens": pa.array(count, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = written(files.mapInArrow(parse, "doc_id long, part long, number long, start long, n_tokens long, ids_crc32 long"), "shard-rows")
    # One row for each shard, so the running sum is over a short table.
    base = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    base = base.select("part", "number", (F.sum("n").over(Window.orderBy("part", "number")) - F.col("n")).alias("base"))
    return rows.join(base, ["part", "number"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the shards of ``docs`` in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-shards")
    write_shards(docs, tokenizer_path, path, end_id)
    return read_shards(docs.sparkSession, path)
