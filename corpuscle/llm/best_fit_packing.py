"""Best-fit-decreasing packing of token pieces, certified by dual feasible functions.

Documents longer than a sequence are cut into full pieces, which fill sequences of their
own; the remaining pieces are dealt to partitions of bounded size and packed there by
best-fit decreasing.  Lower bounds from dual feasible functions over a partition's lengths
certify its number of bins.  Partitions with a gap between bins and bound give the
documents of their underfull bins to an exchange, where best-fit decreasing runs again over
fewer partitions, until the whole meets the bound over all lengths, nothing is left to
exchange, or four rounds are over.  ``pack_pieces`` also returns what each round reached and
the bound; ``packing_report`` counts a result's sequences against their volume.

Null texts count as empty (one end token); repeated rows are pieces of their own; empty
tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.encoding import encoder
from corpuscle.llm.support import bounded_batches, id_and_text, written

PARTITION_PIECES = 20_000
ROUNDS = 4
THRESHOLDS = 64


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Least number of bins for ``counts[l]`` pieces of each length l, by dual feasible functions.

    Each function f maps lengths so that no full bin exceeds 1; the sum of f over all pieces
    then bounds the bins.  Used are the identity, rounding by k (f(l) = floor((k + 1) l / size) / k
    unless that is whole) and cuts at t (l > size - t counts 1, l < t counts 0), alone and composed.
    """
    lengths = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * lengths).sum()) // size)
    cuts = sorted({0, *np.linspace(1, size // 2, THRESHOLDS, dtype=np.int64).tolist()})
    for t in cuts:
        cut = np.where(lengths > size - t, size, np.where(lengths < t, 0, lengths))
        best = max(best, -(-int((counts * cut).sum()) // size))
        for k in (1, 2, 3, 4, 5):
            up = (k + 1) * cut
            scaled = np.where(up % size == 0, cut * k, up // size * size)  # k * size * f
            best = max(best, -(-int((counts * scaled).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length, by best-fit decreasing, and the bins' free space."""
    order = np.argsort(-lengths, kind="stable")
    bins, free, at, occupied = np.zeros(len(lengths), np.int64), [], [[] for _ in range(size + 1)], 0
    for i in order.tolist():
        need = int(lengths[i])
        fit = occupied >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                occupied &= ~(1 << room)
        else:
            b, room = len(free), size
            free.append(size)
        bins[i], free[b] = b, room - need
        at[room - need].append(b)
        occupied |= 1 << (room - need)
    return bins, np.asarray(free, np.int64)


def pieces_of(docs: DataFrame, tokenizer_path: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document, and ``item``, unique to the row."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, found in zip(batch.column(0).to_pylist(), words.in_steps(batch.column(1))):
                ids = np.append(found.astype("<u4"), np.uint32(end_id))
                for k, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    rows.append((doc, k, start, len(part), zlib.crc32(part)))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch({n: pa.array([r[c] for r in rows], kind) for c, (n, kind) in enumerate(zip(names, kinds))})

    found = id_and_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return written(found.withColumn("item", F.monotonically_increasing_id()), "pieces")


def _pack_groups(size: int) -> object:
    """Best-fit decreasing of a partition, its bound, and which bins it gives to the exchange.

    A partition with a gap gives all bins that lack more than a 256th; a certified one only
    bins that lack more than an eighth, which others may fill up.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, free = best_fit(lengths, size)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(lengths[order])
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]]) if len(order) else np.zeros(0, bool)
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        gap = len(free) - bound
        tolerance = size // 256 if gap else size // 8
        return pd.DataFrame({"item": group["item"], "length": lengths, "part": group["part"], "bin": bins, "offset": offset, "underfull": free[bins] > tolerance, "gap": gap, "bound": bound})

    return pack


def pack_lengths(items: DataFrame, total: int, bound: int, size: int) -> tuple[DataFrame, list[dict]]:
    """Bins for the items (item, length): item, round, part, bin, offset; and what each round reached.

    ``total`` items meet the bound over all of them when no fewer bins could hold them.
    """
    done: list[DataFrame] = []
    report: list[dict] = []
    schema = "item long, length long, part int, bin long, offset long, underfull boolean, gap long, bound long"
    rest, left, kept = items, total, 0
    for round_ in range(ROUNDS):
        placed = ["item", F.lit(round_).alias("round"), "part", "bin", "offset"]
        parts = max(1, -(-left // PARTITION_PIECES))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(parts)).cast("int"))
        packed = written(dealt.groupBy("part").applyInPandas(_pack_groups(size), schema), "packed")
        last = parts == 1 or round_ == ROUNDS - 1
        seen = packed.groupBy("part").agg(F.max("gap").alias("gap"), F.max("bin").alias("top")).agg(F.sum(F.col("top") + 1).alias("bins"), F.sum(F.when(F.col("gap") == 0, 1).otherwise(0)).alias("certified")).first()
        report.append({"round": round_, "parts": parts, "items": left, "bins": int(seen["bins"] or 0), "certified": int(seen["certified"] or 0)})
        certified = report[-1]["bins"] + kept == bound  # no fewer bins could hold them all
        rest = packed.where("underfull").select("item", "length")
        opened = 0 if last or certified else rest.count()
        if not 0 < opened < left:  # nothing to exchange, or nothing that could stay behind
            done.append(packed.select(*placed))
            break
        keep = packed.where("not underfull")
        done.append(keep.select(*placed))
        kept += keep.select("part", "bin").distinct().count()
        left = opened
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    report.append({"bound": bound})
    return out, report


def best_fit_packing(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(pieces_of(docs, tokenizer_path, size, end_id), size)[0]


def pack_pieces(pieces: DataFrame, size: int) -> tuple[DataFrame, list[dict]]:
    full = F.col("length") >= size
    counts = pieces.where(~full).groupBy("length").count().collect()  # at most ``size`` rows
    by_length = np.zeros(size + 1, np.int64)
    for length, n in counts:
        by_length[length] = n
    packed, report = pack_lengths(pieces.where(~full).select("item", "length"), int(by_length.sum()), lower_bound(by_length, size), size)
    # Sequence numbers: full pieces take odd ones by item, bins even ones by round, part and bin.
    number = (F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft(F.col("part").cast("long"), 28) + F.col("bin")) * 2
    placed = packed.select("item", number.alias("sequence_id"), "offset")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(full).select(*columns, (F.col("item") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(~full).join(placed, "item").select(*columns, "sequence_id", "offset").unionAll(whole), report


def packing_report(packed: DataFrame, size: int = 4096) -> DataFrame:
    """One row: sequences, the bound that certifies them, and full sequences' share of all places."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    return per.agg(F.count("*").alias("sequences"), F.ceil(F.sum("filled") / size).alias("volume_bound"), (F.sum("filled") / (F.count("*") * size)).alias("utilisation"))
