"""Token counts by byte-pair merging with a heap over a linked list of symbols.

Adjacent pairs whose joined text is a piece wait in a heap by rank; the pair of lowest
rank (leftmost among equals) is merged again and again.  A text has as many tokens as
initial symbols less merges; no identifiers are made.  Characters outside the vocabulary
stand for their UTF-8 bytes.

A merge never crosses a place that no piece spans, so texts are cut there (before a run
of word marks, and between neighbours that stand side by side in no piece) and the count of a
segment is kept for its next occurrence; the kept counts are bounded.

Nulls and empty texts count 0 tokens; repeated rows are counted each; other columns are
left aside.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscle.llm.support import bounded_batches, held, id_and_text

MARK = "▁"
KEPT_SEGMENTS = 1_000_000


def merge_count(symbols: list[str], rank: dict[str, int]) -> tuple[int, list[str]]:
    """How many merges the symbols take, and the symbols that are left."""
    get, push, pop = rank.get, heapq.heappush, heapq.heappop
    bits = len(symbols).bit_length()  # a heap entry is the pair's rank, then the place of its left symbol
    place = (1 << bits) - 1
    heap = [r << bits | i for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if (r := get(pair)) is not None]
    if not heap:
        return 0, symbols
    heapq.heapify(heap)
    n = len(symbols)
    text = [*symbols, ""]  # the empty symbol at the end stands beside both ends; "" is part of no pair
    right, left = [*range(1, n + 1), 0], [n, *range(n)]
    merges = 0
    while heap:
        entry = pop(heap)
        i = entry & place
        j = right[i]
        x, y = text[i], text[j]
        if not x or not y or get(pair := x + y) != entry >> bits:
            continue  # one of the two has been merged since
        text[i], text[j] = pair, ""
        merges += 1
        after = right[i] = right[j]
        left[after] = i
        if (y := text[after]) and (r := get(pair + y)) is not None:
            push(heap, r << bits | i)
        before = left[i]
        if (x := text[before]) and (r := get(x + pair)) is not None:
            push(heap, r << bits | before)
    return merges, [x for x in text if x]


class PieceCounter(dict):
    """Counts of segments under one sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte)
        score = {model.id_to_piece(i): -model.get_score(i) for i in range(model.vocab_size()) if not any(f(i) for f in special)}
        order = {s: k for k, s in enumerate(sorted(set(score.values())))}
        self.rank = {piece: order[s] for piece, s in score.items()}
        self.prefix = MARK if model.encode("a", out_type=str)[0].startswith(MARK) else ""
        if any(MARK in p.lstrip(MARK) for p in self.rank) or model.encode("a  a", out_type=str) == model.encode("a a", out_type=str):
            raise ValueError("pieces that span words, or models that squeeze spaces, aren't supported")
        self.inner = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        cut = "" if any("\n" in pair for pair in self.inner) else "\n"
        self.segments = re.compile(f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+" + f"|{cut}" * bool(cut)).findall

    def __missing__(self, segment: str) -> int:
        parts = self.cut(segment)
        if len(parts) > 1:
            n = sum(map(self.__getitem__, parts))
        else:
            merges, rest = merge_count(list(segment), self.rank)
            n = len(segment) - merges + sum(len(s.encode()) - 1 for s in rest if s not in self.rank)
        if len(self) >= KEPT_SEGMENTS:
            self.clear()
        if len(segment) <= 64:
            self[segment] = n
        return n

    def cut(self, segment: str) -> list[str]:
        """The segment cut between neighbours that stand side by side in no piece."""
        at = [0, *(i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.inner), len(segment)]
        return [segment[i:j] for i, j in zip(at, at[1:])] if len(at) > 2 else [segment]

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.segments(self.prefix + text.replace(" ", MARK))))


def counter(path: str) -> PieceCounter:
    return held(("counter", path), lambda: PieceCounter(path))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text under the sentencepiece model."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [kept.count(t) for t in texts]
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            })

    return id_and_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
