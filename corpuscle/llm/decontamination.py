"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k edits, a test item is split into k + 1 pieces; a passage within k
edits of the item has at least one of the pieces unchanged.  An Aho-Corasick automaton
finds all exact piece hits in a document; each hit fixes where the item would stand, give or
take k characters, and Myers' bit-parallel distance verifies that stretch exactly.

A hit is verified from the piece outwards: pieces are the leaves of a tree that halves the
item, and a node over n leaves has a budget of n - 1 edits.  Of a passage within budget, one
half is within its own, and so on down; so some hit passes at every node above it, and a
hit that fails at one, mostly at a short one near the leaf, needs no more.

Texts are compared in lower case with runs of white space as one space.  The budget is a
share of an item's length.  Items of fewer than ``SHORT_ITEM`` characters match whole words
only, edits among them (scripts without spaces have no word ends to mind).  Empty or null items match nothing; items in several rows are
matched each; null or empty documents have no match.  Items are taken to the executors in
slices of bounded size, one scan of the documents for each slice.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.support import bounded_batches, id_and_text, release

ERROR_RATE = 0.1
SLICE_CHARACTERS = 4_000_000
SHORT_ITEM = 20  # under so many characters an item is matched at word boundaries
#: Letters of scripts that set no spaces between words: fixed ranges.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the item to a substring of the text, at most ``most``, and where that ends."""
    return _scan(_masks(item), len(item), text, most)


def _masks(item: str) -> dict[str, int]:
    """For each character, the places where the item has it."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def _scan(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    if len(text) < m - most:
        return None
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, where = most + 1, -1
    get = peq.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, where = score, at + 1
            if not best:
                break
    return (best, where) if best <= most else None


def distance(a: str, b: str) -> int:
    """Edit distance of two short strings."""
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        last, row = row, [j]
        for i, x in enumerate(a, 1):
            row.append(min(last[i - 1] + (x != c), last[i] + 1, row[i - 1] + 1))
    return row[-1]


def is_boundary(text: str, at: int) -> bool:
    """Whether no word of a script with spaces goes on across a place of the text."""
    if at <= 0 or at >= len(text):
        return True
    return not all((c.isalnum() or c == "_") and not _UNSPACED.match(c) for c in text[at - 1 : at + 1])


class Node(NamedTuple):
    """Characters ``start`` to ``end`` of an item, with their masks, and the edits they may have."""

    start: int
    end: int
    budget: int
    masks: dict[str, int]


class Item:
    def __init__(self, key: int | None, text: str, rate: float) -> None:
        self.key, self.text, self.k = key, text, int(len(text) * rate)
        self.cuts = [len(text) * j // (self.k + 1) for j in range(self.k + 2)]
        self.above: list[list[Node]] = [[] for _ in range(self.k + 1)]
        self._split(0, self.k + 1)

    def _split(self, first: int, last: int) -> None:
        """Nodes over the leaves ``first`` to ``last``, each after those below it."""
        if last - first < 2:
            return
        middle = (first + last) // 2
        self._split(first, middle)
        self._split(middle, last)
        node = Node(self.cuts[first], self.cuts[last], last - first - 1, _masks(self.text[self.cuts[first] : self.cuts[last]]))
        for leaf in range(first, last):
            self.above[leaf].append(node)

    def verified(self, text: str, at: int, leaf: int) -> tuple[int, int] | None:
        """(edits, end) of the item about a piece hit at a place of the text."""
        if len(self.text) < SHORT_ITEM:
            return self._whole_words(text, at - self.cuts[leaf])
        found = (0, at + len(self.text))
        for node in self.above[leaf]:
            start = at + node.start - self.cuts[leaf]
            low = max(0, start - node.budget)
            found = _scan(node.masks, node.end - node.start, text[low : max(0, start + node.end - node.start + node.budget)], node.budget)
            if not found:
                return None
            found = (found[0], low + found[1])
        return found


    def _whole_words(self, text: str, start: int) -> tuple[int, int] | None:
        """(edits, end) of the nearest stretch of whole words that starts where the item would, give or take the budget."""
        m, k, found = len(self.text), self.k, []
        for low in range(max(0, start - k), min(start + k, len(text)) + 1):
            if is_boundary(text, low):
                for high in range(max(low + 1, low + m - k), min(low + m + k, len(text)) + 1):
                    if is_boundary(text, high) and (d := distance(self.text, text[low:high])) <= k:
                        found.append((d, high))
        return min(found, default=None)


class ItemMatcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        import ahocorasick

        self.items = [Item(key, text, rate) for key, text in items if text]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            for leaf, (a, b) in enumerate(zip(item.cuts, item.cuts[1:])):
                pieces[item.text[a:b]].append((n, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def matches(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item, edits, end) of every item that stands in the text within its budget: the fewest edits, then the first end."""
        if not self.any or not text:
            return []
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()  # items verified where they would start here
        for end, (size, places) in self.automaton.iter(text):
            for n, leaf in places:
                item = self.items[n]
                at = end + 1 - size
                start = (n, at - item.cuts[leaf])
                if n in best and not best[n][0] or start in seen:
                    continue
                if found := item.verified(text, at, leaf):
                    seen.add(start)
                    best[n] = min(best.get(n, found), found)
        return [(self.items[n].key, *found) for n, found in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, edits, end_char: each document and item that it holds within the budget."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_and_text(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where(F.length("item_text") > 0)
    slices = max(1, -(-int(items.agg(F.sum(F.length("item_text"))).first()[0] or 0) // SLICE_CHARACTERS))
    out = None
    for s in range(slices):
        held = [(r[0], normal(r[1])) for r in items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(slices)) == s).collect()]  # SLICE_CHARACTERS or so
        part = _scan_documents(rows, held, rate)
        out = part if out is None else out.unionAll(part)
    return out


def _scan_documents(rows: DataFrame, items: list[tuple[int | None, str]], rate: float) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(items)
    matchers: list[ItemMatcher] = []

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not matchers:
            release()
            matchers.append(ItemMatcher(sent.value, rate))
        for batch in batches:
            found = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matchers[0].matches(normal(text))]
            names = ("doc_id", "item_id", "edits", "end_char")
            yield pa.record_batch({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(names)})

    return rows.mapInArrow(match, "doc_id long, item_id long, edits long, end_char long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item, with all their columns; rows without an id are matched by nothing and stay."""
    bad = contaminated(docs, benchmark, rate).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == F.col("__bad"), "left_anti")
