"""Toxicity scores of texts restored by a noisy-channel decoder.

A character trigram model is counted over all documents.  Words that may be disguised (digits
or signs anywhere, repeated letters, single letters spaced out) span
a lattice: each character may stand for itself or what it is used for, a repeated letter for
one or two, a separator for nothing or a space.  Viterbi decoding under the language model
and the channel's costs picks the reading.  A linear model over word beginnings and words of
the restored text, present and by rate, gives the score.

Only texts are inputs of a score.  Labels are learnt from rows whose crc32(doc_id as text)
mod 5 isn't 0, at most ``TRAINING_ROWS`` of them (those least by hash), a documented bound;
of these all features are counted, and the ``FEATURES`` most telling are kept.  Null and
empty texts get the model's score for no feature; null ids are never held out; documents in
several rows are scored each; without labels of both kinds every score is the share of 1s.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.support import bounded_batches, id_and_text, release, written

TRAINING_ROWS = 30_000
FEATURES = 4000
LEAST_TOXIC = 3  # toxic documents with a feature, for it to be considered
FOLDS = 5
KEPT_WORDS = 400_000
KEPT_IN_TRAINING = 100_000  # with all features, as texts
KEPT_FEATURES = 1_000_000
COUNTED_WORDS = 100_000  # different words of a task held before their trigrams are sent on

#: What a character is used for, beside itself: fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "ß": "b",
}
SEPARATORS = ".-_*~'`^"
COST_STAND, COST_SINGLE, COST_DROP, COST_SPACE = 0.4, 0.1, 0.3, 1.5
KEPT_COSTS = 200_000
LEAST_BEGINNING, LONGEST_WORD = 3, 40  # characters of features: a longer word is known by its beginnings
KEPT_STRETCHES = 50_000

_LETTERS = re.compile(r"[^\W\d_]")
_SIGNS = re.escape("".join(STANDS_FOR) + SEPARATORS)
_DISGUISED = re.compile(rf"[{_SIGNS}]|([^\W\d_])\1")
_PRICE = re.compile(r"[$€£+\-(|!]*\d[\d.,:]*[%!)€£$+\-|]*")
_EDGE_SIGNS = re.compile(rf"^[^\w{re.escape(''.join(STANDS_FOR))}]+|[^\w{re.escape(''.join(STANDS_FOR))}]+$")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t.\-_*]){2,}\S(?!\S)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = ",.;:?\"'"  # signs that every form of a word is read without, where they stand at its edge
_HEX = re.compile(r"[0-9a-f]{16,}|[^@\s]+@[^@\s]+\.[^@\s]+|\d")
_REPEATED = re.compile(r"(.)\1*")
_OFTEN = re.compile(r"(.)\1\1").search
_UNSURE = re.compile(rf"(.)\1+|[{_SIGNS} \t]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class LanguageModel:
    """Character trigrams of words, each word between spaces."""

    def __init__(self, trigrams: dict[str, int]) -> None:
        self.trigrams = trigrams
        pairs: dict[str, int] = defaultdict(int)
        for t, n in trigrams.items():
            pairs[t[:2]] += n
        self.pairs = dict(pairs)
        self.letters = max(2, len({t[2] for t in trigrams}))
        self.kept: dict[str, float] = {}
        self.stretches: dict[tuple[str, str, str, bool], str] = {}

    def cost(self, before: str, c: str) -> float:
        """-log P(c | the two characters before)."""
        t = before + c
        if (known := self.kept.get(t)) is None:
            if len(self.kept) >= KEPT_COSTS:
                self.kept.clear()
            known = self.kept[t] = math.log((self.pairs.get(before, 0) + 0.1 * self.letters) / (self.trigrams.get(t, 0) + 0.1))
        return known


def lattice(word: str, doubled: bool = False) -> Iterator[list[tuple[str, float]]]:
    """For each stretch of the word, what it may stand for, with costs; ``doubled`` keeps two of a kind two."""
    for run in _REPEATED.finditer(word):
        c, n = run.group(1), len(run.group(0))
        forms = [(c, 0.0)] + [(s, COST_STAND) for s in STANDS_FOR.get(c, "")]
        if c in SEPARATORS or c in " \t":
            yield [("", COST_DROP), (" ", COST_SPACE)]
        elif n == 1:
            yield forms
        elif doubled and n == 2:
            yield [(s * 2, k) for s, k in forms]
        else:
            yield [(s, k + (0.0 if n > 2 else COST_SINGLE)) for s, k in forms] + [(s * 2, k) for s, k in forms]


def viterbi(before: str, stretch: str, after: str, model: LanguageModel, doubled: bool = False) -> str:
    """The reading of least cost of a stretch between ``before`` (two characters) and ``after``; a state is the last two characters and the way there."""
    states: dict[str, tuple[float, tuple | None]] = {before: (0.0, None)}
    for options in lattice(stretch, doubled):
        reached: dict[str, tuple[float, tuple | None]] = {}
        for last, (cost, way) in states.items():
            for s, k in options:
                total, pair = cost + k, last
                for c in s:
                    total += model.cost(pair, c)
                    pair = pair[1] + c
                if pair not in reached or total < reached[pair][0]:
                    reached[pair] = (total, (way, s))
        states = reached
    ends = []
    for pair, (cost, way) in states.items():
        last = pair
        for c in after:
            cost += model.cost(last, c)
            last = last[1] + c
        ends.append((cost, pair, way))
    way = min(ends, key=lambda x: x[:2])[2]
    out = []
    while way:
        way, s = way
        out.append(s)
    return "".join(reversed(out))


def decode(word: str, model: LanguageModel, doubled: bool = False) -> str:
    """The reading of least cost of a whole word.

    Two characters in a row that stand for themselves alone bring all states together, so the
    stretches between such pairs are decoded one by one, each with its neighbours; short ones
    are kept.
    """
    spans: list[list[int]] = []
    for m in _UNSURE.finditer(word):
        if spans and m.start() - spans[-1][1] < 2:
            spans[-1][1] = m.end()
        else:
            spans.append([m.start(), m.end()])
    out, at = [], 0
    for start, end in spans:
        key = (f"  {word[max(0, start - 2) : start]}"[-2:], word[start:end], f"{word[end : end + 2]} "[:2], doubled)
        found = model.stretches.get(key)
        if found is None:
            found = viterbi(*key[:3], model, doubled)
            if len(model.stretches) >= KEPT_STRETCHES:
                model.stretches.clear()
            if end - start <= 64:
                model.stretches[key] = found
        out += (word[at:start], found)
        at = end
    return "".join((*out, word[at:]))


def bare(word: str) -> str:
    plain = word.strip(_ENDS)
    return plain if plain.isalpha() else _EDGE.sub("", plain)


def is_disguised(word: str) -> bool:
    """Has a sign or a repeated letter, and is no number, price, mail address or row of hexadecimal digits."""
    return _DISGUISED.search(word) is not None and not _HEX.fullmatch(word) and not _PRICE.fullmatch(word) and any(c in STANDS_FOR or c.isalpha() for c in word)


class Restorer:
    def __init__(self, model: LanguageModel) -> None:
        self.model = model

    def readings(self, raw: str) -> list[list[str]]:
        """What a lower-case word without white space stands for: the likeliest words, then other ways to read it."""
        word = bare(raw)
        out = []
        # Signs at the edge may be letters.
        for form in dict.fromkeys((word, _EDGE_SIGNS.sub("", raw))):
            if not is_disguised(form):
                out += [[form]] if form and form == word else []
                continue
            plain = form.isalpha() and not _OFTEN(form)
            out += [[form]] if plain else []  # doubled letters are mostly meant
            out.append(decode(form, self.model).split())
            if not plain and any(len(m[0]) == 2 for m in _REPEATED.finditer(form)):
                out.append(decode(form, self.model, doubled=True).split())
        return [r for i, r in enumerate(out) if r and r not in out[:i]]

    def words(self, raw: str) -> list[str]:
        """The words of all readings."""
        return [w for r in self.readings(raw) for w in r]

    def spaced(self, text: str) -> list[str]:
        """Words spelt with spaced letters."""
        if not _SPACED.search(text):
            return []
        return [w for m in _SPACED.finditer(text) if _LETTERS.search(m.group(0)) for w in decode(m.group(0), self.model).split()]


def features(word: str) -> list[str]:
    """The word, unless it is very long, and its beginnings."""
    beginnings = ["^" + word[:k] for k in range(LEAST_BEGINNING, min(8, len(word)))]
    return ["=" + word, *beginnings] if len(word) <= LONGEST_WORD else beginnings


class Extractor(dict):
    """Features of raw words, kept; ``known`` maps wanted features to numbers, None wants all."""

    def __init__(self, restorer: Restorer, known: dict[str, int] | None = None) -> None:
        self.restorer, self.known = restorer, known
        self.whole = {f[1:]: i for f, i in (known or {}).items() if f[0] == "="}
        self.beginnings = {f[1:]: i for f, i in (known or {}).items() if f[0] == "^"}
        self.begin = {f[:LEAST_BEGINNING] for f in self.beginnings}
        self.starts = {f[1 : LEAST_BEGINNING + 1] for f in known or ()}

    def of(self, words: list[str]) -> tuple:
        if self.known is None:
            return tuple(f for w in words for f in features(w))
        found = []
        for w in words:
            if (whole := self.whole.get(w)) is not None:
                found.append(whole)
            if w[:LEAST_BEGINNING] in self.begin:  # else no longer beginning is known either
                found += [self.beginnings[w[:k]] for k in range(LEAST_BEGINNING, min(8, len(w))) if w[:k] in self.beginnings]
        return tuple(found)

    def _found(self, raw: str) -> tuple:
        if raw.isalpha():
            unsure = _DISGUISED.search(raw)
            if self.known is not None and raw[:LEAST_BEGINNING] not in self.starts and not (unsure and unsure.start() < LEAST_BEGINNING):
                return ()  # all readings begin like that
            if not unsure:
                return self.of([raw])
        several = [self.of(reading) for reading in self.restorer.readings(raw)]
        if len(several) < 2:
            return several[0] if several else ()
        found: Counter = Counter()
        for one in several:
            found |= Counter(one)  # what readings share counts once
        return tuple(found.elements())

    def __missing__(self, raw: str) -> tuple:
        if len(self) >= (KEPT_IN_TRAINING if self.known is None else KEPT_WORDS):
            self.clear()
        word = raw.strip(_ENDS)
        found = self._found(raw) if word == raw else self[word]
        if len(raw) <= 64:
            self[raw] = found
        return found

    def present(self, text: str) -> set:
        """The features that come in the text."""
        text = text.lower()
        return set().union(*map(self.__getitem__, set(text.split())), self.of(self.restorer.spaced(text)))

    def counts(self, text: str) -> tuple[Counter, int]:
        """How often each feature comes, and the number of words."""
        text = text.lower()
        words = text.split()
        found: Counter = Counter()
        for w, n in Counter(words).items():
            for f in self[w]:
                found[f] += n
        if hidden := self.restorer.spaced(text):
            found.update(self.of(hidden))
        return found, len(words)


class Numbered(dict):
    """Raw words by the number of their tuple of known features, 0 for none; words and tuples are kept, and bounded."""

    def __init__(self, extractor: Extractor) -> None:
        self.extractor = extractor
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.numbers, self.first, self.size, self.flat = {(): 0}, [0], [0], []

    def __missing__(self, raw: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()  # the tuples stay, for the numbers given out
        word = raw.strip(_ENDS)
        if word != raw:
            number = self[word]
        else:
            found = self.extractor._found(raw)
            number = self.numbers.setdefault(found, len(self.numbers))
            if number == len(self.first):
                self.first.append(len(self.flat))
                self.size.append(len(found))
                self.flat += found
        if len(raw) <= 64:
            self[raw] = number
        return number

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and how often it comes, of all pairs that come; and each text's number of words."""
        if len(self.flat) > KEPT_FEATURES:
            self.forget()
        found, words, hidden = [], np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            text = text.lower()
            raw = text.split()
            words[i] = len(raw)
            numbers = np.fromiter(map(self.__getitem__, raw), np.int32, len(raw))
            found.append(numbers[numbers > 0])
            hidden += [(i, f) for f in self.extractor.of(self.extractor.restorer.spaced(text))]
        numbers = np.concatenate([np.zeros(0, np.int32), *found])
        size = np.asarray(self.size, np.int64)[numbers]
        after = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(np.asarray(self.first, np.int64)[numbers] - (after - size), size)
        which = np.repeat(np.repeat(np.arange(len(texts)), [len(x) for x in found]), size)
        width = max(1, len(self.extractor.known))
        key = which * width + np.asarray(self.flat, np.int64)[at]
        key, n = np.unique(np.concatenate([key, np.asarray([i * width + f for i, f in hidden], np.int64)]), return_counts=True)
        return key // width, key % width, n, words


def _trigrams(words: list[str], times: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The trigrams of the words between spaces, and how often they come where each word comes so many times."""
    if not words:
        return [], np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    last = np.cumsum([len(w) + 3 for w in words])
    starts = np.ones(len(code), bool)
    starts[last - 1] = starts[last - 2] = False
    at = np.flatnonzero(starts)
    key = code[at] << 42 | code[at + 1] << 21 | code[at + 2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.add.reduceat(np.repeat(times, [len(w) + 1 for w in words])[order], first)
    return ["".join(chr(int(k) >> s & 0x1FFFFF) for s in (42, 21, 0)) for k in key[first]], sums


def trigram_counts(rows: DataFrame) -> DataFrame:
    """trigram, n: over the lower-case words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            plain: dict[str, int] = {}
            for raw, n in words.items():
                if (word := bare(raw)).isalpha():
                    plain[word] = plain.get(word, 0) + n
            words.clear()
            found, n = _trigrams(list(plain), np.asarray(list(plain.values()), np.int64))
            return pa.record_batch({"trigram": pa.array(found, pa.string()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for text in batch.column(1).to_pylist():
                words.update(text.lower().split())
                if len(words) > COUNTED_WORDS:
                    yield out()
        yield out()

    return rows.mapInArrow(count, "trigram string, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


MODEL_TRIGRAMS = 300_000  # the most frequent ones make the model that is sent to executors


def language_model(rows: DataFrame) -> LanguageModel:
    kept = trigram_counts(rows).orderBy(F.desc("n"), "trigram").limit(MODEL_TRIGRAMS).toArrow()
    return LanguageModel(dict(zip(kept.column("trigram").to_pylist(), kept.column("n").to_pylist())))


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, labels: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over the places (row, column, value) of a sparse matrix."""
    w, share = np.zeros(width), min(max(labels.mean(), 1e-3), 1 - 1e-3)
    b = math.log(share / (1 - share))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], minlength=len(labels)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.bincount(col, val * error[row], minlength=width) / len(labels) + penalty * w
        gb = error.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


class Scorer:
    """What is sent to the executors: the language model, the features and their weights."""

    def __init__(self, model: LanguageModel, known: dict[str, int], weights: np.ndarray, bias: float) -> None:
        self.model, self.known, self.weights, self.bias = model, known, weights, bias

    @cached_property
    def words(self) -> Numbered:
        """Kept in a worker for as long as its tasks use this scorer."""
        return Numbered(Extractor(Restorer(self.model), self.known))

    def inputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and rate among the words, of all known features that are present."""
        which, feature, n, words = self.words.counts(texts)
        return which, feature, np.minimum(3.0, np.sqrt(50 * n / np.maximum(words[which], 1)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Each feature counts twice: as present, and by its rate."""
        which, feature, rate = self.inputs(texts)
        by_rate = self.weights[len(self.known) :]
        z = self.bias + np.bincount(which, self.weights[feature] + by_rate[feature] * rate, minlength=len(texts)) if len(which) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer for ``docs``, from labels of rows that aren't held out."""
    rows = id_and_text(docs)
    model = language_model(rows)
    spark = docs.sparkSession
    known_labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    sample = known_labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    sample = written(sample, "labels").select(F.col("doc_id").alias("labelled"), "toxic")
    texts = written(rows.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("toxic", "text"), "training")  # at most TRAINING_ROWS rows are sent
    sent = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        extractor = Extractor(Restorer(sent.value))
        toxic, clean = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            return pa.record_batch({"feature": pa.array(names, pa.string()), "toxic": pa.array([toxic[f] for f in names], pa.int64()), "clean": pa.array([clean[f] for f in names], pa.int64())})

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(extractor.present(text))
            if len(toxic) + len(clean) > 500_000:
                yield out()
                toxic.clear()
                clean.clear()
        yield out()

    sizes = {bool(label): n for label, n in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Scorer(model, {}, np.zeros(0), math.log((share + 1e-6) / (1 - share + 1e-6)))
    counted = texts.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    best = counted.where(F.col("toxic") >= LEAST_TOXIC).orderBy(F.desc(F.abs(odds) * F.sqrt("toxic")), "feature").limit(FEATURES)
    known = {r[0]: i for i, r in enumerate(sorted(best.select("feature").collect()))}
    scorer = Scorer(model, known, np.zeros(2 * len(known)), 0.0)
    sent_scorer = spark.sparkContext.broadcast(scorer)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        s = sent_scorer.value
        for batch in batches:
            which, feature, rate = s.inputs(batch.column(1).to_pylist())
            ends = pa.array(np.searchsorted(which, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(rate.astype(np.float32))))
            yield pa.record_batch({"toxic": batch.column(0), "ids": lists[0], "x": lists[1]})

    got = texts.mapInArrow(inputs, "toxic int, ids array<int>, x array<float>").toArrow()  # TRAINING_ROWS at most
    ids = got.column("ids").combine_chunks()
    row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ids.offsets.to_numpy()))
    feature, rate = ids.flatten().to_numpy(), got.column("x").combine_chunks().flatten().to_numpy()
    places = (np.concatenate([row, row]), np.concatenate([feature, feature + np.int32(len(known))]), np.concatenate([np.ones_like(rate), rate]))
    scorer.weights, scorer.bias = fit(*places, got.column("toxic").to_numpy().astype(float), 2 * len(known))
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    bounded_batches(docs.sparkSession)
    scorer = scorer or train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        s = sent.value
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(s.scores(batch.column(1).to_pylist()), pa.float64())})

    scored = id_and_text(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, with all their columns.

    The text is scored where it stands, as one more column, so no join moves texts.
    """
    bounded_batches(docs.sparkSession)
    scorer = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        s = sent.value
        for batch in batches:
            yield batch.filter(pa.array(s.scores([t or "" for t in batch.column(at).to_pylist()]) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
