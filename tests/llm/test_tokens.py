"""Token counts, token shards and packing against the libraries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from corpuscle.llm import best_fit_packing, encoding, token_binary
from corpuscle.llm.encoding import WordEncoder
from corpuscle.llm.perfect_hash import PerfectHash
from corpuscle.llm.token_counts import counter, merge_count, token_counts

BYTE, WORD, PIECE = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "one two three", "line\nline\n\nend\n", "tab\tand\r\nmore", "<s> </s> <unk> <0x0A>", "<|endoftext|> a <|startoftext|>b", "it's we'll", "日本語 テキスト😀", "▁a▁▁b", "\x00\x01",
    "é é", "x" * 3000, "word " * 2000, "ﬁ İ Σς", "\u0085a b c​d", "\x1c a\x1db", "1234 5.6", "_a_ *b*",
]


def documents(spark, texts):
    rows = [(i, t, "en", "s", 0, 1.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens double, start string")


def rnd_texts(seed, n=200):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(["a", "b", "the", " ", " ", "\n", "'s", "é", "́", "漢", "1", "_", "\u0085", "Σ", "<|endoftext|>", "▁"]) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = TEXTS + rnd_texts(1)
    found = {r["doc_id"]: r for r in token_counts(documents(spark, [*texts, None, texts[3]]), PIECE, 100).collect()}
    for i, t in enumerate([*texts, "", texts[3]]):
        n = len(model.encode(t))
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len(t.encode()), n > 100)
    assert token_counts(documents(spark, []), PIECE).count() == 0


def test_merges_go_by_rank_then_place():
    assert merge_count(list("aaa"), {"aa": 1}) == (1, ["aa", "a"])
    assert merge_count(list("abc"), {"ab": 2, "bc": 1, "abc": 3}) == (2, ["abc"])
    assert merge_count(list("abc"), {"ab": 2, "bc": 1}) == (1, ["a", "bc"])
    assert counter(PIECE).count("") == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_encode_as_texts(path, monkeypatch):
    monkeypatch.setattr(encoding, "STEP_BYTES", 500)
    monkeypatch.setattr(encoding, "LEARNT_TOGETHER", 7)
    e = WordEncoder(path)
    rnd = random.Random(4)
    lines = ["".join(rnd.choice(["ab", "É", "ß", ",", ".", "!?", " ", "\n", "\n\n", "\t", "\r\n", "'S", "J̌", "\u0130", "\u00d7"]) for _ in range(rnd.randrange(14))) for _ in range(20_000)]
    texts = [*TEXTS, "<|endoftext| <|startoftext <", "a <| b|> c", "a\n\nB, c.\nD", "\n\na", "a\n\n", "<|ENDOFTEXT|> B", *lines, *rnd_texts(2, 20_000)]
    assert e.plain  # letters go by the model alone
    wanted = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [found.tolist() for found in e.in_steps(pa.array([*texts, None]))] == [*wanted, []]


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_WORDS", 50)
    e = WordEncoder(BYTE)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    found = [e.encode_many(pa.array([t]))[0].tolist() for t in texts]
    assert found == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and len(e.place) <= 50
    monkeypatch.setattr(encoding, "KEPT_WORDS", 10_000)
    monkeypatch.setattr(encoding, "KEPT_IDS", 300)
    assert [e.encode_many(pa.array([t]))[0].tolist() for t in texts] == found and e.used < 1000


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(token_binary, "SHARD_BYTES", 2000)
    texts = TEXTS + rnd_texts(3, 60)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)] + [(None, "no id"), (6, "six again"), (6, None)]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(token_binary.token_binary(docs, BYTE).collect(), key=lambda r: r["start"])
    e = WordEncoder(BYTE)
    wanted = {}
    for i, t in rows:
        ids = np.append(e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4")
        wanted.setdefault(i, []).append((len(ids), zlib.crc32(ids)))
    at, last = 0, None
    for r in found:
        assert r["start"] == at and (last is None or r["doc_id"] >= last)
        assert (r["n_tokens"], r["ids_crc32"]) in wanted[r["doc_id"]]
        wanted[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at, last = at + r["n_tokens"], r["doc_id"]
    assert not any(wanted.values())


def test_no_shards(spark):
    assert token_binary.token_binary(documents(spark, []), BYTE).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 5000, dtype=np.uint64)
    index = PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(5000))
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        PerfectHash.build(np.asarray([1, 1], np.uint64))


def test_absent_keys_fail_by_fingerprint():
    ids = list(range(1000))
    shard = token_binary.Shard(token_binary.pack_shard(0, 0, ids, 0, [b"\x01\x00" * (i % 5) for i in ids], 2))
    start, count = shard.find(np.asarray(ids), np.zeros(1000, np.int64))
    assert count.tolist() == [i % 5 for i in ids] and start.tolist() == np.cumsum([0, *[i % 5 for i in ids]])[:-1].tolist()
    assert (shard.find(np.arange(5000, 9000), np.zeros(4000, np.int64))[1] == -1).all()


def fewest_bins(lengths, size):
    """The optimum, by trying."""
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + lengths[i] <= size:
                put(i + 1, bins[:j] + (bins[j] + lengths[i],) + bins[j + 1 :])
        put(i + 1, (*bins, lengths[i]))

    put(0, ())
    return best[0]


def test_bounds_never_exceed_the_optimum():
    rnd = random.Random(6)
    for _ in range(150):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 8))]
        counts = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, np.int64)
        bound, bins = best_fit_packing.lower_bound(counts, 20), best_fit_packing.best_fit(np.asarray(lengths, np.int64), 20)[0]
        assert bound <= fewest_bins(sorted(lengths, reverse=True), 20) <= len(set(bins.tolist()))
    # Three pieces over half need a bin each, whatever their sum.
    assert best_fit_packing.lower_bound(np.bincount([11, 11, 11], minlength=21), 20) == 3


@pytest.mark.parametrize("pieces", [20_000, 30])
def test_packing(spark, monkeypatch, pieces):
    monkeypatch.setattr(best_fit_packing, "PARTITION_PIECES", pieces)
    texts = [*TEXTS, None, *(("w " * k) for k in range(0, 400, 3)), "same", "same"]
    e, size = WordEncoder(WORD), 64
    found = best_fit_packing.best_fit_packing(documents(spark, texts), WORD, size).toPandas()
    total = 0
    for i, t in enumerate(texts):
        ids = np.append(e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4")
        mine = found[found.doc_id == i].sort_values("piece")
        assert mine.length.tolist() == [min(size, len(ids) - s) for s in range(0, len(ids), size)] and mine.start.tolist() == list(range(0, len(ids), size))
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + size]) for s in range(0, len(ids), size)]
        total += len(ids)
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.cumsum([0, *s.length])[:-1].tolist() and s.length.sum() <= size
    assert found.sequence_id.nunique() <= -(-total // size) + 3
    assert best_fit_packing.best_fit_packing(documents(spark, []), WORD).count() == 0


def test_report(spark):
    df = spark.createDataFrame([(1, 4096), (2, 4000), (2, 90)], "sequence_id long, length long")
    assert best_fit_packing.packing_report(df).first()["sequences"] == 2


@pytest.mark.parametrize("lengths", [[40] * 23, [40, 24] * 20, [64 - i % 7 for i in range(60)], [1] * 300, []])
def test_no_piece_is_lost_in_the_exchange(spark, monkeypatch, lengths):
    monkeypatch.setattr(best_fit_packing, "PARTITION_PIECES", 7)
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    bound = best_fit_packing.lower_bound(np.bincount(np.asarray(lengths, np.int64), minlength=65), 64)
    placed, report = best_fit_packing.pack_lengths(items, len(lengths), bound, 64)
    rows = placed.join(items, "item").collect()
    assert sorted(r["item"] for r in rows) == list(range(len(lengths)))
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        key = r["round"], r["part"], r["bin"]
        assert r["offset"] == bins.get(key, 0)
        bins[key] = r["offset"] + r["length"]
    assert all(b <= 64 for b in bins.values()) and bound <= len(bins) and report[-1] == {"bound": bound}
    if lengths and lengths[0] == 40 and len(set(lengths)) == 1:
        assert len(bins) == bound == len(lengths)


def test_steps_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(encoding, "trim", lambda: calls.append(1))
    monkeypatch.setattr(encoding, "STEP_BYTES", 10)
    texts = pa.array(["one two", "three four five", None, "six"], pa.large_string())
    words = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [x.tolist() for x in words.in_steps(texts)] == [x.tolist() for x in words.encode_many(texts)] and len(calls) == 3
