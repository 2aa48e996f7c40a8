"""Joins, decontamination, toxicity, licences and quality rules against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuscle.llm import decontamination, licenses, ngram_join, quality_rules, support, toxicity
from corpuscle.llm.support import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k int, root long, host string, local string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.0, 1, 2, "h", "l") for i, t, s in rows], SCHEMA)


def near_copies(seed=1, bases=12, copies=7, lengths=(3, 10, 30, 120)):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for b in range(bases):
        base = [rnd.choice(words) for _ in range(rnd.choice(lengths))]
        for c in range(copies):
            t = list(base)
            for _ in range(rnd.randrange(0, 1 + len(t) // 30 + c % 3)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append(" ".join(t))
    rnd.shuffle(out)
    return out


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components(spark, n, num, den):
    texts = [*near_copies(), "", None, " \n\t", "one", "ONE", "One ", "two words", "two  words", "É é", "é É"]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(documents(spark, [(i, t, "s") for i, t in rows]), n, num, den).collect()}
    assert found == brute(rows, n, num, den)


def test_components_of_odd_tables(spark):
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0
    found = ngram_join.ngram_components(documents(spark, [(None, "a b c", "s"), (5, "a b c", "s"), (5, "a b c", "s"), (3, "a b c", "s"), (9, None, "s")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (3, 3), (5, 3), (5, 3), (9, 9)]


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (95, 100), (70, 100)])
def test_every_link_shares_an_entry(num, den):
    """Whatever the allocation that the costs choose, a linked pair meets in a scheme that both have."""
    rng = np.random.default_rng(3)
    t = ngram_join.Threshold(num, den)
    for sets in (1, 10_000, 10**7, 10**12):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 62, int(rng.choice([1, 2, 5, 9, 14, 20, 40, 90, 300])), dtype=np.uint64))
            size = len(a)
            # As far apart as a link allows: some elements go, others come.
            drop = add = 0
            while den * (size - drop) >= num * (size + add) and drop < size:
                drop, add = (drop + 1, add) if rng.random() < 0.5 else (drop, add + 1)
                if den * (size - drop) < num * (size + add):
                    break
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 62, add, dtype=np.uint64)]))
                if den * len(np.intersect1d(a, b)) < num * len(np.union1d(a, b)):
                    continue
                shared = set(t.schemes(len(a))) & set(t.schemes(len(b)))
                assert shared
                ok = {}
                for k in {max(t.band(len(a)), t.band(len(b)))}:
                    most = t.weight(int(t.lows[k + 1]) - 1)
                    for allocation in {t.allocation(k, sets), (0, (most + 1) // 2), (max(0, most - 2), 1), (2 * max(0, most - 4), 2)}:
                        ok[allocation] = ok.get(allocation, False) or bool(set(ngram_join.entries(a, k, allocation, t.weight(len(a))).tolist()) & set(ngram_join.entries(b, k, allocation, t.weight(len(b))).tolist()))
                # Whichever of the schemes they share, every allocation of enough weight must make them meet in one.
                assert all(ok.values())
                words = min(t.sketch_words(len(a)), t.sketch_words(len(b)))
                assert ngram_join._may_link(t, ngram_join.sketch(a, words), ngram_join.sketch(b, words), np.int64(len(a)), np.int64(len(b)))


def test_sketches_fold():
    g = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 999, dtype=np.uint64))
    assert (ngram_join.sketch(g, 8)[:4] ^ ngram_join.sketch(g, 8)[4:] == ngram_join.sketch(g, 4)).all()


def test_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 100)
    monkeypatch.setattr(ngram_join, "COMPARED", 3)
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 2)
    rows = list(enumerate(near_copies(seed=5, bases=3, copies=30, lengths=(60,))))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(documents(spark, [(i, t, "s") for i, t in rows]), 3, 90, 100).collect()}
    assert found == brute(rows, 3, 90, 100)


def test_readers_decode_few_rows_at_once(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        for now, then in ((4096, "512"), (100, "100")):
            spark.conf.set(key, now)
            ngram_join.ngram_components(documents(spark, [(1, "a b c d", "s"), (2, "a b c d", "s")]), n=3, num=90, den=100).collect()
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)


def test_words_are_let_go_for_other_operators():
    ngram_join._keep_words()
    ngram_join.grams("a b c d", 3)
    assert len(ngram_join._words) >= 4
    support.held(("another operator",), dict)
    assert not ngram_join._words
    support.release()


def test_one_of_each(spark):
    kept = ngram_join.one_of_each(documents(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "", "s"), (4, "", "s"), (None, "a b c d e f", "s")]))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4] and kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_of_each_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y")], "DOC_ID long, Text string, drop int, Sig string")
    assert [tuple(r) for r in ngram_join.one_of_each(rows).collect()] == [(1, "a b c d e f", 7, "x")]


def test_documents_of_several_texts_link_all_of_them(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    found = ngram_join.ngram_components(documents(spark, [(1, a, "s"), (2, b, "s"), (3, a, "s"), (3, b, "s")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1)}


def test_decoding_is_the_least_of_all_readings():
    rnd = random.Random(8)
    text = "you are an idiot and a stupid fool so shut up now please dumb as a rock said bella to anna"
    model = toxicity.LanguageModel(dict(Counter(f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1))))

    def cost(reading):
        padded = "  " + "".join(s for s, _ in reading) + " "
        return sum(k for _, k in reading) + sum(model.cost(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))

    for _ in range(300):
        word = "".join(rnd.choice(["a", "b", "o", "l", "1", "0", "$", ".", "oo", "ll", "!!!", "st"]) for _ in range(rnd.randrange(1, 8)))
        for doubled in (False, True):
            ways = list(toxicity.lattice(word, doubled))
            if math.prod(map(len, ways)) > 3000:
                continue
            found = toxicity.decode(word, model, doubled)
            best = min(map(cost, itertools.product(*ways)))
            assert min(cost(r) for r in itertools.product(*ways) if "".join(s for s, _ in r) == found) == pytest.approx(best)


def test_features_of_known_words_are_those_of_all_words():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abco1$.!") for _ in range(rnd.randrange(1, 50 if i % 9 == 0 else 9))) for i in range(600)]
    model = toxicity.LanguageModel(dict(Counter(f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1))))
    every = toxicity.Extractor(toxicity.Restorer(model))
    known = {f: i for i, f in enumerate(sorted({f for w in words for f in every[w]})[::3])}
    some = toxicity.Extractor(toxicity.Restorer(model), known)
    assert all(sorted(some[w]) == sorted(known[f] for f in every[w] if f in known) for w in words)


def test_batches_of_texts_have_the_features_of_each(monkeypatch):
    rnd = random.Random(5)
    words = ["stupid", "stuff", "letter", "plain", "st@pid", "idi0t", "i.d.i.o.t", "(word", "word!", "ßtuff", "...", "be", "x" * 70]
    model = toxicity.LanguageModel(dict(Counter(f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1))))
    every = toxicity.Extractor(toxicity.Restorer(model))
    texts = ["", " ", "I D I O T you", *(" ".join(rnd.choice(['"', "", ""]) + rnd.choice(words) + rnd.choice(["", ",", ".", "?'", "!"]) for _ in range(rnd.randrange(40))) for _ in range(200))]
    assert all(every.present(t) == set(every.counts(t)[0]) for t in texts)
    known = {f: i for i, f in enumerate(sorted({f for t in texts for f in every.present(t)})[::3])}
    want = [Counter({known[f]: n for f, n in every.counts(t)[0].items() if f in known}) for t in texts]
    numbered = toxicity.Numbered(toxicity.Extractor(toxicity.Restorer(model), known))
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 7)
    monkeypatch.setattr(toxicity, "KEPT_FEATURES", 9)
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        which, feature, n, sizes = numbered.counts(part)
        found = [Counter() for _ in part]
        for i, f, k in zip(which.tolist(), feature.tolist(), n.tolist()):
            found[i][f] += k
        assert found == want[lo : lo + 50] and sizes.tolist() == [len(t.split()) for t in part]


def test_trigrams_by_words():
    words, times = ["ab", "b", "übel", "a"], np.asarray([3, 1, 2, 5])
    found = dict(zip(*[list(x) for x in toxicity._trigrams(words, times)]))
    wanted = Counter()
    for w, n in zip(words, times.tolist()):
        for i in range(len(w) + 1):
            wanted[f"  {w} "[i : i + 3]] += n
    assert found == wanted


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000), (2000, 1500), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(1, 301)} | {2000: 1000, 1500: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance_within(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row = row, [0]
        for i, x in enumerate(item, 1):
            row.append(min(last[i - 1] + (x != c), last[i] + 1, row[i - 1] + 1))
        best = min(best, row[-1])
    return best


def test_myers():
    rnd = random.Random(2)
    for _ in range(200):
        item, text = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 70))) for _ in range(2))
        d = distance_within(item, text)
        found = decontamination.myers(item, text, len(item))
        assert found[0] == d
        if d:
            assert decontamination.myers(item, text, d - 1) is None


def test_contaminated(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    items = [" ".join(rnd.choice(words) for _ in range(n)) for n in (6, 12, 30, 40)]
    docs = []
    for i in range(80):
        t = [rnd.choice(words) for _ in range(40)]
        if i % 2:
            passage = list(rnd.choice(items))
            for _ in range(rnd.randrange(0, 1 + len(passage) // 7)):
                passage[rnd.randrange(len(passage))] = rnd.choice("abc ")
            t.insert(20, "".join(passage).upper() if i % 4 == 1 else "".join(passage).replace(" ", "\n "))
        docs.append((i, " ".join(t), "s"))
    docs += [(90, None, "s"), (91, "", "s"), (92, items[0], "s"), (92, items[0], "s")]
    bench = spark.createDataFrame([*enumerate(items), (8, None), (9, ""), (10, "short")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(documents(spark, docs), bench).collect())
    wanted = []
    for i, t, _ in docs:
        for k, item in enumerate(items):
            d = distance_within(item, decontamination.normal(t))
            if d <= int(len(item) * decontamination.ERROR_RATE):
                wanted.append((i, k, d))
    assert found == sorted(wanted) and len(found) > 20
    kept = decontamination.decontaminate(documents(spark, docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in docs} - {i for i, _, _ in wanted}
    assert decontamination.contaminated(documents(spark, []), bench).count() == 0
    assert decontamination.contaminated(documents(spark, docs), bench.limit(0)).count() == 0


def test_short_items(spark):
    bench = spark.createDataFrame(enumerate(["Who wrote Emma?", "Pi", "東京の人口", "the red house", " \t "]), "item_id long, text string")
    texts = ["so: who wrote emma? Jane", "who wrote ema?", "who wrote mma", "pi is 3", "a pie, a spin", "今日は東京の人口を調べる", "The  red\nhorse", "the red horses", "bathe red house", ""]
    found = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), bench).collect())
    assert found == [(0, 0, 0), (1, 0, 1), (3, 1, 0), (5, 2, 0), (6, 3, 1)]


def test_items_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_CHARACTERS", 60)
    bench = spark.createDataFrame([(i, f"passage number {i} of the benchmark table") for i in range(9)], "item_id long, text string")
    docs = documents(spark, [(i, f"see passage number {i} of the benchmark table.", "s") for i in range(9)])
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(docs, bench).collect()}
    assert all(found[i, i] == 0 for i in range(9))


def model():
    counts = Counter()
    for w in ["idiot", "stupid", "loser", "the", "there", "little", "lost", "good", "book", "letter"] * 20:
        counts.update(f"  {w} "[i : i + 3] for i in range(len(w) + 1))
    return toxicity.LanguageModel(dict(counts))


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("id!ot", "idiot"), ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("looooser", "loser"), ("idiooot", "idiot"), ("good", "good"), ("l0s3r", "loser"), ("id*iot", "idiot")])
def test_decoding(written, meant):
    r = toxicity.Restorer(model())
    assert meant in r.words(written)


def test_spaced_letters():
    r = toxicity.Restorer(model())
    assert "idiot" in r.spaced("you i d i o t you") and r.spaced("a plain text") == []
    assert not toxicity.is_disguised("9233a8ecf7c5b09fe5949719b6b82bc4") and not toxicity.is_disguised("a@mail.example.com") and not toxicity.is_disguised("word")


@pytest.mark.parametrize(("written", "meant"), [("idio7", "idiot"), ("@$$", "ass"), ("a55", "ass"), ("a$$", "ass"), ("5h17", "shit"), ("sstupiid", "stupid"), ("good", "good"), ("idio7!", "idiot"), ("idiot!", "idiot")])
def test_signs_anywhere(written, meant):
    m = model()
    for w in ["ass", "shit", "as"] * 20:
        for i in range(len(w) + 1):
            t = f"  {w} "[i : i + 3]
            m.trigrams[t] = m.trigrams.get(t, 0) + 1
    r = toxicity.Restorer(toxicity.LanguageModel(m.trigrams))
    assert meant in r.words(written)


def test_plain_words_and_numbers_stay():
    r = toxicity.Restorer(model())
    assert [r.words(w) for w in ("there,", "2024", "$5.50", "word.")] == [["there"], ["2024"], ["5.50"], ["word"]]


def test_long_and_short_disguises():
    r = toxicity.Restorer(model())
    assert "idiot" in r.spaced(" ".join("there" * 40 + "idiot" + "there" * 200)) and r.words(".".join("there" * 40 + "idiot"))
    assert any("idiot" in w for w in r.words(".".join("there" * 40 + "idiot")))
    assert "the" in r.spaced("good t h e book")


def toxic_table(spark, n=400):
    rnd = random.Random(4)
    words = ["the", "there", "little", "lost", "good", "book", "letter", "old", "house", "river"]
    rows, labels = [], []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            t.insert(rnd.randrange(30), rnd.choice(["idiot", "stupid", "loser"]))
        rows.append((i, " ".join(t), f"s{i % 3}"))
        labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    import zlib

    rows, labels = toxic_table(spark)
    extra = [(1000, "what an 1d10t there", "s"), (1001, "you s t u p i d house", "s"), (1002, "", "s"), (1003, None, "s"), (None, "good book", "s"), (1004, "LOSER!!", "s"), (1005, "good " * 5000, "s"), (1005, "good", "s")]
    docs = documents(spark, rows + extra)
    scorer = toxicity.train(docs, labels)
    found = toxicity.toxicity(docs, labels, scorer).collect()
    assert len(found) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400)) and not by_id[None]["held_out"]
    assert [by_id[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 1, 0, 0, 1, 0]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in found if not r["predicted"])


def test_toxicity_without_labels(spark):
    rows, labels = toxic_table(spark, 40)
    assert {r["predicted"] for r in toxicity.toxicity(documents(spark, rows), labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(documents(spark, []), labels).count() == 0
    conflicting = labels.unionAll(labels.selectExpr("doc_id", "quality", "1 - toxic")).unionAll(spark.createDataFrame([(None, 1, 1), (1, 1, None)], labels.schema))
    assert toxicity.toxicity(documents(spark, rows), conflicting).count() == 40


def test_automaton_against_naive_matching():
    rnd = random.Random(5)
    for _ in range(60):
        sequences = [[rnd.randrange(3) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 4))]
        a = licenses.SuffixAutomaton(sequences)
        text = [rnd.choice([0, 1, 2, None]) for _ in range(25)]
        inside = lambda part: [(k, j) for k, s in enumerate(sequences) for j in range(len(s) - len(part) + 1) if s[j : j + len(part)] == part]  # noqa: E731,B023
        stats = []
        for end in range(len(text)):
            n = 0
            while n <= end and None not in text[end - n : end + 1] and inside(text[end - n : end + 1]):
                n += 1
            stats.append(n)
        wanted = [(i, n) for i, n in enumerate(stats) if n >= 2 and (i + 1 == len(stats) or stats[i + 1] != n + 1)]
        found = a.segments(text, 2)
        assert [(e, n) for e, n, _ in found] == wanted
        for end, n, state in found:
            places = {(k, e) for k, ends in a.ends[state].items() for e in ends}
            assert {(k, j + n - 1) for k, j in inside(text[end - n + 1 : end + 1])} <= places


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    gpl = licenses.TEMPLATES[8][1]
    texts = ["Released Under the MIT-License.", "Apache License, Version 2.0 and cc BY_nc!", "under the mit", "", None, gpl, mit, "x " * 3 + gpl.replace("redistribute", "spread") + " y", "cc by nc " * 3000, "under the mit license", "the École Under THE mit license"]
    found = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((j, label) for p, label in licenses.PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min((j for j, _ in places), default=None), max((j for j, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and 0 <= r["score"] <= 1
    assert found[1]["labels"] == "apache-2,cc-by-nc" and found[5]["labels"] == "gpl-3" and found[7]["labels"] == "gpl-3" and found[2]["labels"] == "" and found[5]["score"] == 1.0
    assert licenses.license_scan(documents(spark, [])).count() == 0


def test_licence_relatives_and_every_copy(spark):
    by_label = {}
    for label, text in licenses.TEMPLATES:
        by_label.setdefault(label, []).append(text)
    rnd = random.Random(8)
    filler = lambda n: " ".join(f"w{rnd.randrange(50)}" for _ in range(n))
    texts, wanted = [], []
    for label, notices in by_label.items():
        for notice in notices:
            texts.append(notice)
            wanted.append([label])
            texts.append(f"{filler(7)} {notice} {filler(3)} {notice} {filler(20)} {notice}")
            wanted.append([label] * 3)
    drawn = [rnd.choice(licenses.TEMPLATES) for _ in range(40)]
    texts.append(" ".join(f"{t} {filler(12)}" for _, t in drawn))
    wanted.append([label for label, _ in drawn])
    found = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, labels in enumerate(wanted):
        spans = found[i]["spans"]
        words = licenses.words_of(texts[i])
        assert {x["label"] for x in spans} == set(labels) and all(0 <= x["first"] <= x["last"] < len(words) for x in spans), texts[i]
        places = []  # several templates of a label may lie on the same words
        for x in sorted(spans, key=lambda x: (x["first"], -x["last"])):
            if not places or x["first"] > places[-1][1]:
                places.append((x["first"], x["last"], x["label"]))
        assert [p[2] for p in places] == labels and found[i]["score"] == 1.0, texts[i]


def quality_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_quality(spark):
    rnd = random.Random(6)
    texts = ["", None, "a b c", "a b c d e " * 20, "x\n\nx\n x\nx", "é # * $%&|<> y" * 3, " \t\x0b\x0c\r\n "]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(60))) for _ in range(80)]
    texts += ["\n".join(rnd.choice(["one two", "three four five", " ", ""]) for _ in range(30)) for _ in range(10)]
    texts += [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(5000))]
    rows = [(i, t, None if i % 5 == 0 else f"h{i % 3}") for i, t in enumerate(texts)] + [(10_000 + i, " ".join(f"u{j}" for j in range(20)), "clean") for i in range(30)] + [(20_000 + i, "spam", "spam") for i in range(50)] + [(30_000, " ".join(f"u{j}" for j in range(20)), "spam")]
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert len(found) == len(rows)
    for i, t, _ in rows:
        assert tuple(found[i][n] for n in names) == quality_by_hand(t), i
    assert all(found[10_000 + i]["kept"] for i in range(30)) and not found[30_000]["kept"] and not found[30_000]["base_failed"]
    assert not any(r["kept"] and r["base_failed"] for r in found.values())
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0


def test_host_rates_are_shrunk(spark):
    rows = [(i, "bad" if i % 2 else " ".join(f"u{j}" for j in range(20)), f"h{i % 10 // 2}") for i in range(1000)] + [(5000, "bad", "tiny")]
    hosts = {r["host"]: r for r in quality_rules.host_verdicts(quality_rules.measured(documents(spark, rows))).collect()}
    assert 0.4 < hosts["tiny"]["base_rate"] < 1.0 and hosts["h0"]["base_failures"] == 100
