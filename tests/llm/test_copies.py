"""Repeated byte strings and near duplicates against brute force."""

import collections
import random

import pytest

from quernstone.llm import near_dedup, suffix_dedup
from quernstone.llm.components import components
from tests.llm import brute


def texts(n=120):
    r = random.Random(5)
    base = ["".join(r.choice("ab ") for _ in range(r.randrange(0, 400))) for _ in range(20)]
    kinds = [
        lambda: r.choice(base), lambda: r.choice(base)[r.randrange(60) :], lambda: "x" * r.randrange(3000), lambda: r.choice(base) + r.choice(base),
        lambda: None, lambda: "", lambda: "é" * r.randrange(80) + r.choice(base), lambda: (r.choice(base) + "\n") * 3,
    ]
    return [(1000 * r.randrange(10000) + i, kinds[i % len(kinds)]()) for i in range(n)]


@pytest.mark.parametrize(("block", "part"), [(8_000_000, 5_000_000), (4000, 3000)])
def test_suffix_dedup(spark, block, part):
    rows = texts() + [(None, "q" * 90), (None, "q" * 90), (3, "same id " * 30), (3, "same id " * 30), (4, "same id " * 30)]
    docs = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, block int, part string")
    found = suffix_dedup._without_repeats(docs, suffix_dedup._digest, suffix_dedup._DIGEST, block, part).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(brute.repeats(rows))


def test_suffix_dedup_keeps_bytes(spark):
    docs = spark.createDataFrame([(1, "a" * 60), (2, "start " + "a" * 55 + " end"), (3, None)], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert kept == {1: b"a" * 60, 2: b"start  end", 3: b""}


def test_bucket_pointers_are_those_of_equal_strings():
    import numpy as np

    r = random.Random(2)
    parts = ["".join(r.choice("ab") for _ in range(r.randrange(50, 85))) for _ in range(40)]
    parts += parts[:10]
    text = np.frombuffer("".join(parts).encode(), np.uint8)
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    pointer = suffix_dedup.bucket_pointers(text, start, size)
    seen = {}
    for p, s in zip(parts, start):
        for i in range(len(p)):
            if len(p) - i < 50:
                assert pointer[s + i] == -1
            else:
                assert seen.setdefault(p[i : i + 50], pointer[s + i]) == pointer[s + i]
    assert len(set(seen.values())) == len(seen)


def families():
    """Texts in families of edited copies around the threshold, boilerplate shared by many, short and odd texts."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 6)))
    shared = " ".join(word() for _ in range(40))
    rows = []
    for _ in range(14):
        base = [word() for _ in range(r.choice([4, 12, 60, 200]))]
        for _ in range(r.randrange(1, 12)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w) if r.random() < 0.7 else shared + "\n" + " ".join(w).upper())
    rows += [None, "", " \n\t", "one two", "One  TWO", "É two three four five six", "é two three four five six", "x " * 30000, "x " * 29000]
    r.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("chunk", "shingles", "most"), [(2048, 400_000, 2), (3, 300, 1), (3, 300, 0)])
def test_near_components(spark, monkeypatch, chunk, shingles, most):
    for name, value in (("CHUNK", chunk), ("SHINGLES", shingles), ("MOST", most)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = families()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute.near(rows).items()}


def test_near_texts_that_share_an_id(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(5, words(1)), (5, words(2)), (7, words(2) + " end"), (8, words(1) + " end"), (9, words(3)), (9, words(3).upper()), (4, " "), (4, None), (4, None)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, _id int, _hash int, _row int")
    got = collections.Counter(map(tuple, near_dedup.near_components(docs).collect()))
    assert got == collections.Counter([(5, 36, 5, True), (5, 36, 5, True), (7, 37, 5, False), (8, 37, 5, False), (9, 36, 9, True), (9, 36, 9, True), *[(4, 0, 4, True)] * 3])
    stay = near_dedup.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    kept = [(r.doc_id, (r.text or "").strip().lower()) for r in stay.collect()]
    assert sorted(kept) == [(4, ""), (4, ""), (5, words(1)), (5, words(2)), (9, words(3))]


def test_near_rows_without_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "A B C D E F"), (None, None)], "doc_id long, text string")
    got = collections.Counter(map(tuple, near_dedup.near_components(docs).collect()))
    assert got == collections.Counter([(None, 2, None, True), (2, 2, 2, True), (2, 2, 2, True), (5, 2, 2, False), (None, 0, None, True)])
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_duplicates(docs).collect()) == [0, 0, 2]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_components(none).collect() == []
    assert near_dedup.drop_near_duplicates(none).collect() == []
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, j in [(50, 0.8), (2000, 0.6), (30000, 0.9)]:
        both = int(2 * n * j / (1 + j))
        a, b = (np.unique(np.r_[x, rng.integers(0, 2**63, n - both, dtype=np.uint64)]) for x in [rng.integers(0, 2**63, both, dtype=np.uint64) * np.uint64(2)] * 2)
        (d1, t1), (d2, t2) = near_dedup.registers(a), near_dedup.registers(b)
        est, _ = near_dedup.may_link(d1, t1, np.array(len(a)), d2, t2, np.array(len(b)))
        assert abs(est - j) < 0.25


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(5, 5)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    of = {}
    for u, v in edges:
        of.setdefault(u, u), of.setdefault(v, v)
    for _ in range(100):
        for u, v in edges:
            of[u] = of[v] = min(of[u], of[v])
    assert got == {x: c for x, c in of.items() if c != x}
