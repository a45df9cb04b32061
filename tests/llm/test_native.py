"""Mixing and line dedup against plain Python on small tables with awkward rows."""

import collections

import pytest

from quernstone.llm import line_dedup, mixing
from tests.llm import brute

ROWS = [
    (1, "a b c\nmenu\n\nend", "s1", 7), (2, "menu \nother words here", "s2", 7), (3, " menu", "s3", 7), (4, "menu\nmenu", "s4", 7),
    (5, "menu\nlast", "s5", 7), (6, None, "s1", 7), (7, "", None, 7), (8, "menu\n" + "x " * 50000, None, 7), (9, "same", "s1", 7),
    (9, "same", "s1", 7), (None, "menu\nnull id", "s2", 7), (10, "rare\nrare", "s1", None),
]
SCHEMA = "doc_id long, text string, source string, level int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("least", [2, 5, 6, 7])
def test_line_dedup(docs, least):
    got = [tuple(r) for r in line_dedup.dedup_lines(docs, least).collect()]
    assert collections.Counter(got) == collections.Counter(brute.lines(ROWS, least))


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_mix(docs):
    sizes = collections.Counter()
    for _, t, s, _ in ROWS:
        sizes[s] += len(brute.WORD.findall(t or ""))
    got = {r.source: r.target for r in mixing.source_targets(docs.select("source", mixing.n_words().alias("size"))).collect()}
    assert got == pytest.approx(brute.targets(sizes))
    assert collections.Counter(tuple(r) for r in mixing.mix(docs).collect()) == brute.mixed(ROWS)


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
