"""Quality classifier (operator 6).

Random Fourier features approximate a Gaussian kernel over statistics of a document; ridge weights come from normal
equations summed by partition; isotonic regression turns the ridge's output into a probability. Labels are read from
rows whose crc32(doc_id as text) mod 3 is not 1; the score sees the text alone.

Learning reads SAMPLE labelled rows at most, those of the least hashes, so their ids fit into a broadcast and only their
texts are measured. Isotonic regression sees outputs for rows that the weights in use weren't fitted on: normal
equations are kept by fold, and a fold's outputs come from the sums of the others. Every document is then scored in one
pass that sends nothing but its text to Python.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import discard, table, trim, trimmed, written

FEATURES, SEED, RIDGE, CLIP = 192, 6, 1e-3, 6.0
#: Width of the kernel in standard deviations of a statistic, times the square root of their number.
WIDTH = 1.0
#: Labelled rows to learn from at most, and folds for calibration.
SAMPLE, FOLDS = 20_000, 4
#: Steps into which ridge outputs are dealt before isotonic regression; at most this many rows reach the driver.
STEPS, LOW, HIGH = 2000, -1.0, 2.0

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_SENTENCE = np.zeros(256, bool)
_SENTENCE[list(b".,;:?!'\"()-")] = True
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58)))
_MIXED = re.compile(rb"[^\w\s]{2}", re.ASCII)
STATISTICS = 24


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; an empty one gives zeros."""
    b = text.encode()
    if not b:
        return [0.0] * STATISTICS
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    n, words, lines = len(b), b.split(), b.split(b"\n")
    share = count[count > 0] / n
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    full = [x for x in lines if x.strip()]
    k = max(1, len(full))
    ends = sum(x[-1:] in b".?!" for x in full) / k
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), count[_UPPER].sum() / letters, count[_DIGIT].sum() / n,
        count[_SYMBOLS].sum() / n, count[_SENTENCE].sum() / n, count[128:].sum() / n, count[33] / m, count[124] / m, count[37] / m,
        -(share * np.log2(share)).sum(), len(seen) / m, max(seen.values(), default=0) / m, 1 - pairs / max(1, len(words) - 1),
        sum(x == y for x, y in zip(words, words[1:])) / m, len(_MIXED.findall(b)) / m, np.log1p(len(lines)), np.log1p(n / len(lines)),
        1 - len(set(full)) / k, ends, sum(w[-1:] in b".,!?;:" for w in words) / m, sum(w.isupper() for w in words) / m,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None
    at: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; one half throughout where no label was there to learn from."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(fourier(x, self.mean, self.spread) @ self.weights, self.at, self.value)


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant one."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(x.shape[1], FEATURES)) / (WIDTH * np.sqrt(x.shape[1]))
    turn = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / spread, -CLIP, CLIP) @ w + turn
    return np.hstack([np.cos(z) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def isotonic(at: np.ndarray, rows: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the ends of each pool of points in ascending order, and its share of ones."""
    pools: list[list[float]] = []
    for a, n, y in zip(at, rows, ones):
        pools.append([n, y, a, a])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, y, _, end = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + y, pools[-1][2], end]
    return np.array([x for p in pools for x in p[2:]]), np.repeat([p[1] / p[0] for p in pools], 2)


def is_held_out() -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(3)) == 1


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, STATISTICS)


def _measured(texts: Iterable[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float32).astype(float).reshape(-1, STATISTICS)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _measured(t.as_py() for t in batch["text"]).ravel()
        ends = pa.array(np.arange(0, len(x) + 1, STATISTICS), pa.int32())
        yield pa.RecordBatch.from_arrays([batch["y"], batch["fold"], pa.ListArray.from_arrays(ends, pa.array(x))], names=["y", "fold", "x"])


def _normal(mean: np.ndarray, spread: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, y, fold = fourier(_stack(batch["x"]), mean, spread), batch["y"].to_numpy(), batch["fold"].to_numpy()
            for k in range(FOLDS):
                g[k] += z[fold == k].T @ np.hstack([z, y[:, None]])[fold == k]
        at = pa.array(np.arange(FOLDS * (FEATURES + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([at, pa.array(list(g.reshape(-1, FEATURES + 2)), pa.list_(pa.float64()))], names=["at", "g"])

    return run


def _total(t: pa.Table) -> pa.Table:
    g = np.asarray(t["g"].combine_chunks().flatten()).reshape(t.num_rows, -1).sum(axis=0)
    return pa.table({"at": t["at"][:1], "g": pa.array([g], pa.list_(pa.float64()))})


def _solved(g: np.ndarray) -> np.ndarray:
    """Ridge weights; the last feature is one throughout, so the sum of its square counts the rows."""
    return np.linalg.solve(g[:, :-1] + RIDGE * max(1.0, g[-1, -2]) / FEATURES * np.eye(FEATURES + 1), g[:, -1])


def _outputs(mean: np.ndarray, spread: np.ndarray, by_fold: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = (fourier(_stack(batch["x"]), mean, spread) * by_fold[batch["fold"].to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out), batch["y"]], names=["out", "y"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows that aren't held out; sums of features and steps reach the driver."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    train = written(texts.join(F.broadcast(known), "doc_id").select("text", "y", "fold").mapInArrow(trimmed(_statistics), "y int, fold int, x array<double>"), "labelled")
    at = range(STATISTICS)
    got = train.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in at for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not got["n"]:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, np.zeros(1), np.zeros(1))
    mean, spread = (np.array([got[f"{k}{i}"] for i in at]) for k in "ms")
    spread = np.maximum(spread, 1e-3)
    g = np.zeros((FOLDS * (FEATURES + 1), FEATURES + 2))
    for r in train.mapInArrow(_normal(mean, spread), "at int, g array<double>").groupBy("at").applyInArrow(_total, "at int, g array<double>").collect():
        g[r["at"]] = r["g"]
    g = g.reshape(FOLDS, FEATURES + 1, FEATURES + 2)
    by_fold = np.array([_solved(g.sum(axis=0) - g[k]) for k in range(FOLDS)])
    step = F.least(F.greatest(F.floor((F.col("out") - LOW) / (HIGH - LOW) * STEPS), F.lit(0)), F.lit(STEPS - 1))
    steps = train.mapInArrow(_outputs(mean, spread, by_fold), "out double, y int").groupBy(step.alias("step")).agg(F.avg("out").alias("at"), F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("step").collect()
    discard(train)
    return Model(mean, spread, _solved(g.sum(axis=0)), *isotonic(*(np.array([r[k] for r in steps], float) for k in ("at", "n", "y"))))


def score_column(model: Model, text: str = "text") -> Column:
    """The score as a column; only ``text`` goes to Python."""

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for t in texts:
                yield pa.array(model.score(_measured(x.as_py() for x in t)))
        finally:
            trim()

    return F.arrow_udf(scores, "double")(F.col(text))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    A null text is an empty one; a null doc_id counts as the empty string for the fold and has no label; labels other
    than 0 and 1 are left out; repeated rows score alike; without any label all scores are 0.5. Other columns aren't
    read. An empty table gives an empty one.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), score_column(fit(docs, labels, sample)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, whole; the edge cases are those of ``quality_scores``."""
    return docs.filter(score_column(fit(docs, labels, sample)) >= least)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
