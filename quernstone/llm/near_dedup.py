"""Near-duplicate components by HyperMinHash (operator 10).

A register keeps the leading-zero count and a few mantissa bits of the least hash in its bucket. Bands of registers
give candidates; a Jaccard estimate from the registers, corrected for chance collisions of compressed values, drops
what is clearly too far apart; the rest is confirmed on full shingle sets.

Documents with equal shingle sets are one class, a node of the graph. Three rounds find its links.
1. Each node of a bucket is held against the bucket's smallest.
2. Buckets that still hold several components: sketches alone meet in groups of bounded size. Of the pairs across
   components whose estimate allows a link, each node puts forward its likeliest few; these are confirmed. Of the others
   only their nodes are noted, so a group sends out no more than a few rows a node.
3. Noted nodes of buckets that hold several components even now meet with their texts, in groups bounded by the size of
   their sets. A link found joins components at once, so that what is joined isn't compared again.
No pair that decides a component is left out, and texts travel only for what sketches couldn't settle.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import discard, release, table, trimmed, written
from quernstone.llm.components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
BANDS, ROWS = 50, 5
REGISTERS = BANDS * ROWS
#: Bits of the mantissa; leading-zero counts up to 14 are told apart, 255 marks an empty bucket.
MANTISSA, MOST_ZEROS, EMPTY = 4, 14, 255
#: Standard errors under the threshold at which an estimate still passes.
ERRORS = 5.0
#: Nodes of a bucket, and shingles of those that bring texts, in one chunk (about, at most); larger buckets are dealt as
#: pairs of chunks.
CHUNK, SHINGLES = 2048, 400_000
#: Pairs that a node puts forward in a group.
MOST = 2

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(10)
_FACTORS = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_PROBES = np.array([_RNG.permutation(REGISTERS) for _ in range(REGISTERS)], np.int16)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    a = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(a) - WORDS + 1
    h = a[:n] * _FACTORS[0]
    for k in range(1, WORDS):
        h = h + a[k : k + n] * _FACTORS[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(29)))


def registers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compressed registers with empty buckets filled from others, and which buckets were occupied."""
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least = np.minimum.reduceat(h & np.uint64(0xFFFFFFFF), starts).astype(np.uint64)
    bits = np.frexp(least.astype(float))[1]
    zeros = np.minimum(32 - bits, MOST_ZEROS)
    shift = np.maximum(bits - 1 - MANTISSA, 0)
    mantissa = np.where(bits > MANTISSA, (least >> shift.astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1), 0)
    own = np.full(REGISTERS, EMPTY, np.uint8)
    own[bucket[starts]] = (zeros << MANTISSA) | mantissa.astype(np.int64)
    there = own != EMPTY
    holes = np.flatnonzero(~there)
    if len(holes):
        probes = _PROBES[holes]
        own[holes] = own[probes[np.arange(len(holes)), there[probes].argmax(axis=1)]]
    return own, there


def _cells(n: np.ndarray) -> np.ndarray:
    """Chance of each compressed value for the least of a bucket, for sets of n shingles."""
    zeros, mantissa = np.divmod(np.arange((MOST_ZEROS + 1) << MANTISSA), 1 << MANTISSA)
    low = 2.0 ** -(zeros + 1) * (1 + mantissa / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    low = np.where(zeros == MOST_ZEROS, low - 2.0 ** -(zeros + 1), low)
    rate = (n / REGISTERS)[:, None]
    p = np.exp(-rate * low) - np.exp(-rate * high)
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


_SIZES = 4
_CHANCE = (lambda c: c @ c.T)(_cells(2.0 ** (np.arange(32 * _SIZES) / _SIZES)))


def may_link(d1: np.ndarray, t1: np.ndarray, n1: np.ndarray, d2: np.ndarray, t2: np.ndarray, n2: np.ndarray, errors: float = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates, corrected for collisions, of rows against rows, and whether they allow a link."""
    either = (t1 | t2).sum(axis=-1)
    same = ((d1 == d2) & t1 & t2).sum(axis=-1)
    size = lambda n: np.minimum((np.log2(np.maximum(n, 1)) * _SIZES).astype(int), len(_CHANCE) - 1)
    chance = _CHANCE[size(n1), size(n2)]
    j = (same / np.maximum(either, 1) - chance) / (1 - chance)
    t = NUMERATOR / DENOMINATOR
    sizes = DENOMINATOR * np.minimum(n1, n2) >= NUMERATOR * np.maximum(n1, n2)
    return j, sizes & (j >= t - errors * np.sqrt(t * (1 - t) / np.maximum(either, 1)))


_SKETCH = "doc_id long, h long, n_shingles long, lo long, hi long, dense binary, there binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        n, lo, hi, dense, there = [], [], [], [], []
        for t in batch["text"]:
            h = shingles((t.as_py() or "").encode())
            n.append(len(h))
            if not len(h):
                for x in (lo, hi, dense, there):
                    x.append(None)
                continue
            digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
            d, e = registers(h)
            lo.append(int(digest[0]))
            hi.append(int(digest[1]))
            dense.append(d.tobytes())
            there.append(np.packbits(e).tobytes())
        arrays = [batch["doc_id"], batch["h"], pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(dense, pa.binary()), pa.array(there, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SKETCH.split(", ")])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power, band = 256 ** np.arange(ROWS, dtype=np.int64), np.arange(BANDS, dtype=np.int64) << 40
    for batch in batches:
        d = np.frombuffer(b"".join(batch["dense"].to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
        keys = (d.astype(np.int64) @ power + band).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["node"].to_numpy(), BANDS)), pa.array(keys)], names=["node", "key"])


def _rows(binary: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), np.uint8).reshape(-1, width)


def _there(binary: pa.Array) -> np.ndarray:
    width = -(-REGISTERS // 8)
    return np.unpackbits(_rows(binary, width), axis=1)[:, :REGISTERS].astype(bool)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            sides = [x for s in "12" for x in (_rows(part[f"dense{s}"], REGISTERS), _there(part[f"there{s}"]), part[f"n{s}"].to_numpy())]
            _, ok = may_link(*sides)
            yield pa.RecordBatch.from_arrays([part["u"].filter(pa.array(ok)), part["v"].filter(pa.array(ok))], names=["u", "v"])


class _Sets:
    """Shingle sets of the last few texts."""

    def __init__(self, most: int = 256):
        self.most, self.sets = most, OrderedDict()

    def __call__(self, key: int, text: str | None) -> np.ndarray:
        if key not in self.sets:
            self.sets[key] = shingles((text or "").encode())
            if len(self.sets) > self.most:
                self.sets.popitem(last=False)
        return self.sets[key]


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets()
    for batch in batches:
        ok = [_linked(sets(u, tu.as_py()), sets(v, tv.as_py())) for u, v, tu, tv in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), batch["text1"], batch["text2"])]
        yield pa.RecordBatch.from_arrays([batch["u"].filter(pa.array(ok, pa.bool_())), batch["v"].filter(pa.array(ok, pa.bool_()))], names=["u", "v"])


def _allowed(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each node of a group, the places and estimates of those it may be linked with, likeliest first.

    Each pair comes once, from its smaller set, if its sides differ, the components it has at first do, and the group's
    band is the first that it has in common.
    """
    band = t["key"][0].as_py() >> 40
    side, comp, n, node = (t[x].to_numpy() for x in ("side", "comp", "n", "node"))
    dense, there = _rows(t["dense"], REGISTERS), _there(t["there"])
    order = np.lexsort((node, n))
    most = np.searchsorted(n[order], n[order] * DENOMINATOR // NUMERATOR, side="right")
    for x, i in enumerate(order.tolist()):
        j = order[x + 1 : most[x]]
        j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] < 0))]
        if not len(j):
            continue
        est, ok = may_link(dense[i], there[i], n[i], dense[j], there[j], n[j])
        j, est = j[ok], est[ok]
        first = (dense[i].reshape(BANDS, ROWS) == dense[j].reshape(-1, BANDS, ROWS)).all(axis=2).argmax(axis=1) == band
        j, est = j[first], est[first]
        o = np.lexsort((node[j], -est))
        if len(o):
            yield i, j[o], est[o]


def _forward(most: int) -> Callable[[pa.Table], list[tuple]]:
    def run(t: pa.Table) -> list[tuple[int, int, int | None]]:
        """(key, u, v) of the pairs that nodes put forward, and (key, node, null) of the nodes in other pairs."""
        key, node, out, noted = t["key"][0].as_py(), t["node"].to_numpy(), [], set()
        for i, j, _ in _allowed(t):
            out += [(key, *sorted((int(node[i]), int(node[k])))) for k in j[:most]]
            if len(j) > most:
                noted.update([i, *j[most:].tolist()])
        return out + [(key, int(node[i]), None) for i in noted]

    return run


def _group_links(t: pa.Table) -> list[tuple[int, int, int]]:
    """(key, u, v) of links across components in one group, whose nodes have their texts."""
    key, node, comp, sets, out = t["key"][0].as_py(), t["node"].to_numpy(), t["comp"].to_numpy().copy(), {}, []

    def own(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles((t["text"][k].as_py() or "").encode())
        return sets[k]

    for i, j, _ in _allowed(t):
        for k in j.tolist():
            if comp[k] != comp[i] and _linked(own(i), own(k)):
                out.append((key, min(int(node[i]), int(node[k])), max(int(node[i]), int(node[k]))))
                comp[comp == comp[k]] = comp[i]
    return out


_DEALT = ("key", "c1", "c2")


def _grouped(function: Callable[[pa.Table], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` on each group; rows come sorted by group, and the last group of a batch may go on in the next."""

    def found(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        columns = [t[x].to_numpy() for x in _DEALT]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
        out = [x for a, b in zip(starts, [*starts[1:], t.num_rows]) for x in function(t.slice(a, b - a))]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["key", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch[x].to_numpy() == batch[x][-1].as_py() for x in _DEALT]
            cut = int(np.logical_and.reduce(last).argmax())
            if held and (cut or any(held[-1][x][-1].as_py() != batch[x][-1].as_py() for x in _DEALT)):
                yield found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield found(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    first = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text1")), "u")
    return first.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text2")), "v").mapInArrow(trimmed(_confirmed), "u long, v long")


def _estimate(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    for side, s in (("u", "1"), ("v", "2")):
        own = reps.select(F.col("node").alias(side), F.col("dense").alias(f"dense{s}"), F.col("there").alias(f"there{s}"), F.col("n").alias(f"n{s}"))
        pairs = pairs.join(own, side)
    return pairs.mapInArrow(trimmed(_estimated), "u long, v long")


def _several(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, comp) of ``members`` (key, node) in buckets of several components."""
    known = members.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    several = known.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("key")
    return known.join(several, "key")


def _dealt(members: DataFrame, chunks: DataFrame, of: DataFrame) -> DataFrame:
    """Members in chunks of their bucket, each once per pair of chunks, with the columns of ``of``, sorted by group.

    ``chunks`` has each bucket's number of chunks.
    """
    rows = members.join(chunks, "key").withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    side = F.when(F.col("c") == F.col("other"), F.lit(-1)).otherwise(F.col("c")).alias("side")
    rows = rows.select("key", F.least("c", "other").alias("c1"), F.greatest("c", "other").alias("c2"), side, "node", "comp").join(of, "node")
    return rows.repartition(*_DEALT).sortWithinPartitions(*_DEALT, "node")


def _links(reps: DataFrame, texts_of: Callable[[DataFrame], DataFrame], spark: SparkSession) -> DataFrame:
    """The components (id, component) of nodes; ``texts_of`` gives (node, text) of nodes."""
    bands = reps.select("node", "dense").mapInArrow(trimmed(_bands), "node long, key long")
    shared = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")
    members = written(bands.join(shared, "key"), "members")
    release(spark)
    texts = written(texts_of(members.select("node").distinct()), "texts")
    star = members.filter("node > leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    links = written(_confirm(_estimate(star, reps), texts), "links")
    release(spark)
    found = components(links)

    sketches = reps.select("node", "n", "dense", "there")
    open_members = written(_several(members.filter("size > 2").select("key", "node"), found), "open")
    if open_members.isEmpty():
        discard(members, open_members, links, texts)
        return found
    size = open_members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    put = written(_dealt(open_members, size, sketches).mapInArrow(trimmed(_grouped(_forward(MOST))), "key long, u long, v long"), "forward")
    discard(open_members, members)
    release(spark)
    more = written(_confirm(put.filter("v IS NOT NULL").select("u", "v").distinct(), texts), "links")
    joined = found if more.isEmpty() else components(links.unionByName(more))

    noted = put.filter("v IS NULL").select("key", F.col("u").alias("node")).distinct()
    left = written(_several(noted, joined), "noted")
    if left.isEmpty():
        discard(links, more, put, texts, left)
        return joined
    weight = left.join(reps.select("node", "n"), "node").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / SHINGLES)).alias("chunks"))
    last = _dealt(left, weight, sketches.join(texts, "node")).mapInArrow(trimmed(_grouped(_group_links)), "key long, u long, v long")
    last = written(last.select("u", "v").distinct(), "links")
    out = components(links.unionByName(more).unionByName(last))
    discard(links, more, last, put, texts, left, joined)
    return out


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, node, root, component_id) for each row; h: hash of the text.

    node is the row's class and root that of its component's least node, both null without shingles or doc_id.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    sketches = written(own.mapInArrow(trimmed(_sketch), _SKETCH), "sketches")
    named = sketches.filter(F.col("lo").isNotNull() & F.col("doc_id").isNotNull())
    head = F.min(F.struct("doc_id", "h", F.col("n_shingles").alias("n"), "dense", "there")).alias("head")
    classes = named.groupBy("lo", "hi").agg(head).select("lo", "hi", F.col("head.doc_id").alias("id"), "head.h", "head.n", "head.dense", "head.there")
    reps = written(classes.withColumn("node", F.monotonically_increasing_id()), "representatives")

    def texts_of(nodes: DataFrame) -> DataFrame:
        places = reps.select("id", "h", "node").join(nodes, "node")
        return own.withColumnRenamed("doc_id", "id").join(places, ["id", "h"]).dropDuplicates(["id", "h"]).select("node", "text")

    found = _links(reps, texts_of, spark)
    release(spark)
    tied = found.join(reps.select(F.col("node").alias("id"), F.col("id").alias("least")), "id")
    roots = reps.select(F.col("node").alias("component"), F.col("id").alias("own"))
    least = tied.groupBy("component").agg(F.min("least").alias("least")).join(roots, "component").select("component", F.least("least", "own").alias("component_id"))
    linked = tied.select(F.col("id").alias("node"), "component").join(least, "component")
    linked = linked.unionByName(least.select(F.col("component").alias("node"), "component", "component_id"))
    named_reps = reps.select("lo", "hi", "id", "node").join(linked, "node", "left")
    of_class = named_reps.select("lo", "hi", "node", F.coalesce("component", "node").alias("root"), F.coalesce("component_id", "id").alias("label"))
    blank = F.col("doc_id").isNull()
    joined = sketches.select("doc_id", "h", "n_shingles", "lo", "hi").join(of_class, ["lo", "hi"], "left")
    return joined.select("doc_id", "h", "n_shingles", *(F.when(~blank, F.col(x)).alias(x) for x in ("node", "root")), F.when(~blank, F.coalesce("label", "doc_id")).alias("component_id"))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked when 100 * shared shingles >= 75 * all shingles of both. A null or empty text and one of
    white space only have no shingles and no links. A null doc_id has no links either: its component is null and it is
    kept. Rows that share a doc_id but not their shingles each have the component of their own text. Other columns
    aren't read. An empty table gives an empty one.
    """
    out = _labelled(docs).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, with all their columns.

    A component keeps the text of its smallest doc_id (of several such, the one with the least hash). A null, empty or
    blank text is linked with nothing and stays. Of rows that repeat doc_id and text one stays. Rows without a doc_id
    all stay. Names of other columns don't matter. An empty table gives an empty one.
    """
    labelled = _labelled(docs).filter(F.col("doc_id").isNotNull())
    first = labelled.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("first.*")
    blank = labelled.filter(F.col("root").isNull()).select("doc_id", "h")
    taken = set(docs.columns)
    d, h, n = (next(x for x in (f"_{name}{'_' * k}" for k in range(99)) if x not in taken) for name in ("id", "hash", "row"))
    kept = written(first.unionByName(blank).distinct(), "kept").toDF(d, n)
    named = docs.filter(F.col("doc_id").isNotNull())
    stay = named.withColumn(h, F.xxhash64("text")).join(kept, (F.col("doc_id") == F.col(d)) & (F.col(h) == F.col(n)), "left_semi")
    return stay.dropDuplicates(["doc_id", h]).select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN b ON r.seen = b.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
