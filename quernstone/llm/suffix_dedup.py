"""Removal of repeated byte strings with suffix buckets (operator 1).

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id. Equal
strings are found as a suffix array's buckets of that depth, built by bucket-pointer refinement: suffixes are dealt into
buckets by their first q bytes, and a bucket is split by sorting its suffixes on the bucket pointers at later offsets,
so that depth doubles and each round reuses the pointers of the last.

To keep this off one machine, windows of LENGTH bytes are dealt by the least hash among their 16-byte strings: equal
windows have equal least hashes and meet in one part. Runs of windows with one least hash travel together as a short
context, only where another document has that hash, and once per block of documents however often the block holds them.
A passage that a third of all documents share so costs a part one context per block, not one per document.
Several parts travel as one group, so that blocks send few and long messages, and are worked on one after another.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import release, table, text_or_empty, written

LENGTH, GRAM = 50, 16
#: Windows of a context at most, and its bytes rounded up to words of 8.
RUN = LENGTH - GRAM + 1
PAD = -(-(RUN - 1 + LENGTH) // 8) * 8
#: Bytes of text in a block of documents, in a part (by share of least hashes) and in a step of hashing.
BLOCK, PART, STEP = 8_000_000, 2_500_000, 1_000_000
#: Parts in a group: a block sends one message to each group.
GROUP = 8

_LAST = 2**63 - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MIX = np.random.default_rng(1).integers(1, 2**63, PAD // 8, dtype=np.uint64) | np.uint64(1)


def _words(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    for n in (1, 2, 4):
        x = x[:-n].astype((np.uint16, np.uint32, np.uint64)[n // 2]) << np.uint8(8 * n) | x[n:]
    return x


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(29)
    return h


def runs(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first window, windows) of each run of up to RUN windows of one document with one least hash.

    ``starts`` has each document's start in ``buf`` and, last, the end.
    """
    out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    d, docs = 0, len(starts) - 1
    while d < docs:
        e = d + 1
        while e < docs and starts[e + 1] - starts[d] <= STEP:
            e += 1
        lo, hi = starts[d], starts[e]
        if hi - lo >= LENGTH:
            w = _words(buf[lo:hi])
            h = _mixed(w[:-8] * _M1 + w[8:])
            n = 1
            while 2 * n <= RUN:
                h = np.minimum(h[:-n], h[n:])
                n *= 2
            h = np.minimum(h[: len(h) - (RUN - n)], h[RUN - n :])
            own = np.repeat(np.arange(d, e), np.diff(starts[d : e + 1]))
            at = np.flatnonzero(starts[own[: len(h)] + 1] - lo >= np.arange(len(h)) + LENGTH)
            v, o = h[at], own[at]
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])]) if len(at) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(at)])
            pieces = -(-size // RUN)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.repeat(first, pieces) + k * RUN
            size = np.minimum(np.repeat(size, pieces) - k * RUN, RUN)
            for a, x in zip(out, (v[begin] * _M1, o[begin], at[begin] + lo, size)):  # least hashes are small: spread them again
                a.append(x)
        d = e
    return tuple(np.concatenate(x) for x in out)


class Block:
    """The documents of a block in order of doc_id (null last) and text, as one buffer."""

    def __init__(self, t: pa.Table):
        rows = sorted((_LAST if d is None else d, x) for d, x in zip(t["doc_id"].to_pylist(), (x.as_py().encode() for x in t["text"])))
        self.ids = np.array([d for d, _ in rows], np.int64)
        self.buf = np.frombuffer(b"".join(x for _, x in rows), np.uint8)
        self.starts = np.r_[0, np.cumsum([len(x) for _, x in rows])].astype(np.int64)

    def keys(self, parts: int) -> tuple[np.ndarray, ...]:
        """The runs, then for distinct hashes: hash, part, and whether two documents of the block have it; each run's index."""
        h, doc, at, size = runs(self.buf, self.starts)
        distinct, inverse = np.unique(h, return_inverse=True)
        lo, hi = np.full(len(distinct), _LAST), np.full(len(distinct), -_LAST)
        o = np.argsort(inverse, kind="stable")
        if len(o):
            cut = np.flatnonzero(np.r_[True, np.diff(inverse[o]) > 0])
            lo, hi = np.minimum.reduceat(self.ids[doc[o]], cut), np.maximum.reduceat(self.ids[doc[o]], cut)
        part = (distinct >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        return h, doc, at, size, distinct, part.astype(np.int64), lo != hi, inverse


def _hashes(parts: int):
    """Per block and group of parts, the distinct least hashes, five bytes of each (the group is known from the top bits)."""

    def run(t: pa.Table) -> pa.Table:
        *_, distinct, part, _, _ = Block(t).keys(parts)
        five = (distinct & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]
        full, cut = np.unique(part // GROUP, return_index=True)
        return pa.table({"parts": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), t["block"][0].as_py()), pa.int64()), "h": pa.array([x.tobytes() for x in np.split(five, cut[1:])][: len(full)], pa.binary())})

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Which of a group's hashes other blocks have too, as bits for each block."""
    raw = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5) for x in t["h"]]
    wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
    wide[:, :5] = np.concatenate(raw)
    _, inverse, n = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    bits = np.split(n[inverse] > 1, np.cumsum([len(x) for x in raw])[:-1])
    return pa.table({"block": t["block"], "parts": t["parts"], "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _matrix(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The contexts as rows of PAD bytes, zero after their end."""
    wide = np.concatenate([buf, np.zeros(PAD, np.uint8)])
    m = np.lib.stride_tricks.sliding_window_view(wide, PAD)[at]
    m[np.arange(PAD) >= (size + LENGTH - 1)[:, None]] = 0
    return m


def _alike(m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each set of equal contexts, and each context's set."""
    h = size.astype(np.uint64) * _M1
    w = np.ascontiguousarray(m).view(np.uint64)
    for k in range(w.shape[1]):
        h = (h ^ (h >> np.uint64(31))) * _M2 + w[:, k] * _MIX[k]
    _, first, inverse = np.unique(_mixed(h), return_index=True, return_inverse=True)
    odd = np.flatnonzero((w != w[first[inverse]]).any(axis=1) | (size != size[first[inverse]]))
    inverse[odd] = len(first) + np.arange(len(odd))  # unequal despite equal hashes: sets of their own
    return np.r_[first, odd], inverse


_SENT = ("docs", "sizes", "bytes", "ctx", "row", "pos")
_CONTEXTS = f"block long, parts int, sent array<struct<part:int,{','.join(f'{x}:binary' for x in _SENT)}>>, row binary, pos binary, end binary"
_KINDS = pa.schema([("block", pa.int64()), ("parts", pa.int32()), ("sent", pa.list_(pa.struct([("part", pa.int32())] + [(x, pa.binary()) for x in _SENT])))] + [(x, pa.binary()) for x in ("row", "pos", "end")])


def _contexts(parts: int):
    """Per block and group of parts, the distinct contexts of each part; in group -1, what is repeated within the block."""

    def run(t: pa.Table, masks: pa.Table) -> pa.Table:
        import zstandard

        if not t.num_rows:
            return _KINDS.empty_table()
        block = Block(t)
        h, doc, at, size, distinct, part, shared, inverse = block.keys(parts)
        for p, bits in zip(masks["parts"].to_pylist(), masks["bits"]):
            a, b = np.searchsorted(part, [p * GROUP, (p + 1) * GROUP])
            shared[a:b] |= np.unpackbits(np.frombuffer(bits.as_py(), np.uint8))[: b - a].astype(bool)
        take = np.flatnonzero(shared[inverse])
        doc, at, size, part = doc[take], at[take], size[take], part[inverse[take]]
        m = _matrix(block.buf, at, size)
        first, ctx = _alike(m, size)  # documents ascend, so the first has the least doc_id
        least = block.ids[doc[first]]
        pos = at - block.starts[doc]
        own = block.ids[doc] == least[ctx]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        rows = {x: [] for x in _KINDS.names}

        def add(p: int, *more) -> None:
            for x, y in zip(_KINDS.names, (t["block"][0].as_py(), p, *more)):
                rows[x].append(y)

        four = lambda x: np.asarray(x, np.uint32).tobytes()
        later = np.flatnonzero(~own)
        if len(later):
            r, a, b = _joined(doc[later], pos[later], pos[later] + size[later] + LENGTH - 1)
            add(-1, None, four(r), four(a), four(b))
        by_part = np.argsort(part[first], kind="stable")
        full, edges = np.unique(part[first][by_part], return_index=True)
        edges = [*edges, len(first)]
        place = np.empty(len(first), np.int64)
        place[by_part] = np.arange(len(first))
        occ = np.flatnonzero(own)
        occ = occ[np.argsort(place[ctx[occ]], kind="stable")]
        where, sent = place[ctx[occ]], {}
        for p, a, b in zip(full.tolist(), edges, edges[1:]):
            f = first[by_part[a:b]]
            o = occ[np.searchsorted(where, a) : np.searchsorted(where, b)]
            inside = np.arange(PAD) < (size[f] + LENGTH - 1)[:, None]
            own = (block.ids[doc[f]].tobytes(), size[f].astype(np.uint8).tobytes(), squeeze(m[f][inside].tobytes()), four(place[ctx[o]] - a), four(doc[o]), four(pos[o]))
            sent.setdefault(p // GROUP, []).append({"part": p, **dict(zip(_SENT, own))})
        for p, parts_sent in sent.items():
            add(p, parts_sent, None, None, None)
        return pa.table(rows, _KINDS)

    return run


def _joined(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals with those of one document that touch made one."""
    o = np.lexsort((a, doc))
    doc, a, b = doc[o], a[o], b[o]
    far = np.maximum.accumulate(b + doc * (1 << 32)) - doc * (1 << 32)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] > far[:-1])])
    return doc[new], a[new], far[np.r_[new[1:] - 1, len(doc) - 1]] if len(doc) else b


def _group_starts(changes: np.ndarray) -> np.ndarray:
    """For each item the index at which its group starts, from whether each item but the first differs from the last."""
    starts = np.r_[0, np.flatnonzero(changes) + 1]
    return np.repeat(starts, np.diff(np.r_[starts, len(changes) + 1]))


def bucket_pointers(text: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each position of the concatenated strings, the pointer to its bucket among suffixes equal for ``depth`` bytes.

    Only positions with ``depth`` bytes left in their string have one, -1 stands elsewhere. Bucket-pointer refinement:
    buckets by the first 8 bytes, then each bucket of several suffixes is sorted on the pointers ``step`` bytes later.
    """
    left = np.repeat(start + size, size) - np.arange(len(text))
    at = np.flatnonzero(left >= 8)
    pointer = np.full(len(text), -1, np.int64)
    if len(at):
        w = _words(np.concatenate([text, np.zeros(7, np.uint8)]))[at]
        o = np.argsort(w)
        w = w[o]
        pointer[at[o]] = _group_starts(w[1:] != w[:-1])
        del w, o
    reach = 8
    while reach < depth:
        step = min(reach, depth - reach)
        at = np.flatnonzero(left >= reach + step)
        size_of = np.bincount(pointer[at], minlength=1) if len(at) else np.zeros(1, int)
        several = at[size_of[pointer[at]] > 1]
        key = pointer[several] << 32 | pointer[several + step]
        o = np.argsort(key)
        key = key[o]
        pointer[left < reach + step] = -1
        if len(o):
            inside = _group_starts(key[1:] != key[:-1]) - _group_starts(key[1:] >> 32 != key[:-1] >> 32)
            pointer[several[o]] = (key >> 32) + inside
        reach += step
    return pointer


_FOUND = "block long, row binary, pos binary, end binary"


def _refined(t: pa.Table) -> pa.Table:
    """For each block that sent contexts, the intervals whose windows start in a smaller document elsewhere."""
    sent = t["sent"].combine_chunks()
    each = pa.Table.from_arrays([pc.take(t["block"].combine_chunks(), pc.list_parent_indices(sent)), *sent.flatten().flatten()], ["block", "part", *_SENT])
    found: dict[int, list] = {}
    for p in pc.unique(each["part"]):
        for b, *intervals in _refined_part(each.filter(pc.equal(each["part"], p))):
            found.setdefault(b, []).append(intervals)
    joined = [(b, *(b"".join(x) for x in zip(*lists))) for b, lists in found.items()]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in joined], k) for i, k in enumerate(kinds)], names=["block", "row", "pos", "end"])


def _refined_part(t: pa.Table) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(block, documents, starts, ends) of one part's intervals."""
    import zstandard

    read = zstandard.ZstdDecompressor().decompress
    docs = [np.frombuffer(x.as_py(), np.int64) for x in t["docs"]]
    count = np.array([len(x) for x in docs])
    doc = np.concatenate(docs)
    size = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["sizes"]]).astype(np.int64)
    text = np.frombuffer(b"".join(read(x.as_py()) for x in t["bytes"]), np.uint8)
    length = size + LENGTH - 1
    first, ctx = _alike(_matrix(text, np.cumsum(length) - length, size), size)
    o = np.argsort(ctx, kind="stable")
    least = np.minimum.reduceat(doc[o], np.flatnonzero(np.r_[True, np.diff(ctx[o]) > 0]))
    # the distinct contexts as one text
    n = length[first]
    begin = np.cumsum(n) - n
    source = np.repeat((np.cumsum(length) - length)[first] - begin, n) + np.arange(n.sum())
    pointer = bucket_pointers(text[source], begin, n)
    at = np.flatnonzero(pointer >= 0)
    o = at[np.argsort(pointer[at], kind="stable")]
    owner = np.repeat(np.arange(len(first)), n)
    new = np.r_[True, np.diff(pointer[o]) > 0]
    smallest = np.empty(len(pointer), np.int64)
    smallest[o] = np.minimum.reduceat(least[owner[o]], np.flatnonzero(new))[np.cumsum(new) - 1]
    # windows of every context sent, and runs of those that start in a smaller document
    entry = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size)
    gone = smallest[begin[ctx[entry]] + k] < doc[entry]
    same = np.r_[False, entry[1:] == entry[:-1]]
    opens = np.flatnonzero(gone & ~(same & np.r_[False, gone[:-1]]))
    closes = np.flatnonzero(gone & ~np.r_[same[1:] & gone[1:], False])
    runs_of = np.bincount(entry[opens], minlength=len(size))
    run_at = np.cumsum(runs_of) - runs_of
    base = np.cumsum(count) - count
    for b, e0, c, row, pos in zip(t["block"].to_pylist(), base, t["ctx"], t["row"], t["pos"]):
        e, row, pos = (np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in (c, row, pos))
        e = e + e0
        m = runs_of[e]
        if not m.sum():
            continue
        r = np.repeat(run_at[e], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        p = np.repeat(pos, m)
        found = _joined(np.repeat(row, m), p + k[opens[r]], p + k[closes[r]] + LENGTH)
        yield b, *(z.astype(np.uint32).tobytes() for z in found)


def _cut(t: pa.Table, found: pa.Table) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """(doc_id, bytes, whether each goes) of each document of a block."""
    block = Block(t)
    row, a, b = (np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.as_py(), np.uint32) for x in found[c])]).astype(np.int64) for c in ("row", "pos", "end"))
    n = len(block.buf) + 1
    depth = np.bincount(a + block.starts[row], minlength=n) - np.bincount(b + block.starts[row], minlength=n)
    gone = np.cumsum(depth)[:-1] > 0
    for i, d in enumerate(block.ids):
        s = slice(block.starts[i], block.starts[i + 1])
        yield None if d == _LAST else int(d), block.buf[s], gone[s]


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(t: pa.Table, found: pa.Table) -> pa.Table:
    out = []
    for d, x, gone in _cut(t, found) if t.num_rows else ():
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(x[~gone].tobytes()).hexdigest()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")])


def _kept(t: pa.Table, found: pa.Table) -> pa.Table:
    out = [(d, x[~gone].tobytes()) for d, x, gone in _cut(t, found)] if t.num_rows else []
    return pa.table({"doc_id": pa.array([d for d, _ in out], pa.int64()), "kept": pa.array([x for _, x in out], pa.binary())})


def _without_repeats(docs: DataFrame, function, schema: str, block: int, part: int) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, math.ceil(total / block)), max(1, math.ceil(total / part))
    by_block = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    hashes = by_block.groupBy("block").applyInArrow(_hashes(parts), "parts int, block long, h binary")
    masks = written(hashes.groupBy("parts").applyInArrow(_shared, "block long, parts int, bits binary"), "masks")
    release(spark)
    sent = written(by_block.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(_contexts(parts), _CONTEXTS), "contexts")
    release(spark)
    far = sent.filter("parts >= 0").select("block", "parts", "sent").groupBy("parts").applyInArrow(_refined, _FOUND)
    found = written(far.unionByName(sent.filter("parts < 0").select("block", "row", "pos", "end")), "repeats")
    release(spark)
    return by_block.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(function, schema)


def remove_repeats(docs: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(doc_id, kept): the bytes of each document that stay. Kept bytes may cut a character in two, hence binary.

    A null text is an empty one; documents under 50 bytes and empty ones stay whole. Rows that share a doc_id don't
    count as smaller than each other. A null doc_id is larger than all others, and nothing goes because of it. Other
    columns aren't read. An empty table gives an empty one.
    """
    return _without_repeats(docs, _kept, "doc_id long, kept binary", block, part)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_repeats(table(spark, sf_dir, "documents"), _digest, _DIGEST, BLOCK, PART)
