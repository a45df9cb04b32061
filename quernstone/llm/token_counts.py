"""Token counts without token ids (operator 3).

Documents are cut into pre-tokens; a block of documents keeps its distinct pre-tokens once and each document's
frequencies as indexes into them. Pre-tokens are dealt into parts by hash, so that all blocks' copies of one meet and its
pieces are counted once; the counts go back to the blocks, where every document's total is the sum of count times
frequency. A frequent pre-token costs its part one entry per block, however many documents have it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import table, trimmed, written

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of text in a block (at least one document).
BLOCK = 8_000_000
#: Code points that one Unicode version has as letters or numbers and another doesn't: the library itself cuts such texts.
DISPUTED = "[՘֋֌࢏౜೜₏₝-₟꟎-꟱꭬꭭\U00010000-\U0010ffff]"

#: Bytes of text that make a part of the pre-tokens.
PART = 16_000_000

_BLOCKS = "block long, doc_ids array<long>, n_bytes array<long>, extra array<int>, sizes array<int>, entries binary, words array<struct<part:int,n:int,words:binary>>"
_KINDS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("extra", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("entries", pa.binary()), ("words", pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])))])


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as 32-bit numbers, byte by byte of all numbers, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(a, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unsqueezed(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return [np.ascontiguousarray(x.reshape(4, n).T).view(np.uint32).ravel() for x in raw.reshape(-1, 4 * n)] if n else [np.zeros(0, np.uint32)] * 2


def _packed_words(words: list[bytes]) -> bytes:
    import zstandard

    sizes = np.array([len(w) for w in words], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(words))


def _unpacked_words(data: bytes, n: int) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32)).astype(np.int64) + 4 * n
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def _load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would keep memory of its own
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cutter:
    """Cuts text into pre-tokens as the tokenizer does; special strings are counted, not cut."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        tok = _load(path)
        self.pre = tok.pre_tokenizer
        self.special = [t.content for t in tok.get_added_tokens_decoder().values() if t.special]
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.disputed = regex.compile(DISPUTED).search

    def __call__(self, text: str) -> tuple[Counter, int]:
        parts, extra = [text], 0
        for s in self.special:
            if s in text:
                parts = [y for x in parts for y in x.split(s)]
                extra = len(parts) - 1
        out: Counter = Counter()
        for p in parts:
            out.update([p[a:b] for _, (a, b) in self.pre.pre_tokenize_str(p)] if self.disputed(p) else self.find(p))
        return out, extra


def _packed(path: str, limit: int, parts: int):
    def block(serial: int, ids: list, sizes: list, extras: list, counts: list, ix: list, n: list, words: dict) -> pa.RecordBatch:
        import xxhash

        raw = [w.encode() for w in words]
        part = np.array([xxhash.xxh3_64_intdigest(w) % parts for w in raw], np.int64)
        by_part = np.argsort(part, kind="stable")
        place = np.empty(len(raw), np.int64)
        place[by_part] = np.arange(len(raw))
        at, n = place[np.array(ix, np.int64)], np.array(n, np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        o = np.lexsort((at, doc))
        at, first = at[o], np.cumsum([0, *counts[:-1]])[np.array(counts) > 0]
        step = np.diff(at, prepend=0)
        step[first] = at[first]
        names, edges = np.unique(part[by_part], return_index=True)
        packed = [{"part": int(p), "n": int(b - a), "words": _packed_words([raw[k] for k in by_part[a:b]])} for p, a, b in zip(names, edges, [*edges[1:], len(raw)])]
        row = {"block": serial, "doc_ids": ids, "n_bytes": sizes, "extra": extras, "sizes": counts, "entries": _squeezed(step, n[o]), "words": packed}
        return pa.RecordBatch.from_pylist([row], _KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, serial, held = Cutter(path), TaskContext.get().partitionId() << 33, 0
        ids, sizes, extras, counts, ix, n, words = [], [], [], [], [], [], {}
        for batch in batches:
            for d, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                s = text.as_py() or ""
                size = len(s.encode())
                if ids and held + size > limit:
                    yield block(serial, ids, sizes, extras, counts, ix, n, words)
                    serial, held = serial + 1, 0
                    ids, sizes, extras, counts, ix, n, words = [], [], [], [], [], [], {}
                found, extra = cut(s)
                ids.append(d)
                sizes.append(size)
                extras.append(extra)
                counts.append(len(found))
                ix.extend([words.setdefault(w, len(words)) for w in found])
                n.extend(found.values())
                held += size
        if ids:
            yield block(serial, ids, sizes, extras, counts, ix, n, words)

    return run


def _pieces(path: str):
    def run(t: pa.Table) -> pa.Table:
        """Pieces of one part's distinct pre-tokens, given back to each block in its order."""
        tok = _load(path)
        place: dict[bytes, int] = {}
        asked = [[place.setdefault(w, len(place)) for w in _unpacked_words(x.as_py(), n)] for x, n in zip(t["words"], t["n"].to_pylist())]
        words = [w.decode() for w in place]
        pieces = np.array([len(e) for i in range(0, len(words), 1000) for e in tok.encode_batch_fast(words[i : i + 1000], add_special_tokens=False)], np.uint32)
        return pa.table({"block": t["block"], "part": t["part"], "pieces": pa.array([pieces[a].tobytes() for a in asked], pa.binary())})

    return run


def _summed(blocks: pa.Table, counted: pa.Table) -> pa.Table:
    ids, sizes, totals = [], [], []
    parts = sorted(zip(counted["part"].to_pylist(), counted["pieces"]), key=lambda x: x[0])
    pieces = np.frombuffer(b"".join(x.as_py() for _, x in parts), np.uint32).astype(np.int64)
    for r in blocks.to_pylist():
        counts = np.array(r["sizes"], np.int64)
        step, n = (x.astype(np.int64) for x in _unsqueezed(r["entries"], int(counts.sum())))
        starts = np.cumsum(counts) - counts
        run = np.concatenate([[0], np.cumsum(step)])
        at = run[1:] - np.repeat(run[starts], counts)
        total = np.concatenate([[0], np.cumsum(pieces[at] * n)])
        ids += r["doc_ids"]
        sizes += r["n_bytes"]
        totals += (total[starts + counts] - total[starts] + np.array(r["extra"])).tolist()
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(totals, pa.int64())})


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    A null text is an empty one with 0 tokens; repeated rows and null doc_ids give a row each; a text longer than a
    block is a block of its own. Other columns aren't read. An empty table gives an empty one. ``path`` is a file of
    the tokenizers library with byte-level pre-tokens.
    """
    path = path or tokenizer_path(TOKENIZER)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part))
    blocks = written(own.mapInArrow(trimmed(_packed(path, block, parts)), _BLOCKS), "pretokens")
    words = blocks.select("block", F.explode("words").alias("w")).select("block", "w.*")
    counted = words.groupBy("part").applyInArrow(_pieces(path), "block long, part int, pieces binary")
    entries = blocks.drop("words").groupBy("block")
    summed = entries.cogroup(counted.groupBy("block")).applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
