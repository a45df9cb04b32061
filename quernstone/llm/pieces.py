"""SentencePiece encoding with N-best segmentation, and decoding (operator 4).

Pieces and scores come from a model file of the sentencepiece library, which also normalises the text. A segmentation's
score is the sum of its pieces' scores; a character that no piece covers costs UNKNOWN less than the least score and is
written as byte pieces. Forward Viterbi gives each position's best score; a backward A-star search over the lattice uses
these as exact heuristics, so that segmentations leave it in order of score.

Where no piece has two neighbouring characters side by side, no segmentation spans them: there a text's lattice falls
into lattices of words. Words are searched once and kept, with the pieces of their N best. A text is searched the same
way: forward sums of its words' best scores are the heuristics of a backward A-star search over its words. Only words
with the N - 1 smallest gaps can differ from their best one among a text's N best; the search steps over all others.
"""

from __future__ import annotations

import hashlib
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import small_batches, table, text_or_empty, trimmed
from quernstone.llm.token_counts import tokenizer_path

MODEL, N = "piece_bpe_32k.model", 3
SPACE, UNKNOWN = "▁", 10.0
#: Words kept at most by a Python worker.
KEPT = 500_000


class _Words(dict):
    """Words to places in arrays that hold what their search found."""

    def __init__(self, model: Lattice, n: int):
        super().__init__()
        self.model, self.n, self.pooled = model, n, 0
        self.best, self.gap, self.pool = (np.zeros(1024, k) for k in (float, float, np.int32))
        self.start, self.size = np.zeros(1024, np.int64), np.zeros((1024, n), np.int32)
        self.scores: list[tuple[float, ...]] = []
        self.new: list[list[tuple[float, tuple[int, ...]]]] = []

    def __missing__(self, word: str) -> int:
        found = self.model.search(word, self.n)
        at = self[word] = len(self)
        self.new.append(found)
        self.scores.append(tuple([s for s, _ in found]))
        return at

    def settle(self) -> None:
        """Puts what the last searches found into the arrays."""
        new, self.new = self.new, []
        a, b = len(self) - len(new), len(self)
        while b > len(self.best):
            for name in ("best", "gap", "start", "size"):
                setattr(self, name, np.concatenate([x := getattr(self, name), np.zeros_like(x)]))
        ids = [x for found in new for _, ids in found for x in ids]
        if self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.int32)])
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        self.best[a:b] = [f[0][0] for f in new]
        self.gap[a:b] = [f[0][0] - f[1][0] if len(f) > 1 else np.inf for f in new]
        for k in range(self.n):
            self.size[a:b, k] = [len(f[k][1]) if k < len(f) else 0 for f in new]
        total = self.size[a:b].sum(axis=1, dtype=np.int64)
        self.start[a:b] = self.pooled + np.cumsum(total) - total
        self.pooled += len(ids)

    def ids(self, at: int, k: int) -> np.ndarray:
        """The pieces of a word's segmentation after k better ones."""
        a = self.start[at] + self.size[at, :k].sum()
        return self.pool[a : a + self.size[at, k]]


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    ends = np.cumsum(size)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


class Lattice:
    """The pieces of a model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, size = self.library, self.library.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.bytes_of = {}
        self.raw: list[bytes] = []
        self.piece: dict[str, tuple[int, float]] = {}
        for i, name in enumerate(self.names):
            if sp.is_byte(i):
                self.bytes_of[int(name[3:5], 16)] = i
                self.raw.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.piece[name] = (i, sp.get_score(i))
                self.raw.append(name.replace(SPACE, " ").encode())
        self.unk = sp.unk_id()
        self.lost = min((s for _, s in self.piece.values()), default=0.0) - UNKNOWN
        sizes = np.array([len(x) for x in self.raw], np.int64)
        self.raw_size, self.raw_start = sizes, np.cumsum(sizes) - sizes
        self.raw_pool = np.frombuffer(b"".join(self.raw), np.uint8)
        inside = sorted({c for p in self.piece if len(p) > 1 for c in p})
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.joined = np.zeros((len(inside) + 1,) * 2, bool)  # whether a piece has the two characters side by side
        for p in self.piece:
            at = self.char[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        self.trie: dict = {}  # characters to [(score, ids) of the piece that ends here, the same for what follows]
        for name, found in self.piece.items():
            node: list = [None, self.trie]
            for c in name:
                node = node[1].setdefault(c, [None, {}])
            node[0] = found[1], (found[0],)
        self.kept: dict[int, _Words] = {}

    def forward(self, text: str) -> tuple[list[list[tuple[float, int, float, tuple[int, ...]]]], list[float]]:
        """For each end position, (best score through it, start, score, ids) of the pieces that end there, and the best
        score of the text up to it."""
        size = len(text)
        into: list[list[tuple[float, int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        best = [0.0] + [-math.inf] * size
        trie = self.trie
        for a in range(size):
            here, nodes, b, one = best[a], trie, a, False
            while b < size and (node := nodes.get(text[b])) is not None:
                b += 1
                p, nodes = node
                if p is not None:
                    s, ids = p
                    f = here + s
                    into[b].append((f, a, s, ids))
                    if f > best[b]:
                        best[b] = f
                    if b == a + 1:
                        one = True
            if not one:
                ids = tuple(self.bytes_of.get(x, self.unk) for x in text[a].encode()) if self.bytes_of else (self.unk,)
                f = here + self.lost
                into[a + 1].append((f, a, self.lost, ids))
                if f > best[a + 1]:
                    best[a + 1] = f
        return into, best

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position, (start, score, ids) of the pieces that end there."""
        return [[(a, s, ids) for _, a, s, ids in x] for x in self.forward(text)[0]]

    def search(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of ``text``; among equal scores in an order that depends on the text alone.

        Heuristics are exact and no two entries of the queue share a segmentation, so those past the first that are still
        asked for can't come to their turn and go.
        """
        into, best = self.forward(text)
        out, serial, room = [], 0, n
        queue: list = [(-best[-1], len(text), 0, 0.0, None)]
        while queue and room:
            _, at, _, behind, path = queue.pop(0)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((behind, tuple(ids)))
                room -= 1
                continue
            for through, a, s, ids in into[at]:
                f = -(behind + through)
                if len(queue) < room or f <= queue[-1][0]:
                    serial += 1
                    insort(queue, (f, a, serial, behind + s, (ids, path)))
                    del queue[room:]
        return out

    def words(self, text: str) -> list[str]:
        """The text cut wherever no piece has the two characters side by side, so that no segmentation spans a cut."""
        if not text:
            return []
        c = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = [0, *(np.flatnonzero(~self.joined[c[:-1], c[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def found(self, words: list[str], n: int) -> tuple[_Words, np.ndarray]:
        """What the words' searches found, and each word's place there."""
        kept = self.kept.get(n)
        if kept is None or len(kept) > KEPT:
            kept = self.kept[n] = _Words(self, n)
        at = np.fromiter(map(kept.__getitem__, words), np.int64, len(words))
        if kept.new:
            kept.settle()
        return kept, at

    def ways(self, kept: _Words, at: np.ndarray, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
        """The n best (score, words that take another than their best segmentation and which) of a text, best first."""
        before = np.concatenate([[0.0], np.cumsum(kept.best[at])])
        gap, places = kept.gap[at], []
        while len(places) < min(n - 1, len(at)) and gap[i := int(gap.argmin())] < np.inf:
            places.append(i)
            gap[i] = np.inf
        places.sort()
        start, after = before[places].tolist(), before[[i + 1 for i in places]].tolist()
        end = float(before[-1])
        out, serial, room = [], 0, n
        queue: list = [(-end, 0, len(places), 0.0, end, None)]
        while queue and room:
            f, _, j, behind, reached, path = queue.pop(0)
            if j == 0:
                taken = []
                while path is not None:
                    taken.append(path[0])
                    path = path[1]
                out.append((-f, taken))
                room -= 1
                continue
            j -= 1
            behind += reached - after[j]  # the words between, by their best
            for k, s in enumerate(kept.scores[at[places[j]]]):
                f = -(behind + s + start[j])
                if len(queue) < room or f <= queue[-1][0]:
                    serial += 1
                    insort(queue, (f, serial, j, behind + s, start[j], ((places[j], k), path) if k else path))
                    del queue[room:]
        return out

    def nbest(self, text: str, n: int = N) -> list[tuple[float, np.ndarray]]:
        """Up to n best (score, ids) of a text, best first; an empty text has one without pieces."""
        kept, at = self.found(self.words(self.library.normalize(text)), n)
        size = kept.size[at, 0].astype(np.int64)
        ids, ends = _gathered(kept.pool, kept.start[at], size), np.cumsum(size)
        out = []
        for score, taken in self.ways(kept, at, n):
            parts, done = [], 0
            for i, k in taken:
                parts += [ids[done : ends[i] - size[i]], kept.ids(at[i], k)]
                done = ends[i]
            out.append((score, np.concatenate([*parts, ids[done:]]) if taken else ids))
        return out

    def encode(self, text: str, n: int = N) -> list[tuple[float, list[int]]]:
        """``nbest`` with lists of ids."""
        return [(s, ids.tolist()) for s, ids in self.nbest(text, n)]

    def best(self, text: str, n: int = N) -> tuple[np.ndarray, list[float]]:
        """The best segmentation's ids and the n best scores."""
        found = self.nbest(text, n)
        return found[0][1], [s for s, _ in found]

    def decode(self, ids) -> str:
        """The text of the ids; the space that normalising puts in front goes."""
        ids = np.asarray(ids, np.int64)
        text = _gathered(self.raw_pool, self.raw_start[ids], self.raw_size[ids]).tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_loaded: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _loaded:
        _loaded[path] = Lattice(path)
    return _loaded[path]


def _lists(lists: list, values: pa.Array) -> pa.ListArray:
    """``values`` cut into lists of the lengths of ``lists``."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), values)


def _ids(arrays: list) -> pa.ListArray:
    return _lists(arrays, pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]), pa.int32()))


def _encoded(path: str, n: int, names: list[str], library: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t.as_py() or "" for t in part["text"]]
                found = [model.nbest(t, n) for t in texts]
                arrays = {
                    "pieces": _ids([f[0][1] for f in found]),
                    "scores": _lists(found, pa.array([s for f in found for s, _ in f], pa.float64())),
                    "nbest": _lists(found, _ids([ids for f in found for _, ids in f])),
                    "decoded": pa.array([model.decode(f[0][1]) for f in found], pa.string()),
                }
                if library:
                    arrays["library_ids"] = pa.array([model.library.encode(t) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part[x] for x in names), *arrays.values()], names=[*names, *arrays])

    return run


_ADDED = ["pieces array<int>", "scores array<double>", "nbest array<array<int>>", "decoded string", "library_ids array<int>"]


def encode(docs: DataFrame, keep: list[str], path: str | None = None, n: int = N) -> DataFrame:
    """Columns ``keep`` of ``docs`` and five of each text: pieces array<int>, the best segmentation; scores array<double>
    of the n best, and nbest array<array<int>>, these segmentations, the first of which is ``pieces``; decoded string, the
    text of ``pieces``; library_ids array<int>, what the library itself gives.

    A segmentation's score is the sum of its pieces' scores in the model file. Where those are merge ranks, as in a BPE
    model, it is no probability: the best sum isn't the segmentation that merging in order of rank gives, which
    ``library_ids`` holds. A null text is an empty one: no pieces, one score of 0 and an empty decoded text. Rows,
    repeated ones too, stay as they are; a text with fewer than n segmentations has fewer. The sign U+2581, which
    stands for a space in pieces, decodes to one. ``keep`` can't have columns named as the five. An empty table gives an
    empty one.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(MODEL)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    own = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    return own.mapInArrow(trimmed(_encoded(path, n, keep)), ", ".join([*kinds, *_ADDED]))


def _decoded(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            text = pa.array([None if x is None else model.decode(x) for x in batch["pieces"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), text], names=[*names, "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with a column text, that of ``pieces`` (array of ids); null for null, no other column named text."""
    small_batches(encoded.sparkSession)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema]
    return encoded.mapInArrow(trimmed(_decoded(path or tokenizer_path(MODEL), encoded.columns)), ", ".join([*kinds, "text string"]))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("scores", pa.list_(pa.float64())), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), ("nbest_sha256", pa.list_(pa.string())), ("nbest_round_trip", pa.bool_())])
_DIGEST_KINDS = "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, scores array<double>, decoded_sha256 string, round_trip boolean, nbest_sha256 array<string>, nbest_round_trip boolean"


def _digest(path: str, n: int):
    """The operator's rows, ids and texts as hashes of 32-bit numbers and of UTF-8."""
    encoded = _encoded(path, n, ["doc_id", "text"], library=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in encoded(batches):
            out = []
            for d, t, scores, nbest, decoded in zip(*(batch[x] for x in ("doc_id", "text", "scores", "nbest", "decoded"))):
                text, back = t.as_py(), decoded.as_py()
                ids = [np.asarray(x.values) for x in nbest]
                hashes = [sha(x.tobytes()) for x in ids]
                others = all(model.decode(x) == text for x in ids[1:])
                out.append((d.as_py(), len(text.encode()), len(ids[0]), hashes[0], scores.as_py(), sha(back.encode()), back == text, hashes, back == text and others))
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out), _DIGEST)], schema=_DIGEST)

    return run


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return docs.mapInArrow(trimmed(_digest(tokenizer_path(MODEL), N)), _DIGEST_KINDS)
