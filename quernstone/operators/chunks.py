"""Documents to chunks: one Arrow pass, a document per row, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import ChunkConfig, CoherenceConfig
from quernstone.functions import batches as A
from quernstone.functions import text as T
from quernstone.operators import folds
from quernstone.operators.folds import Chunk, Element

CHUNKS = (
    "doc_id long, chunk_id int, content string, start_pos int, end_pos int, semantic_score double, token_count int, "
    "paragraph_indices array<int>, chunk_type string, has_table boolean, has_image boolean, element_count int, "
    "content_types array<string>, requires_score_refresh boolean, coherence_score double, completeness_score double, "
    "semantic_density double, processing_mode string, metadata map<string,string>"
)
MODES = ("greedy", "greedy_enhanced", "boundary")
_TYPES = {"table_content": ["table"], "image_content": ["image"], "mixed_content": ["text", "table", "image"]}
_KINDS = pa.schema(
    [("doc_id", pa.int64()), ("chunk_id", pa.int32()), ("content", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("semantic_score", pa.float64()), ("token_count", pa.int32())]
    + [("paragraph_indices", pa.list_(pa.int32())), ("chunk_type", pa.string()), ("has_table", pa.bool_()), ("has_image", pa.bool_()), ("element_count", pa.int32()), ("content_types", pa.list_(pa.string()))]
    + [("requires_score_refresh", pa.bool_()), ("coherence_score", pa.float64()), ("completeness_score", pa.float64()), ("semantic_density", pa.float64()), ("processing_mode", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))]
)


def completeness(text: str) -> float:
    end = text.rstrip()
    score = 1.0
    score -= 0.0 if end.endswith(folds.STOPS) else 0.3
    score -= 0.2 if len(text.split("。")[0]) < 10 else 0.0
    score -= 0.4 if end.endswith(("(续)", "(未完)", "（续）", "（未完）")) else 0.0
    score -= 0.2 if end.endswith(("...", "……")) else 0.0
    score -= 0.2 if end.endswith("详见") else 0.0
    return max(0.1, score)


def quality_sentences(text: str) -> list[str]:
    return [s for x in folds.ENDS["zh"].split(text) if len(s := x.strip()) > 5]


def inner_coherence(text: str, embed: Callable[[list[str]], np.ndarray]) -> float:
    """Mean cosine of neighbouring sentences."""
    parts = quality_sentences(text)
    if len(parts) < 2:
        return 1.0
    v = folds.unit(embed(parts))
    return float((v[:-1] * v[1:]).sum(axis=1).mean())


def density(text: str) -> float:
    words = text.split()
    if not words:
        return 0.0
    rich = len({w.lower() for w in words if w.isalpha()}) / len(words)
    sizes = np.array([len(s.split()) for s in quality_sentences(text)], float)
    varied = min(1.0, float(sizes.std() / (sizes.mean() + 1e-6))) if len(sizes) > 1 else 0.0
    return 0.7 * rich + 0.3 * varied


def embed_features(texts: list[str]) -> np.ndarray:
    return np.array([folds.features(t) for t in texts]).reshape(-1, len(folds._WEIGHTS))


def chunk_elements(elements: list[Element], cfg: ChunkConfig, mode: str, embed: Callable[[list[str]], np.ndarray], coherence: CoherenceConfig) -> list[Chunk]:
    images = np.cumsum([0, *(e.kind == "image" for e in elements)])
    texts = [folds.embedding_text(e, int(k)) for e, k in zip(elements, images)]
    v = folds.unit(embed(texts)) if texts else np.zeros((0, 1))
    if mode == "boundary":
        found = folds.by_boundaries([e.content for e in elements], v, cfg)
    else:
        measure = folds.mean_coherence if mode == "greedy" else lambda v, h, i: folds.weighted_coherence(v, h, i, coherence)
        found = [folds.build(elements, i, v) for i in folds.greedy(elements, v, cfg, measure)]
    return folds.optimise(found, cfg)


def _rows(doc_id: int | None, chunks: list[Chunk], cfg: ChunkConfig, embed, mode: str) -> Iterator[tuple]:
    for k, c in enumerate(chunks):
        own = inner_coherence(c.content, embed) if c.refresh else c.semantic_score
        yield (
            doc_id, k, c.content, c.start_pos, c.end_pos, c.semantic_score, folds.tokens(c.content, cfg.language), list(c.paragraph_indices), c.chunk_type, c.has_table, c.has_image,
            len(c.paragraph_indices), _TYPES.get(c.chunk_type, ["text"]), c.refresh, min(1.0, max(0.0, own)), completeness(c.content), density(c.content), mode, list(c.note.items()),
        )


def _batch(rows: list[tuple], of_id: pa.DataType) -> pa.RecordBatch:
    kinds = _KINDS.set(0, pa.field("doc_id", of_id))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.types)], schema=kinds)


def fixed_windows(text: str, size: int, score: float) -> list[Chunk]:
    return [Chunk(text[i : i + size], i, min(i + size, len(text)), score, (i // size,), "content") for i in range(0, len(text), size)]


def _mapped(cfg: ChunkConfig, mode: str, embed, coherence: CoherenceConfig, separator: str, safe: bool):
    def parse(row: dict) -> list[Element]:
        if row.get("elements") is not None:
            return [Element(e["content"], e["kind"], bool(e["heading"])) for e in row["elements"]]
        out = []
        for p in folds.paragraphs(row.get("text") or "", cfg, separator):
            rows = folds.parse_table(p)
            flat = " ".join(p.split())
            if rows:
                out.append(Element("\n".join(folds.markdown_rows(rows)), "table"))
            elif len(flat) >= 5:
                out.append(Element(flat))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches):
            out: list[tuple] = []
            for row in batch.to_pylist():
                how = mode
                try:
                    chunks = chunk_elements(parse(row), cfg, mode, embed, coherence)
                except Exception:
                    if not safe:
                        raise
                    how, chunks = "fallback_text", fixed_windows(row.get("text") or "", cfg.target_chunk_size, 0.4)
                out += _rows(row["doc_id"], chunks, cfg, embed, how)
            yield _batch(out, batch["doc_id"].type)

    return run


def chunk_documents(
    docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), mode: str = "greedy", separator: str = r"\n\s*\n",
    embed: Callable[[list[str]], np.ndarray] = embed_features, coherence: CoherenceConfig = CoherenceConfig(), safe: bool = False,
) -> DataFrame:
    """Chunks of ``docs`` (doc_id and text, or doc_id and elements array<struct<content, kind, heading>>).

    ``embed`` maps texts to vectors within a Python worker. ``safe`` gives a document whose steps fail fixed windows
    and names that in processing_mode. Documents without text give no chunks. doc_id may be of any type.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    own = docs.select("doc_id", *[c for c in ("text", "elements") if c in docs.columns])
    kinds = CHUNKS.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    A.small_batches(docs.sparkSession)
    return own.mapInArrow(_mapped(cfg, mode, embed, coherence, separator, safe), kinds)


def length_chunks(docs: DataFrame, cfg: ChunkConfig, separator: str = "\n") -> DataFrame:
    """Chunks by size alone, inside the JVM: (doc_id, chunk_id, content, n_parts).

    Paragraphs over four characters are packed in order while the sum of their lengths stays within the maximum.
    """
    parts = F.filter(F.transform(F.split("text", separator, -1), T.collapse), lambda x: F.length(x) >= 5)
    start = F.struct(F.array().cast("array<struct<content:string,n_parts:int>>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & (s["size"] + F.length(x) > cfg.max_chunk_size)
        done = F.when(full, F.concat(s["done"], F.array(F.struct(s["held"].alias("content"), s["n"].alias("n_parts"))))).otherwise(s["done"])
        alone = full | (s["n"] == 0)
        return F.struct(
            done.alias("done"), F.when(alone, x).otherwise(F.concat(s["held"], F.lit("\n\n"), x)).alias("held"),
            F.when(alone, F.lit(1)).otherwise(s["n"] + 1).alias("n"), F.when(alone, F.length(x)).otherwise(s["size"] + F.length(x)).alias("size"),
        )

    last = lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(F.struct(s["held"].alias("content"), s["n"].alias("n_parts"))))).otherwise(s["done"])
    packed = docs.select("doc_id", F.posexplode(F.aggregate(parts, start, step, last)).alias("chunk_id", "c"))
    return packed.select("doc_id", "chunk_id", "c.content", "c.n_parts")


def window_chunks(docs: DataFrame, size: int) -> DataFrame:
    """Fixed windows of ``size`` characters, for documents that nothing else can be done with."""
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    at = docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_id", "start_pos"))
    return at.select("doc_id", "chunk_id", "start_pos", F.least(F.col("start_pos") + size, F.length("text")).alias("end_pos"), F.substring("text", F.col("start_pos") + 1, F.lit(size)).alias("content"))


def positions(chunks: DataFrame, language: str) -> DataFrame:
    """Running positions, cleaned content and token counts of (doc_id, chunk_id, content)."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    size = F.length("content").cast("long")
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    clean = T.clean_chunk(F.col("content"))
    return chunks.select("doc_id", "chunk_id", (end - size).alias("start_pos"), end.alias("end_pos"), clean.alias("content"), T.token_estimate(clean, language).alias("token_count"))


def attach_metadata(chunks: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Chunks with attributes of their documents in ``metadata``, as text; an equi-join whose small side Spark sends out if it can."""
    pairs = [y for c in columns for y in (F.lit(c), F.col(c).cast("string"))]
    more = docs.select(F.col("doc_id").alias("_q_id"), F.create_map(*pairs).alias("_q_more"))
    joined = chunks.join(more, F.col("doc_id") == F.col("_q_id"), "left")
    every = F.map_from_entries(F.concat(F.map_entries(F.map_filter("metadata", lambda k, v: ~k.isin(*columns))), F.map_entries("_q_more")))
    return joined.withColumn("metadata", F.coalesce(every, F.col("metadata"))).drop("_q_id", "_q_more")


def assign_chunks(df: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """(doc_id, pos, chunk_id) of ordered elements (doc_id, pos, size, embedding) packed by size and mean cosine, without overlap."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        v = folds.unit(np.array(t["embedding"].to_pylist(), float))
        own = [Element("x" * n) for n in t["size"].to_pylist()]
        of = {i: k for k, index in enumerate(folds.greedy(own, v, cfg.with_(overlap_ratio=0.0))) for i in index}
        return pa.table({"doc_id": t["doc_id"], "pos": t["pos"].cast(pa.int64()), "chunk_id": pa.array([of[i] for i in range(len(own))], pa.int32())})

    return df.select("doc_id", "pos", "size", "embedding").groupBy("doc_id").applyInArrow(run, "doc_id long, pos long, chunk_id int")


def chunk_ranges(df: DataFrame, cfg: ChunkConfig, mode: str = "greedy", coherence: CoherenceConfig = CoherenceConfig()) -> DataFrame:
    """(doc_id, chunk_id, first, last, score) of ordered elements (doc_id, pos, content, heading, embedding), by place from 0.

    The decisions of ``chunk_documents`` for vectors that are there already; score is the mean cosine of all pairs. A
    document's elements meet in one task. An empty table gives an empty one.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    of_id = df.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        texts = [x or "" for x in t["content"].to_pylist()]
        v = folds.unit(np.array(t["embedding"].to_pylist(), float))
        own = [Element(c, heading=bool(h)) for c, h in zip(texts, t["heading"].to_pylist())]
        if mode == "boundary":
            found = [(c.paragraph_indices, c.semantic_score) for c in folds.by_boundaries(texts, v, cfg)]
        else:
            measure = folds.mean_coherence if mode == "greedy" else lambda v, h, i: folds.weighted_coherence(v, h, i, coherence)
            found = [(i, folds.pair_mean(v, i)) for i in folds.greedy(own, v, cfg, measure)]
        ids = pa.array([t["doc_id"][0].as_py()] * len(found), t["doc_id"].type)
        ends = [pa.array([i[k] for i, _ in found], pa.int32()) for k in (0, -1)]
        return pa.table([ids, pa.array(range(len(found)), pa.int32()), *ends, pa.array([s for _, s in found], pa.float64())], names=["doc_id", "chunk_id", "first", "last", "score"])

    return df.select("doc_id", "pos", "content", "heading", "embedding").groupBy("doc_id").applyInArrow(run, f"doc_id {of_id}, chunk_id int, first int, last int, score double")


#: Steps that change the chunks of a document, by name.
STEPS: dict[str, Callable[[list[Chunk], ChunkConfig], list[Chunk]]] = {
    "merge": folds.merge_small,
    "split": folds.split_large,
    "force_split": lambda chunks, cfg: [x for c in chunks for x in folds.force_split(c, cfg)],
    "shift": folds.shift_boundaries,
    "renumber": folds.renumbered,
}


def optimised(chunks: DataFrame, cfg: ChunkConfig, *steps: str) -> DataFrame:
    """(doc_id, chunk_id, content, start_pos, end_pos, sources, refresh) after the named ``steps`` over (doc_id, chunk_id, content).

    sources: the chunk_ids that a chunk was made of, where a step keeps them; refresh: whether scores are out of date.
    Null contents count as empty; of repeated chunk_ids any order is taken. A document's chunks meet in one task.
    """
    if odd := set(steps) - set(STEPS):
        raise ValueError(f"unknown steps: {sorted(odd)}")
    of_id = chunks.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk_id")
        own, at = [], 0
        for k, c in zip(t["chunk_id"].to_pylist(), t["content"].to_pylist()):
            own.append(Chunk(c or "", at, at + len(c or ""), paragraph_indices=(k,)))
            at += len(c or "")
        for s in steps:
            own = STEPS[s](own, cfg)
        ids = pa.array([t["doc_id"][0].as_py()] * len(own), t["doc_id"].type)
        columns = [
            pa.array(range(len(own)), pa.int32()), pa.array([c.content for c in own], pa.string()), pa.array([c.start_pos for c in own], pa.int32()), pa.array([c.end_pos for c in own], pa.int32()),
            pa.array([list(c.paragraph_indices) for c in own], pa.list_(pa.int32())), pa.array([c.refresh for c in own], pa.bool_()),
        ]
        return pa.table([ids, *columns], names=["doc_id", "chunk_id", "content", "start_pos", "end_pos", "sources", "refresh"])

    return chunks.select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "content").groupBy("doc_id").applyInArrow(run, f"doc_id {of_id}, chunk_id int, content string, start_pos int, end_pos int, sources array<int>, refresh boolean")


def fallback_chunks(docs: DataFrame, cfg: ChunkConfig, separator: str = r"\n\s*\n") -> DataFrame:
    """(doc_id, chunk_id, content, n_parts) by size alone for (doc_id, text), as where the other steps fail."""
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches):
            out = []
            for d, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                parts = [x for p in re.split(separator, text.as_py() or "") if (x := " ".join(p.split()))]
                out += [(d, k, c.content, len(c.paragraph_indices)) for k, c in enumerate(folds.fallback_packing(parts, cfg))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32()))], names=["doc_id", "chunk_id", "content", "n_parts"])

    A.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_id int, content string, n_parts int")


def repacked_paragraphs(docs: DataFrame, cfg: ChunkConfig, separator: str = r"\n\s*\n") -> DataFrame:
    """(doc_id, pos, content): blocks, those over the largest size packed anew from their sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches):
            out = [(d, k, p) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]) for k, p in enumerate(folds.paragraphs(t.as_py() or "", cfg, separator))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "pos", "content"])

    A.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, content string")
