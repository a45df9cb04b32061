"""Sequential steps over one document's elements or chunks.

These carry state from element to element and run inside one Arrow pass with a document per row, so they never shuffle.
Everything that doesn't carry state is a column expression elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from quernstone.config import ChunkConfig, CoherenceConfig
from quernstone.functions.text import IMAGE_MARK, TABLE_MARK
from quernstone.functions.vectors import COMMON, POINTS, REPEATS

ENDS = {"zh": re.compile("[。！？；]"), "en": re.compile("[.!?;]")}
STOPS = tuple("。.！!？?；;")
_ENDED = re.compile(r"[。！？；.!?;][\"”’'\)\]\s]*$")
_LEAD = re.compile(r"[^。！？；.!?;]*[。！？；.!?;][\"”’'\)\]} \t\r\n]*", re.DOTALL)
_CHAPTER = re.compile(r"第[一二三四五六七八九十\d]+[章节部分]|\d+[\.\s]+[^\n]{1,50}$|[一二三四五六七八九十]+[\.\s、]+[^\n]{1,50}$")
_LIST = re.compile(r"\d+[\.\)]|[•·▪▫]|[-*+]")
_WEIGHTS = np.sqrt(np.array(REPEATS, float))


@dataclass(frozen=True)
class Element:
    content: str
    kind: str = "paragraph"
    heading: bool = False

    @property
    def part(self) -> str:
        return f"{TABLE_MARK}\n{self.content}" if self.kind == "table" else self.content


@dataclass(frozen=True)
class Chunk:
    content: str
    start_pos: int = 0
    end_pos: int = 0
    semantic_score: float = 1.0
    paragraph_indices: tuple[int, ...] = ()
    chunk_type: str = "content"
    has_table: bool = False
    has_image: bool = False
    refresh: bool = False
    note: dict = field(default_factory=dict)


def tokens(text: str, language: str) -> int:
    return int(len(text) / 1.3) if language == "zh" else int(len(text.split()) / 0.75)


def sentences(text: str, language: str) -> list[str]:
    return [s for x in ENDS["zh" if language == "zh" else "en"].split(text) if (s := x.strip())]


def features(text: str) -> np.ndarray:
    """The fallback vector of a text, weighted so that plain dot products equal those of its tiled form."""
    n = max(1, len(text))
    raw = [len(text) / 1000, *(text.count(c) / n for c in COMMON), sum(text.count(c) for c in POINTS) / n, sum(c.isdigit() for c in text) / n]
    return np.array(raw) * _WEIGHTS


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, float)
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def paragraphs(text: str, cfg: ChunkConfig, separator: str = r"\n\s*\n", joiner: str = "。") -> list[str]:
    """Blocks between separators; one over the largest size is packed anew from its sentences."""
    out = []
    for block in (b.strip() for b in re.split(separator, text.strip())):
        if len(block) <= cfg.max_chunk_size:
            out += [block] if block else []
            continue
        held = ""
        for s in (x.strip() for x in re.split(r"[。！？.!?]\s*", block)):
            if not s:
                continue
            if held and len(held) + len(s) >= 0.9 * cfg.max_chunk_size:
                out.append(held)
                held = ""
            held += s + joiner
        out += [held] if held else []
    return out


def mean_coherence(v: np.ndarray, held: list[int], new: int) -> float:
    return float((v[held] @ v[new]).mean()) if held else 0.0


def recent_coherence(v: np.ndarray, held: list[int], new: int, last: int = 3) -> float:
    return mean_coherence(v, held[-last:], new)


def trend(sims: np.ndarray, c: CoherenceConfig) -> float:
    """What a restless run of similarities costs."""
    if len(sims) < 3:
        return 0.0
    jump = abs(sims[-1] - sims[:-1].mean())
    return -c.trend_penalty_factor * float(np.abs(np.diff(sims, 2)).mean() + min(0.15, 0.2 * jump))


def consistency(sims: np.ndarray) -> float:
    """How even similarities are, less where the last is an outlier."""
    if len(sims) < 2:
        return 1.0
    mean = sims.mean()
    even = max(0.0, 1.0 - sims.std() / mean) if mean > 0 else 0.0
    if len(sims) > 3:
        low, high = np.percentile(sims, [25, 75])
        even *= 0.8 if sims[-1] > high + 1.5 * (high - low) else 1.0
    return float(even)


def weighted_coherence(v: np.ndarray, held: list[int], new: int, c: CoherenceConfig = CoherenceConfig()) -> float:
    if not held or new >= len(v):
        return 0.0
    sims = v[held] @ v[new]
    decay = c.position_decay_factor if c.position_weight_enabled else 0.0
    weights = np.exp(-decay * np.arange(len(sims) - 1, -1, -1))
    score = float(np.average(sims, weights=weights))
    if c.trend_analysis_enabled and len(sims) >= c.similarity_window_size:
        score += trend(sims, c)
    if abs(new - held[-1]) == 1:
        score += min(0.1, 0.1 * float(sims[-1]))
    return min(1.0, max(0.0, score + 0.1 * consistency(sims)))


def greedy(elements: list[Element], v: np.ndarray, cfg: ChunkConfig, coherence: Callable[..., float] = mean_coherence) -> list[list[int]]:
    """Indexes of each chunk: elements in order, a new chunk where structure, size or meaning asks for it."""
    chunks: list[list[int]] = []
    held: list[int] = []
    size = 0
    for i, e in enumerate(elements):
        n = len(e.content)
        if held:
            opens = cfg.preserve_structure and e.heading and e.kind == "paragraph" and size >= cfg.min_chunk_size
            if opens or size + n > cfg.max_chunk_size or (size >= cfg.target_chunk_size and coherence(v, held, i) < cfg.semantic_threshold):
                chunks.append(held)
                held = held[len(held) - overlap(len(held), cfg.overlap_ratio) :]
                size = sum(len(elements[k].content) for k in held)
        held = [*held, i]
        size += n
    return [*chunks, held] if held else chunks


def overlap(n: int, ratio: float) -> int:
    return min(max(1, int(n * ratio)), n - 1) if ratio > 0 and n else 0


def pair_mean(v: np.ndarray, index: list[int]) -> float:
    """Mean cosine of all pairs of unit vectors, from the length of their sum."""
    n = len(index)
    if n < 2:
        return 1.0
    own = v[index]
    return float((np.square(own.sum(axis=0)).sum() - np.square(own).sum()) / (n * (n - 1)))


def build(elements: list[Element], index: list[int], v: np.ndarray) -> Chunk:
    own = [elements[i] for i in index]
    kinds = {e.kind for e in own}
    table, image = "table" in kinds, "image" in kinds
    kind = "mixed_content" if table and image else "table_content" if table else "image_content" if image else "text_content" if "paragraph" in kinds else "unknown"
    return Chunk("\n\n".join(e.part for e in own), index[0], index[-1] + 1, pair_mean(v, index), tuple(index), kind, table, image)


def is_chapter_title(text: str) -> bool:
    return bool(_CHAPTER.match(text)) or (len(text) < 50 and not text.endswith(("。", ".", "！", "!", "？", "?")))


def structural_boundaries(texts: list[str]) -> list[int]:
    out = []
    for i, t in enumerate(map(str.strip, texts)):
        shift = False
        if i:
            ratio = len(t) / max(1, len(texts[i - 1]))
            shift = ratio > 3 or ratio < 0.3 or (texts[i - 1].count("。") > 2 and "。" not in t)
        if is_chapter_title(t) or _LIST.match(t) or shift:
            out.append(i)
    return out


def spaced(boundaries: list[int], distance: int = 2) -> list[int]:
    """Boundaries from left to right that are at least ``distance`` after the last one kept."""
    out: list[int] = []
    for b in boundaries:
        if not out or b - out[-1] >= distance:
            out.append(b)
    return out


def boundaries(texts: list[str], v: np.ndarray) -> list[int]:
    """Start of each topic, and the end: sharp changes of similarity after a finished sentence, and structure."""
    n = len(v)
    if n < 3:
        return [0, n]
    near = (v[:-1] * v[1:]).sum(axis=1)
    change = np.abs(np.diff(near))
    sharp = np.flatnonzero(change > change.mean() + change.std()) + 1
    kept = [int(b) for b in sharp if not texts[b - 1] or texts[b - 1].rstrip().endswith(STOPS)]
    out = spaced(sorted({0, *kept, *structural_boundaries(texts)}))
    return out if out[-1] == n else [*out, n]


def pack_to_target(texts: list[str], index: list[int], cfg: ChunkConfig) -> list[list[int]]:
    """A long stretch in runs of about the target size that share some elements."""
    out: list[list[int]] = []
    held: list[int] = []
    size = 0
    for i in index:
        if held and size + len(texts[i]) > cfg.target_chunk_size:
            out.append(held)
            held = held[len(held) - overlap(len(held), cfg.overlap_ratio) :] if len(held) > 1 else []
            size = sum(len(texts[k]) for k in held)
        held = [*held, i]
        size += len(texts[i])
    return [*out, held] if held else out


def by_boundaries(texts: list[str], v: np.ndarray, cfg: ChunkConfig) -> list[Chunk]:
    plain = lambda index, score: Chunk("\n\n".join(texts[i] for i in index), 0, sum(len(texts[i]) for i in index) + 2 * max(0, len(index) - 1), score, tuple(index))
    every = list(range(len(texts)))
    total = sum(map(len, texts))
    if total < cfg.min_chunk_size or (len(texts) == 1 and total <= cfg.max_chunk_size):
        return [replace(plain(every, 1.0), note={"edge_case": "document_too_short" if total < cfg.min_chunk_size else "single_paragraph"})]
    cuts = boundaries(texts, v)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        index = every[a:b]
        groups = pack_to_target(texts, index, cfg) if sum(len(texts[i]) for i in index) > cfg.max_chunk_size else [index]
        out += [plain(g, pair_mean(v, g)) for g in groups if g]
    return out


def fallback_packing(texts: list[str], cfg: ChunkConfig) -> list[Chunk]:
    """Texts packed by size alone, for documents whose other steps failed."""
    out: list[Chunk] = []
    held, index = "", []
    for i, t in enumerate(texts):
        if held and len(held) + len(t) > cfg.max_chunk_size:
            out.append(Chunk(held.strip(), semantic_score=0.5, paragraph_indices=tuple(index), chunk_type="fallback"))
            held, index = "", []
        held += t + "\n\n"
        index.append(i)
    return [*out, Chunk(held.strip(), semantic_score=0.5, paragraph_indices=tuple(index), chunk_type="fallback")] if held.strip() else out


def merged(a: Chunk, b: Chunk) -> Chunk:
    return Chunk(
        f"{a.content}\n\n{b.content}", a.start_pos, b.end_pos, (a.semantic_score + b.semantic_score) / 2,
        tuple(sorted({*a.paragraph_indices, *b.paragraph_indices})), "content", a.has_table or b.has_table, a.has_image or b.has_image, True, {"merged": "true"},
    )


def merge_small(chunks: list[Chunk], cfg: ChunkConfig) -> list[Chunk]:
    """Small chunks gather while they fit; a larger one takes in what has gathered, if both fit."""
    if len(chunks) < 2:
        return chunks
    out: list[Chunk] = []
    waiting: Chunk | None = None
    for c in chunks:
        fits = waiting is not None and len(waiting.content) + len(c.content) <= cfg.max_chunk_size
        small = len(c.content) < cfg.min_chunk_size
        if waiting is None:
            waiting, c = (c, None) if small else (None, c)
        elif fits and (small or len(waiting.content) < cfg.target_chunk_size):
            joint = merged(waiting, c)
            waiting, c = (joint, None) if small else (None, joint)
        else:
            out.append(waiting)
            waiting, c = (c, None) if small else (None, c)
        out += [c] if c is not None else []
    return [*out, waiting] if waiting is not None else out


def force_split(c: Chunk, cfg: ChunkConfig) -> list[Chunk]:
    """Windows of the target size that end at white space within 50 characters where there is some."""
    out, text, start = [], c.content, 0
    shared = int(cfg.target_chunk_size * cfg.overlap_ratio)
    while start < len(text):
        end = min(start + cfg.target_chunk_size, len(text))
        if end < len(text):
            after = (k for k in range(end, min(end + 50, len(text))) if text[k] in " \n\t")
            before = (k for k in range(end, max(end - 50, start), -1) if text[k] in " \n\t")
            end = next(after, next(before, end))
        if piece := text[start:end].strip():
            out.append(replace(c, content=piece, start_pos=start, end_pos=end, paragraph_indices=(), refresh=True))
        if end >= len(text):
            break
        start = max(start + 1, end - shared)
    return out


def split_one(c: Chunk, cfg: ChunkConfig) -> list[Chunk]:
    parts = sentences(c.content, cfg.language)
    if len(parts) < 2:
        return force_split(c, cfg)
    groups: list[list[str]] = []
    held: list[str] = []
    for s in parts:
        if held and sum(map(len, held)) + len(s) > cfg.max_chunk_size:
            groups.append(held)
            held = held[-max(1, int(len(held) * cfg.overlap_ratio)) :] if cfg.overlap_ratio > 0 and len(held) > 1 else []
        held = [*held, s]
    groups.append(held)
    return [replace(c, content=(t := " ".join(g)), start_pos=0, end_pos=len(t), refresh=True, note={"sub_chunk_index": str(k)}) for k, g in enumerate(groups)]


def split_large(chunks: list[Chunk], cfg: ChunkConfig) -> list[Chunk]:
    return [x for c in chunks for x in (split_one(c, cfg) if len(c.content) > cfg.max_chunk_size else [c])]


def join_at_boundary(left: str, right: str) -> str:
    a, b = left.rstrip(), right.lstrip()
    cjk = "一" <= a[-1:] <= "鿿" and "一" <= b[:1] <= "鿿"
    return a + b if not a or not b or cjk or b[0] in ",，。.！!？?；;:：" else f"{a} {b}"


def shift(before: Chunk, c: Chunk, cfg: ChunkConfig) -> int:
    """Characters of the next chunk's first sentence that belong to a chunk which ends inside a sentence; 0 if none."""
    if not before.content or not c.content or _ENDED.search(before.content.strip()):
        return 0
    lead = _LEAD.match(c.content)
    n = lead.end() if lead else 0
    moved, rest = c.content[:n].strip(), c.content[n:].strip()
    return n if moved and rest and len(before.content) + len(moved) <= cfg.max_chunk_size and len(rest) >= cfg.min_chunk_size else 0


def shift_boundaries(chunks: list[Chunk], cfg: ChunkConfig) -> list[Chunk]:
    out = chunks[:1]
    for c in chunks[1:]:
        if n := shift(out[-1], c, cfg):
            note = lambda x, by: {**x.note, "boundary_adjusted": "true", "boundary_adjustment": str(by)}
            out[-1] = replace(out[-1], content=join_at_boundary(out[-1].content, c.content[:n].strip()), refresh=True, note=note(out[-1], n))
            c = replace(c, content=c.content[n:].strip(), refresh=True, note=note(c, -n))
        out.append(c)
    return out


def renumbered(chunks: list[Chunk]) -> list[Chunk]:
    """Positions as running lengths, contents without runs of blank lines."""
    out, at = [], 0
    for c in chunks:
        out.append(replace(c, content=re.sub(r"\n{3,}", "\n\n", c.content).strip(), start_pos=at, end_pos=at + len(c.content)))
        at += len(c.content)
    return out


def optimise(chunks: list[Chunk], cfg: ChunkConfig) -> list[Chunk]:
    return renumbered(shift_boundaries(split_large(merge_small(chunks, cfg), cfg), cfg))


def embedding_text(e: Element, k: int) -> str:
    return f"{IMAGE_MARK}{k}]" if e.kind == "image" else e.content


_HEADER, _HEADER_WORDS = ["编号", "检查项", "描述"], ("编号", "检查项", "描述", "项目", "内容", "序号")


def parse_pipes(text: str) -> list[list[str]] | None:
    """Rows of three cells from cells between pipes, where a leading number opens a row; None if there are too few."""
    cells = [c.strip() for c in text.split("|")]
    full = [i for i, c in enumerate(cells) if c]
    cells = cells[full[0] : full[-1] + 1] if full else []
    if len(cells) < 3:
        return None
    head, body = _HEADER, cells
    named = cells[0].split()
    if any(w in cells[0] for w in _HEADER_WORDS) and len(named) > 1:
        head, body = [*named, "描述"][:3], cells[1:]
    rows: list[list[str]] = []
    for c in body:
        if m := re.match(r"(\d+)\s*(.*)$", c):
            if rows and len(rows[-1]) < 2:
                rows.pop()
            rest = m[2].strip()
            asked = rest.find("?")
            if asked > 0:
                rows.append([m[1], rest[: asked + 1].strip(), re.sub(r"^\s*示例[：:]\s*", "", rest[asked + 1 :].strip())])
            else:
                two = rest.split(None, 1)
                rows.append([m[1], *two] if len(two) == 2 else [m[1], rest, ""] if rest else [m[1]])
        elif rows:
            if len(rows[-1]) < 3:
                rows[-1].append(c)
            else:
                rows[-1][2] += " " + c
        elif c:
            rows.append(["1", c, ""])
    if rows and len(rows[-1]) < 2:
        rows.pop()
    if not rows:
        rows = [body[i : i + 3] for i in range(0, len(body), 3) if any(body[i : i + 3])]
        head = _HEADER
    out = [[x.strip() for x in [*r, "", ""][:3]] for r in [head, *rows]]
    return out if len(out) > 1 else None


def parse_markdown_table(text: str, least: int = 2) -> list[list[str]] | None:
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.strip().split("\n") if line.strip() and "---" not in line and "|" in line]
    return rows if len(rows) >= least else None


def parse_table(text: str) -> list[list[str]] | None:
    if text.startswith(TABLE_MARK):
        return parse_pipes(text.replace(TABLE_MARK, "").strip())
    if text.count("|") >= 3:
        return parse_pipes(text)
    lines = text.strip().split("\n")
    return parse_markdown_table(text) if len(lines) > 1 and "---" in text and "|" in text else None


def markdown_rows(rows: list[list[str]], columns: int = 3) -> list[str]:
    """A table as markdown lines of ``columns`` cells; one row alone gets the default header."""
    if not rows:
        return []
    cell = lambda x: " ".join(str(x).split()).replace("|", r"\|")
    line = lambda r: "| " + " | ".join([*map(cell, r), *[""] * columns][:columns]) + " |"
    rule = "| " + " | ".join(["---"] * columns) + " |"
    if len(rows) == 1:
        return [line(_HEADER), rule, line(rows[0]), rule]
    return [line(rows[0]), rule, *map(line, rows[1:])]
