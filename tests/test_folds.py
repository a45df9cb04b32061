"""Sequential steps on small inputs."""

import numpy as np
import pytest

from quernstone.config import ChunkConfig, CoherenceConfig
from quernstone.operators import folds
from quernstone.operators.chunks import completeness
from quernstone.operators.folds import Chunk, Element

EN = ChunkConfig(min_chunk_size=1, max_chunk_size=12, target_chunk_size=6, overlap_ratio=0.0, language="en")


def test_force_split():
    assert [c.content for c in folds.split_large([Chunk("alpha beta gamma delta")], EN)] == ["alpha beta", "gamma", "delta"]


def test_force_split_stops_at_the_end():
    out = folds.force_split(Chunk("x" * 100), EN.with_(target_chunk_size=30, overlap_ratio=0.2))
    assert [(c.start_pos, c.end_pos) for c in out] == [(0, 30), (24, 54), (48, 78), (72, 100)]


def test_renumbered():
    assert [(c.start_pos, c.end_pos) for c in folds.renumbered([Chunk("abc", 10, 13), Chunk("defgh", 30, 35)])] == [(0, 3), (3, 8)]


def test_boundary_shift():
    cfg = EN.with_(min_chunk_size=5, max_chunk_size=80, target_chunk_size=40)
    a, b = folds.shift_boundaries([Chunk("This sentence is cut"), Chunk("off here. Next sentence remains.")], cfg)
    assert (a.content, b.content) == ("This sentence is cut off here.", "Next sentence remains.")
    assert a.refresh and b.refresh and a.note["boundary_adjusted"] == b.note["boundary_adjusted"] == "true"
    assert a.note["boundary_adjustment"] == "10" and b.note["boundary_adjustment"] == "-10"


def test_greedy_goes_on_below_target():
    cfg = ChunkConfig(5, 100, 80, 0.0, 0.95, language="en")
    v = np.array([[1.0, 0], [0, 1], [1, 0]])
    assert folds.greedy([Element(t) for t in ("alpha topic", "beta topic", "gamma topic")], v, cfg) == [[0, 1, 2]]


def test_greedy_breaks_and_overlaps():
    cfg = ChunkConfig(5, 25, 10, 0.5, 0.5)
    v = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]])
    assert folds.greedy([Element("x" * 6)] * 4, v, cfg) == [[0, 1], [1, 2, 3]]
    cfg = cfg.with_(max_chunk_size=100, target_chunk_size=90, overlap_ratio=0.0)
    assert folds.greedy([Element("x" * 6), Element("head", heading=True), Element("x" * 6)], np.ones((3, 1)), cfg) == [[0], [1, 2]]


@pytest.mark.parametrize(
    ("text", "score"),
    [("这是一个正常的句子。", 0.8), ("这是一个正常的句子", 0.5), ("他沉默了一会儿……然后继续说话。", 1.0), ("详见第二章的内容。", 0.8), ("小明说：\"你好...\"", 0.7), ("(续)", 0.1), ("(未完)", 0.1), ("这段话未完...", 0.6), ("更多内容详见", 0.3), ("参考文档详见附录A。", 0.8)],
)
def test_completeness(text, score):
    assert completeness(text) == pytest.approx(score)


def test_merge_small():
    cfg = ChunkConfig(10, 30, 20)
    sizes = lambda ns: [len(c.content) for c in folds.merge_small([Chunk("x" * n, paragraph_indices=(i,)) for i, n in enumerate(ns)], cfg)]
    assert sizes([5]) == [5] and sizes([5, 5]) == [12] and sizes([5, 15, 15]) == [22, 15] and sizes([9, 9, 25]) == [20, 25] and sizes([5, 28]) == [5, 28] and sizes([15, 5]) == [15, 5]


def test_coherence_parts():
    v = folds.unit(np.array([[1.0, 0], [1, 1], [0, 1], [1, 2]]))
    assert folds.mean_coherence(v, [], 1) == 0 and folds.mean_coherence(v, [0, 2], 1) == pytest.approx(np.sqrt(0.5))
    assert folds.recent_coherence(v, [0, 0, 1, 2], 3) == pytest.approx(np.mean([v[i] @ v[3] for i in (0, 1, 2)]))
    assert 0 <= folds.weighted_coherence(v, [0, 1, 2], 3) <= 1 and folds.weighted_coherence(v, [], 0) == 0
    assert folds.trend(np.array([0.5, 0.5, 0.5]), CoherenceConfig()) == 0 and folds.trend(np.array([0.1, 0.9, 0.1]), CoherenceConfig()) == pytest.approx(-0.1 * (1.6 + 0.08))
    assert folds.consistency(np.array([0.5])) == 1 and folds.consistency(np.array([1.0, 1.0, 1.0, 1.0, 2.0])) < folds.consistency(np.array([1.0, 1.0, 1.0, 1.0, 1.0]))
    assert folds.pair_mean(v, [0]) == 1 and folds.pair_mean(v, [0, 1, 2]) == pytest.approx(np.mean([v[0] @ v[1], v[0] @ v[2], v[1] @ v[2]]))


def test_boundaries():
    assert folds.boundaries(["a", "b"], np.ones((2, 1))) == [0, 2]
    assert folds.spaced([0, 1, 2, 3, 5]) == [0, 2, 5]
    assert folds.structural_boundaries(["第一章 起", "x" * 60 + "。", "- item", "y" * 70 + "。"]) == [0, 1, 2, 3]


def test_tables():
    assert folds.parse_pipes("编号 检查项 描述 | 1 ok? 示例: yes | 2 two words | more") == [["编号", "检查项", "描述"], ["1", "ok?", "yes"], ["2", "two", "words more"]]
    assert folds.parse_pipes("a|b") is None
    assert folds.parse_markdown_table("a | b\n--- | ---\n1 | 2") == [["a", "b"], ["1", "2"]]
    assert folds.markdown_rows([["x", "y|z", "w", "cut"], ["1"]]) == ["| x | y\\|z | w |", "| --- | --- | --- |", "| 1 |  |  |"]
    assert len(folds.markdown_rows([["one"]])) == 4


def test_paragraphs():
    cfg = ChunkConfig(max_chunk_size=20)
    assert folds.paragraphs("one\n\ntwo \n \n three", cfg) == ["one", "two", "three"]
    assert folds.paragraphs("aaaa. bbbb. cccc. dddd. eeee.", cfg) == ["aaaa。bbbb。cccc。", "dddd。eeee。"]


def test_config():
    assert ChunkConfig.preset("high_precision").overlap_ratio == 0.2
    with pytest.raises(ValueError):
        ChunkConfig.preset("none")
    assert ChunkConfig.from_json('{"min_chunk_size": 5}') == ChunkConfig() == ChunkConfig.from_json("no") == ChunkConfig.from_json(None)
    assert ChunkConfig.from_json('{"min_chunk_size": 60, "language": "en"}').language == "en"
    with pytest.raises(ValueError):
        ChunkConfig.from_json('{"language": "xx"}', strict=True)
    with pytest.warns(UserWarning):
        assert CoherenceConfig().with_(position_decay_factor=1.0, odd=1).position_decay_factor == 1.0
