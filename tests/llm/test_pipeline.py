"""The pipeline, stage by stage, against plain Python."""

import collections

import sentencepiece

import corpus_pipeline
from quernstone.llm import pieces, quality
from quernstone.llm.common import written
from quernstone.llm.line_dedup import MIN_SITES
from quernstone.llm.token_counts import tokenizer_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, order = docs.columns, ["doc_id", "text", "source", "lang"]
    plain = lambda df: [tuple(r) for r in df.select(*order).collect()]
    count = collections.Counter
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    want = [r for r in plain(docs) if scores[r[0]] >= 0.5]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), "test")
        if k == 1:
            want = brute.lines(want, MIN_SITES)
        elif k == 2:
            comp = brute.near([r[:2] for r in want])
            want = [r for r in want if comp[r[0]][1] == r[0]]
        elif k == 3:
            want = list(brute.mixed(want).elements())
        if k < 4:
            assert docs.columns == columns and count(plain(docs)) == count(want)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    model = pieces.lattice(tokenizer_path(pieces.MODEL))
    assert count((r.doc_id, tuple(r.pieces), r.decoded) for r in docs.collect()) == count((d, tuple(model.best(t)[0]), t) for d, t, *_ in want)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))
    assert count((r.doc_id, tuple(r.library_ids)) for r in docs.collect()) == count((d, tuple(library.encode(t))) for d, t, *_ in want)


def test_stages_on_odd_rows(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").first().text
    rows = [(1, good, None), (1, good, "a"), (1, good, "a"), (None, good, "b"), (2, None, "b"), (3, "", None), (4, " \n\t", "a"), (5, good + " " + "long " * 20000, "b")]
    odd = spark.createDataFrame([(d, t, None, s, None if t is None else len(t), 7) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, pieces int")
    for docs in (odd, odd.limit(0)):
        none = docs is not odd
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = written(stage(spark, docs, SF), "odd")
            assert k == 4 or docs.columns == odd.columns
            ids = {r.doc_id for r in docs.collect()}
            assert ids <= {r[0] for r in rows} and (none or {None, 1} <= ids)
            if k == 2 and not none:
                assert sum(r.doc_id == 1 for r in docs.collect()) == 1 and sum(r.doc_id is None for r in docs.collect()) == 1
        assert not none or not docs.collect()
