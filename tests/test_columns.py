"""Column expressions against their plain counterparts, sources, sinks and the pipeline."""

import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.config import ChunkConfig
from quernstone.functions import text as T
from quernstone.functions import vectors as V
from quernstone.operators import boundaries, chunks, folds, markdown, quality
from quernstone.plans.pipeline import Chunker, health
from quernstone.sources import files, sinks
from quernstone.streaming.chunks import stream_chunks

TEXTS = ["", " ", "一二。三四！五六？", "The of and. A cut (续)", "a　b\xa0c 1 2", "第一章 开始\n\n- x - y - z", "| a | b |\n|---|---|\n| 1 | 2 |", "1 one 2 two 3 three", "he said \"so...\"", "word " * 80, "这是第一段主题内容。这是完全不同的第二段内容。"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, c string")


def column(df, c):
    return [r.x for r in df.select("doc_id", c.alias("x")).orderBy("doc_id").collect()]


def test_text_columns(texts):
    c = F.col("c")
    assert column(texts, T.collapse(c)) == [" ".join(t.split()) for t in TEXTS]
    for lang in ("zh", "en"):
        assert column(texts, T.token_estimate(c, lang)) == [folds.tokens(t, lang) for t in TEXTS]
        assert column(texts, T.sentences(c, lang)) == [folds.sentences(t, lang) for t in TEXTS]
    assert column(texts, T.quality_sentences(c)) == [chunks.quality_sentences(t) for t in TEXTS]
    assert column(texts, T.is_chapter_title(T.strip(c))) == [folds.is_chapter_title(t.strip()) for t in TEXTS]
    assert column(texts, T.leading_sentence_length(c)) == [len(m[0]) if (m := folds._LEAD.match(t)) else 0 for t in TEXTS]
    assert column(texts, T.join_at_boundary(c, F.lit(" 你好"))) == [folds.join_at_boundary(t, " 你好") for t in TEXTS]
    assert column(texts, T.is_table(c)) == [False, False, False, False, False, True, True, True, False, False, False]
    assert column(texts, quality.completeness(c)) == pytest.approx([chunks.completeness(t) for t in TEXTS])
    assert column(texts, quality.density(c)) == pytest.approx([chunks.density(t) for t in TEXTS])
    assert column(texts, quality.inner_coherence(c)) == pytest.approx([chunks.inner_coherence(t, chunks.embed_features) for t in TEXTS])


def test_ellipsis(spark):
    df = spark.createDataFrame([(0, '他说："你好..."'), (1, "这段话未完..."), (2, '他说："你好……"')], "doc_id long, c string")
    assert column(df, T.quoted_ellipsis(F.col("c"))) == [True, False, True]


def test_feature_cosine_is_that_of_tiled_vectors(texts):
    pairs = texts.select("doc_id", V.text_features(F.col("c")).alias("a"), V.feature_vector(F.col("c")).alias("b"))
    other = V.text_features(F.lit("the other text, 12。的")), V.feature_vector(F.lit("the other text, 12。的"))
    assert column(pairs, V.feature_cosine(F.col("a"), other[0])) == pytest.approx(column(pairs, V.cosine(F.col("b"), other[1])), abs=1e-6)


def test_distinct_texts_are_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def lengths(s: pd.Series) -> pd.Series:
        calls.add(len(s))
        return s.map(lambda t: [float(len(t)), 1.0])

    V.register_embedder("lengths", lengths)
    df = spark.createDataFrame([(0, "alpha"), (1, "beta"), (2, "alpha")], "doc_id long, c string")
    rows = V.embed(df, "c", embedder="lengths").orderBy("doc_id").collect()
    assert rows[0].embedding == rows[2].embedding == [5.0, 1.0] and calls.value == 2


MARKDOWN = "# Title\n\nFirst line of text\nsecond line of it\n\n| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n\n![pic](http://x.example/p/a.png)\n\nLast paragraph of the document"


def test_markdown(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, "")], markdown.SCHEMA)
    p = [(r.type, r.level, r.content) for r in markdown.paragraphs(docs).orderBy("index").collect()]
    assert p == [("heading", 1, "Title"), ("paragraph", None, "First line of text\nsecond line of it"), ("paragraph", None, "Last paragraph of the document")]
    assert [r.data for r in markdown.tables(docs).collect()] == [[["a", "b", "c"], ["1", "2", "3"]]]
    remote = spark.createDataFrame([(1, "http://x.example/p/a.png"), (1, "http://y.example/")], "doc_id long, url string")
    assert sorted((r.url, r.filename, r.source) for r in markdown.all_images(docs, remote).collect()) == [("http://x.example/p/a.png", "a.png", "inline"), ("http://y.example/", "image_1.png", "remote")]
    assert [(r.title, r.paragraphs) for r in markdown.sections(markdown.paragraphs(docs)).collect()] == [("Title", [1, 2])]
    e = [(r.kind, r.embed_text) for r in markdown.elements(docs, language="en").orderBy("pos").collect()]
    assert [k for k, _ in e] == ["paragraph", "table", "image", "paragraph"] and e[2][1] == "[IMAGE_PLACEHOLDER_0]"
    s = {r.doc_id: (r.paragraph_count, r.heading_count, r.table_count, r.image_count) for r in markdown.structure(docs).collect()}
    assert s == {1: (2, 1, 1, 1), 2: (0, 0, 0, 0)}


def test_matching_takes_each_row_once(spark):
    asked = spark.createDataFrame([(1, 0, "# A"), (1, 1, "b  c"), (1, 2, "b c"), (1, 3, "b c")], "doc_id long, pos int, content string")
    there = spark.createDataFrame([(1, 5, "b c"), (1, 3, "A"), (1, 9, "b c")], "doc_id long, index int, content string")
    assert [r.matched for r in markdown.matched(asked, there).orderBy("pos").collect()] == [3, 5, 9, -1]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9])
def test_boundary_operators_on_short_documents(spark, n):
    rows = [(1, i, [1.0, float(i % 3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, embedding array<double>")
    b = sorted(r.boundary for r in boundaries.semantic_boundaries(df).collect())
    assert b[:1] == ([0] if n > 1 else []) and b[-1:] == ([n] if n > 1 else [])
    assert boundaries.similarity_matrix(df).count() == n * (n - 1) // 2
    assert boundaries.changes(df).count() == max(0, n - 2)
    assert boundaries.topic_clusters(df).count() == n


def test_chunks_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    cfg = ChunkConfig(200, 800, 500, 0.1, 0.9, language="en")
    for mode in chunks.MODES:
        a, b = (sorted(map(str, chunks.chunk_documents(docs.repartition(n), cfg, mode, separator="\n").collect())) for n in (1, 8))
        assert a == b and a
    out = chunks.chunk_documents(docs, cfg, separator="\n")
    for _, rows in __import__("itertools").groupby(out.orderBy("doc_id", "chunk_id").collect(), key=lambda r: r.doc_id):
        rows = list(rows)
        assert [r.chunk_id for r in rows] == list(range(len(rows))) and all(x.end_pos == y.start_pos for x, y in zip(rows, rows[1:]))
        assert all(0 <= r.coherence_score <= 1 and 0 <= r.completeness_score <= 1 for r in rows)


def test_safe_mode_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "some text that can't be embedded " * 90), (2, None), (3, "")], "doc_id long, text string")

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception):
        chunks.chunk_documents(docs, embed=broken).collect()
    with pytest.raises(ValueError):
        chunks.chunk_documents(docs, mode="none")
    rows = chunks.chunk_documents(docs, mode="greedy").collect()
    assert {r.doc_id for r in rows} == {1}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_bytes("第一段足够长的文字内容。\r\n\r\n| x | y | z |\n| 1 | 2 | 3 |".encode("gb18030"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        para = lambda t, s="": f"<w:p><w:pPr><w:pStyle w:val='{s}'/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{para('Top', 'Heading1')}<w:tbl><w:tr><w:tc>{para('h')}</w:tc></w:tr><w:tr><w:tc>{para('v')}</w:tc></w:tr></w:tbl>{para('First paragraph here')}{para('item', 'ListNumber')}</w:body></w:document>")
        z.writestr("word/media/i.png", b"\x89PNG\r\n\x1a\n" + b"0" * 200)
        z.writestr("docProps/core.xml", "<c xmlns:d='u'><d:title>T</d:title></c>")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets><sheet name='People'/></sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><t>born</t></si><si><t>in</t></si></sst>")
        z.writestr("xl/styles.xml", "<s><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/></cellXfs></s>")
        z.writestr("xl/worksheets/sheet1.xml", "<w><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c><c r='C1' t='s'><v>2</v></c></row><row><c r='A2'><v>8500.5</v></c><c r='B2' s='1'><v>33008</v></c><c r='C2' s='1'><v>43891.375</v></c></row><row/></sheetData></w>")
    with zipfile.ZipFile(tmp_path / "e.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<p><sp><p><t>Hello</t><t> slide</t></p></sp><sp/></p>")
    (tmp_path / "f.docx").write_bytes(b"broken")
    import zlib

    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (SUMMARY OF PARTS) Tj 0 -40 Td (First line of text that goes) Tj 0 -14 Td [(on \\(he) 20 (re\\)) -300 (in a) -250 (second one.)] TJ ET")
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", b"<</Length %d/Filter/FlateDecode>>stream\n" % len(page) + page + b"\nendstream", b"<</Title <FEFF005400E9>>>"]
    body = b"".join(b"%d 0 obj\n" % k + o + b"\nendobj\n" for k, o in enumerate(objects, 1))
    (tmp_path / "g.pdf").write_bytes(b"%PDF-1.4\n" + body + b"trailer<</Root 1 0 R/Info 5 0 R>>")
    return str(tmp_path)


def test_files(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_files(spark, folder).collect()}
    assert got["a.txt"].markdown.startswith("第一段") and got["a.txt"].n_tables == 1
    assert "PDF" in got["b.pdf"].error and got["f.docx"].error and got["f.docx"].markdown is None
    assert got["g.pdf"].markdown == "## SUMMARY OF PARTS\n\nFirst line of text that goes on (here) in a second one." and got["g.pdf"].properties == {"title": "Té", "page_count": "1"}
    with_own = {r.path.rsplit("/", 1)[-1]: r for r in files.read_files(spark, folder, {".pdf": lambda data: f"{len(data)} bytes"}).collect()}
    assert with_own["b.pdf"].error is None and with_own["b.pdf"].markdown.endswith(" bytes")
    pictures = files.read_images(spark, folder).collect()
    assert [(p.path.rsplit("/", 1)[-1], p.filename, p.format, p.position) for p in pictures] == [("c.docx", "i.png", "png", 0)] and bytes(pictures[0].data).startswith(b"\x89PNG")
    assert {r.path.rsplit("/", 1)[-1] for r in Chunker().failures(spark, folder).collect()} == {"b.pdf", "f.docx"}
    assert got["c.docx"].markdown.split("\n\n")[:3] == ["# Top", "First paragraph here", "1. item"] and "| h |" in got["c.docx"].markdown
    assert [i.format for i in got["c.docx"].images] == ["png"] and got["c.docx"].properties == {"title": "T"}
    assert "| 8500.5 | 1990-05-15 | 2020-03-01 09:00:00 |" in got["d.xlsx"].markdown and got["d.xlsx"].markdown.startswith("## People")
    assert got["e.pptx"].markdown == "## 幻灯片 1\n\nHello slide"


def test_facade_sinks_and_stream(spark, folder, tmp_path_factory):
    cfg = ChunkConfig(50, 500, 200, language="en")
    out = Chunker(cfg).files(spark, folder).cache()
    assert out.count() and {r.chunk_type for r in out.collect()} & {"mixed_content", "table_content", "text_content", "content"}
    where = str(tmp_path_factory.mktemp("out"))
    sinks.save_parquet(out, f"{where}/p")
    assert sorted(map(str, sinks.load_chunks(spark, f"{where}/p").collect())) == sorted(map(str, out.collect()))
    told = [json.loads(r.value) for r in sinks.as_json(out, cfg).collect()]
    assert all([c["id"] for c in t["chunks"]] == list(range(len(t["chunks"]))) and t["config"]["language"] == "en" and t["statistics"]["total_chunks"] == len(t["chunks"]) for t in told)
    q = quality.evaluate(out).collect()
    assert all(0 <= r.overall_score <= 1 for r in q) and quality.report(quality.evaluate(out)).count() == len(q)
    assert quality.summary(out).count() == len(q) and len(quality.preview(out, 1).collect()) == 1
    docs = spark.createDataFrame([(1, "a first paragraph\n\na second one"), (2, "other text here")], "doc_id long, text string")
    docs.write.parquet(f"{where}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{where}/in")
    stream_chunks(stream, f"{where}/s", f"{where}/c", cfg).awaitTermination(120)
    assert spark.read.parquet(f"{where}/s").select("doc_id").distinct().count() == 2
    assert health(2, 10)["status"] == "unhealthy" and health(0, 0)["status"] == "healthy"
    assert health(0, 10, fallback=True, hit_rate=0.1)["status"] == "degraded" and len(health(0, 10, True, 0.1)["warnings"]) == 2


def test_embedding_cache(spark, tmp_path_factory):
    from datetime import datetime, timedelta, timezone

    from quernstone.functions.cache import EmbeddingCache

    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    cache = EmbeddingCache(spark, str(tmp_path_factory.mktemp("cache")), max_size=3, ttl_seconds=60)
    ask = lambda rows, at: {r.c: r.embedding for r in cache.embed(spark.createDataFrame([(t,) for t in rows], "c string"), "c", now=at).collect()}
    first = ask(["alpha", "beta", "alpha", None], now)
    assert set(first) == {"alpha", "beta", None} and first[None] is None and (cache.hits, cache.misses) == (0, 2)
    assert ask(["beta", "gamma"], now + timedelta(seconds=30))["beta"] == first["beta"] and (cache.hits, cache.misses) == (1, 3)
    ask(["delta"], now + timedelta(seconds=40))
    assert {r.text for r in cache.table(now + timedelta(seconds=41)).collect()} == {"beta", "gamma", "delta"}
    assert {r.text for r in cache.table(now + timedelta(seconds=75)).collect()} == {"gamma", "delta"}
    again = EmbeddingCache(spark, cache.path, max_size=3, ttl_seconds=60)
    assert again.generation == cache.generation
    from quernstone.functions import vectors

    vectors.register_embedder("ones", lambda c: F.array(F.lit(1.0), F.lit(1.0)))
    one = again.embed(spark.createDataFrame([("gamma",)], "c string"), "c", "ones", now=now).first()
    assert list(one.embedding) == [1, 1] and again.misses == 1
    cache.clear()
    assert EmbeddingCache(spark, cache.path).generation == 0
    assert cache.stats()["size"] == 0


def test_key_phrases(spark):
    from quernstone.operators.phrases import key_phrases

    docs = spark.createDataFrame([(1, "The cat, the dog and cat. Dog bird"), (2, "语义切片，语义检索的语义")], "doc_id long, text string")
    assert [(r.phrase, r.n) for r in key_phrases(docs.filter("doc_id = 1"), 2).orderBy("rank").collect()] == [("cat", 2), ("dog", 2)]
    assert [(r.phrase, r.n) for r in key_phrases(docs.filter("doc_id = 2"), 1, "zh").collect()] == [("语义", 3)]


def test_tables_and_images_are_matched(spark):
    asked = spark.createDataFrame([(1, 0, "| a |\n| 1 |"), (1, 1, "| z |"), (1, 2, "| y |")], "doc_id long, pos int, content string")
    there = spark.createDataFrame([(1, 7, "|  b |"), (1, 8, "| a |\n\n| 1  |")], "doc_id long, index int, content string")
    assert [r.matched for r in markdown.matched_tables(asked, there).orderBy("pos").collect()] == [8, 7, -1]
    asked = spark.createDataFrame([(1, 0, "u", "x"), (1, 1, "v", "f.png"), (1, 2, "w", "x")], "doc_id long, pos int, url string, alt string")
    there = spark.createDataFrame([(1, 3, "q", "f.png"), (1, 4, "u", "g.png")], "doc_id long, index int, url string, filename string")
    assert [r.matched for r in markdown.matched_images(asked, there).orderBy("pos").collect()] == [4, 3, -1]


def test_document_metadata(spark):
    docs = spark.createDataFrame([(1, "some text that is long enough", "web", 3)], "doc_id long, text string, source string, level int")
    out = chunks.attach_metadata(chunks.chunk_documents(docs), docs, "source", "level").collect()
    assert out and all(r.metadata["source"] == "web" and r.metadata["level"] == "3" for r in out)


def test_key_phrases_drop_whole_words_only(spark):
    from quernstone.operators.phrases import key_phrases

    docs = spark.createDataFrame([(1, "上海人民。上海我们")], "doc_id long, text string")
    assert [r.phrase for r in key_phrases(docs, language="zh").orderBy("rank").collect()] == ["上海", "海人", "人民", "海我"]
    assert "上海" not in [r.phrase for r in key_phrases(docs, language="zh", stop=["上海"]).collect()]


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", "A text that is long enough.")], "doc_id string, text string")
    assert [(r.doc_id, r.content) for r in Chunker().texts(docs).collect()] == [("x", "A text that is long enough.")]
    with pytest.raises(ValueError):
        from quernstone.operators.chunks import optimised

        optimised(docs.selectExpr("doc_id", "0 AS chunk_id", "text AS content"), ChunkConfig(), "polish")


def test_trims_agree_with_the_pattern_of_white_space(spark):
    from quernstone.functions import text as T

    rows = [(i, f"{chr(i)}a{chr(i)}b{chr(i)}\n") for i in range(1, 0x3100)] + [(0, ""), (-1, " \n\t"), (-2, None)]
    c = F.col("c")
    pairs = [(T.strip(c), r"(?U)^\s+|\s+$"), (T.rstrip(c), r"(?U)\s+$"), (T.lstrip(c), r"(?U)^\s+")]
    df = spark.createDataFrame(rows, "i int, c string")
    for got, pattern in pairs:
        assert df.filter(~got.eqNullSafe(F.regexp_replace(c, pattern, ""))).count() == 0


def test_key_phrases_of_empty_null_and_repeated_rows(spark):
    from quernstone.operators.phrases import key_phrases

    docs = spark.createDataFrame([(1, "beta alpha beta"), (1, "gamma"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, key_phrases(docs).collect())) == [(1, "alpha", 1, 2), (1, "beta", 2, 1), (1, "gamma", 1, 1)]
    assert key_phrases(docs.limit(0)).count() == 0


def test_evaluation_of_null_contents_and_a_lone_chunk(spark):
    from quernstone.operators import quality as Q

    rows = [(1, 0, "One chunk alone, that ends here."), (2, 0, "First part of two。"), (2, 1, None), (3, 0, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id int, content string").withColumn("semantic_score", F.lit(0.9))
    got = {r.doc_id: r for r in Q.evaluate(chunks).collect()}
    assert {k: r.n_chunks for k, r in got.items()} == {1: 1, 2: 2, 3: 1}
    assert [got[k].boundary_quality for k in (1, 2, 3)] == [1.0, 1.0, 1.0]
    assert Q.boundary_scores(chunks).count() == 0


def test_evaluation_of_documents_without_chunks(spark):
    from quernstone import __version__, version_info

    chunks = spark.createDataFrame([(1, 0, "One chunk alone, that ends here.", 0.9)], "doc_id long, chunk_id int, content string, semantic_score double")
    got = {r.doc_id: r.asDict() for r in Chunker().evaluate(chunks, spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")).collect()}
    assert got[1]["n_chunks"] == 1 and got[1]["overall_score"] > 0
    assert got[2].pop("suggestions") == [] and got[2].pop("doc_id") == 2
    assert set(got[2].values()) == {0}
    assert version_info()["version"] == __version__


def test_images_have_urls_under_a_base(spark, tmp_path):
    from quernstone.sources.files import read_images

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/media/one.png", b"\x89PNG\r\n\x1a\n" + bytes(200))
    row = read_images(spark, str(tmp_path), "http://files.test/").first()
    assert row.url == f"http://files.test/{row.doc_id}/one.png"
    assert "url" not in read_images(spark, str(tmp_path)).columns
