"""Queries over the driver's tables, one per operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.config import ChunkConfig
from quernstone.functions import batches as A
from quernstone.functions import text as T
from quernstone.functions import vectors as V
from quernstone.operators import boundaries as B
from quernstone.operators import chunks as C
from quernstone.operators import markdown as M
from quernstone.operators import phrases as P
from quernstone.operators import quality as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Sizes for the queries' chunks.
SIZES = ChunkConfig(min_chunk_size=200, max_chunk_size=800, target_chunk_size=500, language="en")


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "text")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))


#: The SQL counterparts of the frames above; RE2 has no Unicode \s, so white space is spelled out.
_WS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
_LINES = "SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos, unnest(string_split(text, chr(10))) AS content FROM documents"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sql_flat(x: str) -> str:
    return _sql_strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def _sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


@query(f"SELECT doc_id, pos, {_sql_flat('content')} AS content FROM ({_LINES}) WHERE length({_sql_flat('content')}) >= 5")
def split_paragraphs(spark, sf):
    return _lines(spark, sf).select("doc_id", "pos", T.collapse(F.col("content")).alias("content")).filter(F.length("content") >= 5)


@query(f"""SELECT doc_id, {_sql_strip(f"regexp_replace({_sql_flat('text')}, '[^' || chr(19968) || '-' || chr(40959) || chr(12288) || '-' || chr(12351) || 'A-Za-z0-9\\s.,!?;:\"()（）【】\\[\\]<>《》]', '', 'g')")} AS content FROM documents""")
def clean_text_zh(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text(F.col("text"), "zh").alias("content"))


def _sql_clean_en(x: str) -> str:
    other = r"""[^\p{L}\p{M}\p{Nd}\p{Pc}\s.,!?;:"''()\[\]<>-]"""
    return _sql_strip(f"regexp_replace({_sql_flat(x)}, '{other}', '', 'g')")


@query(f"SELECT doc_id, {_sql_clean_en('text')} AS content FROM documents")
def clean_text_en(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text(F.col("text"), "en").alias("content"))


@query(f"SELECT doc_id, (trunc(length(text) / 1.3::DOUBLE))::INT AS zh, trunc(len({_sql_words('text')}) / 0.75::DOUBLE)::INT AS en FROM documents")
def token_estimates(spark, sf):
    return _docs(spark, sf).select("doc_id", T.token_estimate(F.col("text"), "zh").alias("zh"), T.token_estimate(F.col("text"), "en").alias("en"))


@query(f"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?;]'), lambda x: {_sql_strip('x')}), lambda x: x <> '') AS en, list_filter(list_transform(regexp_split_to_array(text, '[。！？；]'), lambda x: {_sql_strip('x')}), lambda x: length(x) > 5) AS quality FROM documents")
def sentence_split(spark, sf):
    return _docs(spark, sf).select("doc_id", T.sentences(F.col("text"), "en").alias("en"), T.quality_sentences(F.col("text")).alias("quality"))


@query(f"SELECT doc_id, CASE WHEN {_sql_strip('text')} = '' THEN '' WHEN contains(text, '[IMAGE_PLACEHOLDER_') THEN '图片内容' ELSE substring({_sql_flat('text')}, 1, 256) END AS content FROM documents")
def embedding_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.for_embedding(F.col("text"), "en").alias("content"))


@query(f"SELECT doc_id, pos, CASE WHEN regexp_matches(c, '^第\\s*\\d+\\s*页.*$') OR regexp_matches(c, '^\\d+$') OR regexp_matches(c, '^[-=_]{{3,}}$') THEN '' ELSE c END AS content FROM (SELECT doc_id, pos, {_sql_flat('content')} AS c FROM ({_LINES}))")
def page_noise(spark, sf):
    return _lines(spark, sf).select("doc_id", "pos", T.clean_page_noise(F.col("content")).alias("content"))


@query(rf"""
WITH l AS (SELECT doc_id, pos, {_sql_strip('content')} AS c, lag(content) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM ({_LINES}))
SELECT doc_id, pos,
  regexp_matches(c, '^第[一二三四五六七八九十\d]+[章节部分]') OR regexp_matches(c, '^\d+[\.\s]+[^\n]{{1,50}}$') OR regexp_matches(c, '^[一二三四五六七八九十]+[\.\s、]+[^\n]{{1,50}}$') OR (length(c) < 50 AND NOT regexp_matches(c, '[。.！!？?]$')) AS title,
  regexp_matches(c, '^(\d+[\.\)]|[•·▪▫]|[-*+])') AS list_start,
  length(c) <= 100 AND ((upper(c) = c AND lower(c) <> c) OR regexp_matches(c, '^[A-Z][^.!?]*$') OR regexp_matches(c, '^\d+[\.\s]+[A-Z]')) AS heading,
  CASE WHEN b IS NULL THEN false ELSE length(c)::DOUBLE / greatest(length(b), 1) > 3 OR length(c)::DOUBLE / greatest(length(b), 1) < 0.3 OR (length(b) - length(replace(b, '。', '')) > 2 AND NOT contains(c, '。')) END AS shift
FROM l""")
def structure_flags(spark, sf):
    before = F.lag("content").over(B.order())
    c = F.col("c")
    lines = _lines(spark, sf).withColumn("b", before).withColumn("c", T.strip(F.col("content")))
    shift = F.when(F.col("b").isNull(), F.lit(False)).otherwise(T.is_paragraph_shift(F.col("b"), c))
    return lines.select("doc_id", "pos", T.is_chapter_title(c).alias("title"), T.is_list_start(c).alias("list_start"), T.is_pdf_heading(c).alias("heading"), shift.alias("shift"))


@query(r"""
WITH b AS (SELECT doc_id, pos, content, length(content) - length(replace(content, '|', '')) AS pipes, regexp_extract_all(content, '\d+\D*') AS runs, regexp_extract(content, '^\D*') AS before FROM (""" + _LINES + r"""))
SELECT doc_id, pos, length(content) AS n FROM b
WHERE pipes >= 3 OR starts_with(content, '[表格内容]') OR (pipes >= 2 AND regexp_matches(content, '编号|检查项|描述|项目|内容|序号|名称|说明'))
  OR ((pipes >= 2 OR contains(content, chr(9))) AND len(list_filter(regexp_split_to_array(content, '[|\t]'), lambda x: trim(x) <> '')) >= 3)
  OR len(regexp_extract_all(content, '[-•·]\s*[^-•·]+')) >= 3
  OR regexp_matches(content, '\d+\s+[^0-9]+?\?\s*示例[：:]\s*[^0-9]*\d+\s+')
  OR len(list_filter(range(1, len(runs) + 1), lambda i: regexp_matches(runs[i], '^\d+\s\D') AND (i = len(runs) OR regexp_matches(runs[i + 1], '^\d+\s')) AND NOT regexp_matches(CASE WHEN i = 1 THEN before ELSE runs[i - 1] END, '[\p{L}\p{N}_]$'))) >= 3""")
def table_lines(spark, sf):
    return _lines(spark, sf).filter(T.is_table(F.col("content"))).select("doc_id", "pos", F.length("content").alias("n"))


@query("""SELECT p_partkey AS doc_id, ['| ' || array_to_string(['key', 'name', 'brand'], ' | ') || ' |', '| --- | --- | --- |', '| ' || p_partkey || ' | ' || replace(p_name, '|', '\\|') || ' | ' || replace(p_brand, '|', '\\|') || ' |'] AS lines FROM part""")
def markdown_table_render(spark, sf):
    rows = F.array(F.array(F.lit("key"), F.lit("name"), F.lit("brand")), F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand"))
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), M.rendered(rows).alias("lines"))


@query()
def pipe_table_parse(spark, sf):
    import pyarrow as pa

    from quernstone.operators.folds import parse_table

    def run(batches):
        for b in A.slices(batches):
            rows = [parse_table(x.as_py() or "") for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, pa.list_(pa.list_(pa.string())))], names=["doc_id", "data"])

    A.small_batches(spark)
    return _docs(spark, sf).mapInArrow(run, "doc_id long, data array<array<string>>").filter("data IS NOT NULL")


_F13 = "[length(t) / 1000.0::DOUBLE, " + ", ".join(f"(length(t) - length(replace(t, '{c}', ''))) / greatest(length(t), 1)::DOUBLE" for c in V.COMMON) + f", (length(t) - length(regexp_replace(t, '[{V.POINTS}]', '', 'g'))) / greatest(length(t), 1)::DOUBLE, (length(t) - length(regexp_replace(t, '\\p{{Nd}}', '', 'g'))) / greatest(length(t), 1)::DOUBLE]"


@query(f"""
WITH l AS (SELECT doc_id, pos, content AS t FROM ({_LINES})), f AS (SELECT doc_id, pos, {_F13} AS v FROM l),
n AS (SELECT doc_id, pos, v AS a, lead(v) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM f),
d AS (SELECT doc_id, pos, list_sum(list_transform(list_zip({V.REPEATS}, a, b), lambda x: x[1] * x[2] * x[3])) AS ab, list_sum(list_transform(list_zip({V.REPEATS}, a), lambda x: x[1] * x[2] * x[2])) AS aa, list_sum(list_transform(list_zip({V.REPEATS}, b), lambda x: x[1] * x[2] * x[2])) AS bb FROM n WHERE b IS NOT NULL)
SELECT doc_id, pos, round(CASE WHEN aa * bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0 END, 6) AS sim FROM d""")
def feature_similarity(spark, sf):
    v = _lines(spark, sf).withColumn("embedding", V.text_features(F.col("content")))
    return B.adjacent(v, V.feature_cosine).filter("sim IS NOT NULL").select("doc_id", "pos", F.round("sim", 6).alias("sim"))


@query("SELECT doc_id, length(text) || '_' || substr(md5(text), 1, 16) AS key, count(*) OVER (PARTITION BY length(text) || '_' || substr(md5(text), 1, 16)) AS n FROM documents")
def cache_keys(spark, sf):
    keyed = _docs(spark, sf).select("doc_id", T.cache_key(F.col("text")).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")), "key").select("doc_id", "key", "n")


def _vectors(spark, sf):
    return _table(spark, sf, "embeddings").select((F.col("vec_id") / 20).cast("long").alias("doc_id"), (F.col("vec_id") % 20).alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))


_VEC = "SELECT vec_id // 20 AS doc_id, vec_id % 20 AS pos, embedding::DOUBLE[] AS e FROM embeddings"
_SIMS = f"SELECT doc_id, pos, list_cosine_similarity(e, lead(e) OVER (PARTITION BY doc_id ORDER BY pos)) AS sim FROM ({_VEC})"


@query(f"SELECT doc_id, pos, round(sim, 6) AS sim FROM ({_SIMS}) WHERE sim IS NOT NULL")
def cosine_adjacent(spark, sf):
    return B.adjacent(_vectors(spark, sf)).filter("sim IS NOT NULL").select("doc_id", "pos", F.round("sim", 6).alias("sim"))


@query(f"SELECT a.doc_id, a.pos AS i, b.pos AS j, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM ({_VEC}) a JOIN ({_VEC}) b ON a.doc_id = b.doc_id AND a.pos < b.pos")
def similarity_matrix(spark, sf):
    return B.similarity_matrix(_vectors(spark, sf)).withColumn("sim", F.round("sim", 6))


@query(f"""
WITH s AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, avg(sim) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM ({_SIMS}) WHERE sim IS NOT NULL),
c AS (SELECT doc_id, count(*) AS n FROM ({_VEC}) GROUP BY doc_id HAVING count(*) > 1)
SELECT doc_id, pos + 1 AS boundary FROM s WHERE CASE WHEN n > 5 THEN m ELSE sim END < 0.1 UNION ALL SELECT doc_id, 0 FROM c UNION ALL SELECT doc_id, n FROM c""")
def semantic_boundaries(spark, sf):
    return B.semantic_boundaries(_vectors(spark, sf), threshold=0.1)


_CHANGES = f"SELECT doc_id, pos, abs(b - sim) AS change FROM (SELECT *, lag(sim) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM ({_SIMS})) WHERE sim IS NOT NULL AND b IS NOT NULL"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY change DESC, pos)::INT AS rank, pos, round(change, 6) AS change FROM ({_CHANGES}) WHERE change > 0.3")
def semantic_shifts(spark, sf):
    return B.semantic_shifts(_vectors(spark, sf)).withColumn("change", F.round("change", 6))


@query(f"""
SELECT d.doc_id, round(coalesce(avg(CASE WHEN sim <> 0 THEN sim END), 0), 6) AS coherence
FROM (SELECT DISTINCT doc_id FROM ({_VEC})) d LEFT JOIN (SELECT a.doc_id, list_cosine_similarity(a.e, b.e) AS sim FROM ({_VEC}) a JOIN ({_VEC}) b ON a.doc_id = b.doc_id AND a.pos < b.pos) s ON d.doc_id = s.doc_id GROUP BY 1""")
def topic_coherence(spark, sf):
    return B.topic_coherence(_vectors(spark, sf)).withColumn("coherence", F.round("coherence", 6))


@query(f"""
WITH RECURSIVE c AS ({_CHANGES}), s AS (SELECT *, avg(change) OVER (PARTITION BY doc_id) + stddev_pop(change) OVER (PARTITION BY doc_id) AS cut FROM c),
b AS (SELECT doc_id, pos AS at FROM s WHERE change > cut UNION SELECT doc_id, 0 FROM ({_VEC})),
r AS (SELECT doc_id, min(at) AS at FROM b GROUP BY doc_id
      UNION ALL SELECT r.doc_id, (SELECT min(b.at) FROM b WHERE b.doc_id = r.doc_id AND b.at >= r.at + 2) AS at FROM r WHERE r.at IS NOT NULL)
SELECT doc_id, at AS boundary FROM r WHERE at IS NOT NULL""".replace(" at ", " pos_at ").replace(".at", ".pos_at").replace("(at)", "(pos_at)").replace(" at,", " pos_at,").replace("AS at", "AS pos_at"))
def gradient_boundaries(spark, sf):
    v = _vectors(spark, sf)
    found = B.sharp_changes(v).select("doc_id", F.col("pos").alias("boundary")).unionByName(v.select("doc_id", F.lit(0).cast("long").alias("boundary")).distinct())
    return B.spaced(found)


@query()
def topic_clusters(spark, sf):
    return B.topic_clusters(_vectors(spark, sf))


_PACK = f"""
p AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (SELECT doc_id, pos, {_sql_flat('content')} AS content FROM ({_LINES})) WHERE length(content) >= 5),
g AS (SELECT doc_id, k, 0 AS chunk_id, length(content) AS size FROM p WHERE k = 1
      UNION ALL SELECT p.doc_id, p.k, CASE WHEN g.size + length(p.content) > 800 THEN g.chunk_id + 1 ELSE g.chunk_id END,
                       CASE WHEN g.size + length(p.content) > 800 THEN length(p.content) ELSE g.size + length(p.content) END FROM g JOIN p ON p.doc_id = g.doc_id AND p.k = g.k + 1),
ch AS (SELECT g.doc_id, g.chunk_id, string_agg(p.content, chr(10) || chr(10) ORDER BY g.k) AS content, count(*)::INT AS n_parts FROM g JOIN p USING (doc_id, k) GROUP BY g.doc_id, g.chunk_id)"""


def _chunks(spark, sf):
    return C.length_chunks(_docs(spark, sf), SIZES)


@query(f"WITH RECURSIVE {_PACK} SELECT * FROM ch")
def greedy_chunks_length(spark, sf):
    return _chunks(spark, sf)


@query(f"""WITH RECURSIVE {_PACK} SELECT doc_id, chunk_id, sum(length(content)) OVER w - length(content) AS start_pos, (sum(length(content)) OVER w)::BIGINT AS end_pos, content, trunc(len({_sql_words('content')}) / 0.75::DOUBLE)::INT AS token_count FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)""")
def chunk_positions(spark, sf):
    return C.positions(_chunks(spark, sf), "en")


def _fixed(size: int) -> str:
    return f"SELECT doc_id, (i // {size})::INT AS chunk_id, i::INT AS start_pos, least(i + {size}, length(text))::INT AS end_pos, substring(text, i + 1, {size}) AS content FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, {size})) AS i FROM documents)"


@query(_fixed(1800))
def window_chunks_simple(spark, sf):
    return C.window_chunks(_docs(spark, sf), ChunkConfig().target_chunk_size)


@query(_fixed(1000))
def window_chunks_emergency(spark, sf):
    return C.window_chunks(_docs(spark, sf), 1000)


_SQL_COMPLETE = f"""round(greatest(0.1, 1.0 - CASE WHEN regexp_matches({_sql_strip('content')}, '[。.！!？?；;]$') THEN 0 ELSE 0.3 END - CASE WHEN length(string_split(content, '。')[1]) < 10 THEN 0.2 ELSE 0 END
 - CASE WHEN regexp_matches({_sql_strip('content')}, '(\\((续|未完)\\)|（(续|未完)）)$') THEN 0.4 ELSE 0 END - CASE WHEN regexp_matches({_sql_strip('content')}, '(\\.\\.\\.|……)$') THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches({_sql_strip('content')}, '详见$') THEN 0.2 ELSE 0 END)::DOUBLE, 6)"""


@query(f"WITH RECURSIVE {_PACK} SELECT doc_id, chunk_id, {_SQL_COMPLETE} AS completeness FROM ch")
def completeness(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_id", F.round(Q.completeness(F.col("content")), 6).alias("completeness"))


@query(f"""WITH RECURSIVE {_PACK}, w AS (SELECT doc_id, chunk_id, {_sql_words('content')} AS ws, list_transform(list_filter(list_transform(string_split_regex(content, '[。！？；]'), lambda x: {_sql_strip('x')}), lambda x: length(x) > 5), lambda x: len({_sql_words('x')})) AS s FROM ch)
SELECT doc_id, chunk_id, round(CASE WHEN len(ws) = 0 THEN 0 ELSE 0.7::DOUBLE * len(list_distinct(list_transform(list_filter(ws, lambda x: regexp_full_match(x, '\\p{{L}}+')), lambda x: lower(x)))) / len(ws)
 + CASE WHEN len(s) > 1 THEN 0.3::DOUBLE * least(1.0, list_stddev_pop(s) / (list_avg(s) + 1e-6)) ELSE 0 END END, 6) AS density FROM w""")
def semantic_density(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_id", F.round(Q.density(F.col("content")), 6).alias("density"))


@query(f"WITH RECURSIVE {_PACK} SELECT doc_id, round(CASE WHEN count(*) < 2 THEN 1.0 WHEN avg(length(content)) = 0 THEN 0.0 ELSE greatest(0.0, 1 - stddev_pop(length(content)) / avg(length(content))) END, 6) AS balance FROM ch GROUP BY doc_id")
def length_balance(spark, sf):
    return _chunks(spark, sf).groupBy("doc_id").agg(F.round(Q.length_balance(F.length("content")), 6).alias("balance"))


_EDGES = f"""
nx AS (SELECT doc_id, chunk_id, content AS c, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS a FROM ch),
fa AS (SELECT doc_id, chunk_id, {_F13} AS v FROM (SELECT doc_id, chunk_id, right(c, 100) AS t FROM nx WHERE a IS NOT NULL)), fb AS (SELECT doc_id, chunk_id, {_F13} AS w FROM (SELECT doc_id, chunk_id, left(a, 100) AS t FROM nx WHERE a IS NOT NULL)),
fd AS (SELECT doc_id, chunk_id, list_sum(list_transform(list_zip({V.REPEATS}, v, w), lambda x: x[1] * x[2] * x[3])) AS ab, list_sum(list_transform(list_zip({V.REPEATS}, v), lambda x: x[1] * x[2] * x[2])) AS aa, list_sum(list_transform(list_zip({V.REPEATS}, w), lambda x: x[1] * x[2] * x[2])) AS bb FROM fa JOIN fb USING (doc_id, chunk_id)),
edges AS (SELECT doc_id, chunk_id, least(1.0::DOUBLE, 1 - CASE WHEN aa * bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0 END + CASE WHEN regexp_matches({_sql_strip('c')}, '[。.！!？?]$') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches({_sql_strip('a')}, '^[第章节一二三四五]') THEN 0.1::DOUBLE ELSE 0 END) AS score FROM fd JOIN nx USING (doc_id, chunk_id))"""


@query(f"WITH RECURSIVE {_PACK}, {_EDGES} SELECT doc_id, chunk_id, round(score, 6) AS score FROM edges")
def boundary_quality(spark, sf):
    return Q.boundary_scores(_chunks(spark, sf)).withColumn("score", F.round("score", 6))


_SQL_DENSITY = f"""CASE WHEN len({_sql_words('content')}) = 0 THEN 0 ELSE 0.7::DOUBLE * len(list_distinct(list_transform(list_filter({_sql_words('content')}, lambda x: regexp_full_match(x, '\\p{{L}}+')), lambda x: lower(x)))) / len({_sql_words('content')})
 + CASE WHEN len(s) > 1 THEN 0.3::DOUBLE * least(1.0, list_stddev_pop(s) / (list_avg(s) + 1e-6)) ELSE 0 END END"""


@query(f"""WITH RECURSIVE {_PACK}, {_EDGES}, w AS (SELECT doc_id, chunk_id, content, list_transform(list_filter(list_transform(string_split_regex(content, '[。！？；]'), lambda x: {_sql_strip('x')}), lambda x: length(x) > 5), lambda x: len({_sql_words('x')})) AS s FROM ch),
m AS (SELECT doc_id, count(*) AS n_chunks, avg({_SQL_COMPLETE}) AS completeness, avg({_SQL_DENSITY}) AS density, max(length(content))::DOUBLE / (min(length(content)) + 1) AS spread,
  CASE WHEN count(*) < 2 THEN 1.0 WHEN avg(length(content)) = 0 THEN 0.0 ELSE greatest(0.0, 1 - stddev_pop(length(content)) / avg(length(content))) END AS balance FROM w GROUP BY doc_id),
b AS (SELECT m.*, coalesce(e.b, 1.0) AS boundary FROM m LEFT JOIN (SELECT doc_id, avg(score) AS b FROM edges GROUP BY 1) e USING (doc_id)),
o AS (SELECT *, 0.3::DOUBLE * 0.75 + 0.25::DOUBLE * completeness + 0.15::DOUBLE * balance + 0.15::DOUBLE * density + 0.15::DOUBLE * boundary AS overall FROM b)
SELECT doc_id, n_chunks, round(completeness + 1e-9, 5) AS completeness, round(balance + 1e-9, 5) AS balance, round(density + 1e-9, 5) AS density, round(boundary + 1e-9, 5) AS boundary, round(overall + 1e-9, 5) AS overall,
  list_filter([CASE WHEN completeness < 0.7 THEN '{Q.ADVICE["completeness"]}' END, CASE WHEN balance < 0.6 AND spread > 3 THEN '{Q.ADVICE["balance"]}' END, CASE WHEN density < 0.4 THEN '{Q.ADVICE["density"]}' END,
   CASE WHEN boundary < 0.6 THEN '{Q.ADVICE["boundary"]}' END, CASE WHEN overall < 0.5 THEN '{Q.ADVICE["poor"]}' WHEN overall > 0.8 THEN '{Q.ADVICE["good"]}' END], lambda x: x IS NOT NULL) AS suggestions FROM o""")
def quality_evaluation(spark, sf):
    """All measures of the size-packed chunks, with one coherence for all."""
    e = Q.evaluate(_chunks(spark, sf).withColumn("coherence_score", F.lit(0.75)))
    short = {"avg_completeness": "completeness", "length_balance": "balance", "avg_semantic_density": "density", "boundary_quality": "boundary", "overall_score": "overall"}
    return e.select("doc_id", "n_chunks", *[F.round(F.col(k) + 1e-9, 5).alias(v) for k, v in short.items()], "suggestions")


_INNER = f"""
qs AS (SELECT doc_id, chunk_id, list_filter(list_transform(regexp_split_to_array(content, '[。！？；]'), lambda x: {_sql_strip('x')}), lambda x: length(x) > 5) AS s FROM (SELECT doc_id, chunk_id, INPUT AS content FROM ch)),
qe AS (SELECT doc_id, chunk_id, unnest(s) AS t, generate_subscripts(s, 1) AS k FROM qs), qf AS (SELECT doc_id, chunk_id, k, {_F13} AS v FROM qe),
qn AS (SELECT doc_id, chunk_id, k, v AS a, lead(v) OVER (PARTITION BY doc_id, chunk_id ORDER BY k) AS b FROM qf),
qd AS (SELECT doc_id, chunk_id, list_sum(list_transform(list_zip({V.REPEATS}, a, b), lambda x: x[1] * x[2] * x[3])) AS ab, list_sum(list_transform(list_zip({V.REPEATS}, a), lambda x: x[1] * x[2] * x[2])) AS aa, list_sum(list_transform(list_zip({V.REPEATS}, b), lambda x: x[1] * x[2] * x[2])) AS bb FROM qn WHERE b IS NOT NULL),
inner_c AS (SELECT c.doc_id, c.chunk_id, coalesce(avg(CASE WHEN aa * bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0 END) FILTER (qd.doc_id IS NOT NULL), 1.0) AS coherence FROM ch c LEFT JOIN qd ON qd.doc_id = c.doc_id AND qd.chunk_id = c.chunk_id GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_PACK}, {_INNER.replace('INPUT', "replace(content, '.', '。')")} SELECT doc_id, chunk_id, round(coherence, 6) AS coherence FROM inner_c")
def inner_coherence(spark, sf):
    text = F.regexp_replace("content", "[.]", "。")
    return _chunks(spark, sf).select("doc_id", "chunk_id", F.round(Q.inner_coherence(text), 6).alias("coherence"))


_R = Q.REPORT_LINES


@query(f"""WITH RECURSIVE {_PACK}, {_EDGES}, {_INNER.replace('INPUT', 'content')}, w AS (SELECT doc_id, chunk_id, content, list_transform(list_filter(list_transform(string_split_regex(content, '[。！？；]'), lambda x: {_sql_strip('x')}), lambda x: length(x) > 5), lambda x: len({_sql_words('x')})) AS s FROM ch),
m AS (SELECT doc_id, count(*) AS n, avg({_SQL_COMPLETE}) AS completeness, avg({_SQL_DENSITY}) AS density, max(length(content))::DOUBLE / (min(length(content)) + 1) AS spread, avg(length(content)) AS mean, min(length(content)) AS low, max(length(content)) AS high,
  CASE WHEN count(*) < 2 THEN 1.0 WHEN avg(length(content)) = 0 THEN 0.0 ELSE greatest(0.0, 1 - stddev_pop(length(content)) / avg(length(content))) END AS balance FROM w GROUP BY doc_id),
b AS (SELECT m.*, coalesce(e.b, 1.0) AS boundary, i.coherence FROM m LEFT JOIN (SELECT doc_id, avg(score) AS b FROM edges GROUP BY 1) e USING (doc_id) JOIN (SELECT doc_id, avg(least(1.0, greatest(0.0, coherence))) AS coherence FROM inner_c GROUP BY 1) i USING (doc_id)),
o AS (SELECT *, 0.3::DOUBLE * coherence + 0.25::DOUBLE * completeness + 0.15::DOUBLE * balance + 0.15::DOUBLE * density + 0.15::DOUBLE * boundary AS overall FROM b),
a AS (SELECT *, list_filter([CASE WHEN coherence < 0.6 THEN '{Q.ADVICE["coherence"]}' END, CASE WHEN completeness < 0.7 THEN '{Q.ADVICE["completeness"]}' END, CASE WHEN balance < 0.6 AND spread > 3 THEN '{Q.ADVICE["balance"]}' END, CASE WHEN density < 0.4 THEN '{Q.ADVICE["density"]}' END,
   CASE WHEN boundary < 0.6 THEN '{Q.ADVICE["boundary"]}' END, CASE WHEN overall < 0.5 THEN '{Q.ADVICE["poor"]}' WHEN overall > 0.8 THEN '{Q.ADVICE["good"]}' END], lambda x: x IS NOT NULL) AS said FROM o)
SELECT doc_id, array_to_string([repeat('=', 50), '{_R["title"]}', repeat('=', 50), printf('{_R["count"]}', n), printf('{_R["mean"]}', mean + 1e-6), printf('{_R["range"]}', low, high), '', '{_R["measures"]}',
  {", ".join(f"printf('  {name}: %.3f', round({c}, 6) + 1e-7)" for c, name in zip(("coherence", "completeness", "balance", "density", "boundary", "overall"), Q.REPORT.values()))}, '',
  CASE WHEN len(said) > 0 THEN '{_R["advice"]}' || chr(10) || array_to_string(list_transform(said, lambda x, i: '  ' || i || '. ' || x), chr(10)) ELSE '{_R["none"]}' END, '', repeat('=', 50)], chr(10)) AS report FROM a""")
def quality_report(spark, sf):
    """Figures a little above ties of rounding."""
    e = Q.evaluate(_chunks(spark, sf).withColumn("coherence_score", Q.inner_coherence(F.col("content"))))
    return Q.report(e.withColumn("avg_length", F.col("avg_length") + 1e-6).withColumns({c: F.round(c, 6) + 1e-7 for c in Q.REPORT}))


@query(f"""WITH RECURSIVE {_PACK}, t AS (SELECT length(content) AS n, trunc(len({_sql_words('content')}) / 0.75::DOUBLE)::INT AS k FROM ch)
SELECT count(*) AS total_chunks, round(avg(n), 6) AS avg_length, min(n)::INT AS min_length, max(n)::INT AS max_length, round(stddev_pop(n), 6) AS std_length, round(avg(k), 6) AS avg_tokens,
 count(*) FILTER (n < 500) AS lt_500, count(*) FILTER (n >= 500 AND n < 1000) AS lt_1000, count(*) FILTER (n >= 1000 AND n < 1500) AS lt_1500, count(*) FILTER (n >= 1500) AS ge_1500 FROM t""")
def chunking_statistics(spark, sf):
    s = Q.statistics(C.positions(_chunks(spark, sf), "en"))
    return s.select(*[F.round(c, 6).alias(c) if c.startswith(("avg", "std")) else c for c in s.columns])


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: length(w) > 1 AND NOT list_contains({P.STOP_EN}, w)) AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS phrase, generate_subscripts(ws, 1) AS pos FROM w), c AS (SELECT doc_id, phrase, count(*) AS n, min(pos) AS first FROM u GROUP BY 1, 2)
SELECT doc_id, phrase, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INT AS rank FROM c QUALIFY rank <= 10""")
def key_phrases(spark, sf):
    return P.key_phrases(_docs(spark, sf))


def _talks(spark, sf):
    """Conversations as markdown: a heading per role, the turn, and an image after each third turn."""
    t = _table(spark, sf, "conversations")
    image = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("\n\n![turn "), F.col("turn").cast("string"), F.lit("](http://img.example.com/"), F.col("turn").cast("string"), F.lit(".png)"))).otherwise(F.lit(""))
    part = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text", image)
    packed = t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("x"))
    return packed.select("doc_id", F.array_join(F.transform("x", lambda x: x["part"]), "\n\n").alias("markdown"))


_TALKS = """SELECT conv_id AS doc_id, string_agg('## ' || role || chr(10) || chr(10) || text || CASE WHEN turn % 3 = 2 THEN chr(10) || chr(10) || '![turn ' || turn || '](http://img.example.com/' || turn || '.png)' ELSE '' END, chr(10) || chr(10) ORDER BY turn, text) AS markdown FROM conversations GROUP BY conv_id"""


_PARAS = rf"""
mb AS (SELECT doc_id, unnest(regexp_split_to_array(markdown, '\n\s*\n')) AS c, generate_subscripts(regexp_split_to_array(markdown, '\n\s*\n'), 1) AS k, markdown FROM ({_TALKS})),
mt AS (SELECT doc_id, k, {_sql_strip('c')} AS c, len(list_filter(string_split(c, chr(10)), lambda x: trim(x) <> '')) > 1 AND contains(c, '---') AND contains(c, '|') AS tab FROM mb WHERE {_sql_strip('c')} <> ''),
ml AS (SELECT doc_id, k, list_filter(list_transform(string_split(c, chr(10)), lambda x: {_sql_strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^!\[([^\]]*)\]\(([^)]+)\)$')) AS ls FROM mt WHERE NOT tab),
mp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS index, len(ls) = 1 AND regexp_matches(ls[1], '^(#{{1,6}})\s+(.*)$') AS head, ls FROM ml WHERE len(ls) > 0),
paras AS (SELECT doc_id, index, head, CASE WHEN head THEN length(regexp_extract(ls[1], '^(#{{1,6}})', 1)) END AS level, CASE WHEN head THEN regexp_extract(ls[1], '^(#{{1,6}})\s+(.*)$', 2) ELSE array_to_string(ls, chr(10)) END AS content FROM mp)"""


@query(rf"""
WITH i AS (SELECT doc_id, unnest(regexp_extract_all(markdown, '!\[([^\]]*)\]\(([^)]+)\)', 2)) AS url FROM ({_TALKS})), d AS (SELECT doc_id FROM ({_TALKS}))
SELECT doc_id, url, regexp_extract(url, '([^/]+)$', 1) AS filename, 'inline' AS source FROM i
UNION ALL SELECT doc_id, url, regexp_extract(url, '([^/]+)$', 1), 'remote' FROM (SELECT doc_id, unnest(['http://img.example.com/2.png', 'http://img.example.com/cover.jpg']) AS url FROM d) r WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = r.doc_id AND i.url = r.url)""")
def markdown_images_merge(spark, sf):
    docs = _talks(spark, sf)
    remote = docs.select("doc_id", F.explode(F.array(F.lit("http://img.example.com/2.png"), F.lit("http://img.example.com/cover.jpg"))).alias("url"))
    return M.all_images(docs, remote)


@query(rf"""WITH {_PARAS}, p AS (SELECT doc_id, count(*) FILTER (NOT head) AS paragraph_count, count(*) FILTER (head) AS heading_count FROM paras GROUP BY 1),
t AS (SELECT doc_id, count(*) AS table_count FROM mt WHERE tab GROUP BY 1)
SELECT d.doc_id, coalesce(paragraph_count, 0) AS paragraph_count, coalesce(heading_count, 0) AS heading_count, coalesce(table_count, 0) AS table_count, len(regexp_extract_all(d.markdown, '!\[([^\]]*)\]\(([^)]+)\)'))::BIGINT AS image_count
FROM ({_TALKS}) d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""")
def document_structure(spark, sf):
    return M.structure(_talks(spark, sf))


@query(f"""WITH {_PARAS}, s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY index) AS section FROM paras)
SELECT doc_id, max(content) FILTER (head) AS title, max(level) FILTER (head) AS level, min(index) AS start_index, list(index ORDER BY index) FILTER (NOT head) AS paragraphs
FROM s WHERE section > 0 GROUP BY doc_id, section HAVING count(*) FILTER (NOT head) > 0""")
def document_sections(spark, sf):
    return M.sections(M.paragraphs(_talks(spark, sf)))


_STREAM = rf"""
eb AS (SELECT doc_id, unnest(regexp_split_to_array(markdown, '\n\s*\n')) AS c, generate_subscripts(regexp_split_to_array(markdown, '\n\s*\n'), 1) AS k FROM ({_TALKS})),
el AS (SELECT doc_id, k, unnest(string_split(c, chr(10))) AS x, generate_subscripts(string_split(c, chr(10)), 1) AS l FROM eb),
en AS (SELECT doc_id, k, l, {_sql_strip('x')} AS x, regexp_matches({_sql_strip('x')}, '^!\[([^\]]*)\]\(([^)]+)\)$') AS image FROM el WHERE {_sql_strip('x')} <> ''),
er AS (SELECT *, sum(image::INT) OVER (PARTITION BY doc_id, k ORDER BY l) AS run FROM en),
eg AS (SELECT doc_id, k, min(l) AS l, image, string_agg(x, chr(10) ORDER BY l) AS raw FROM er GROUP BY doc_id, k, run, image),
ep AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, l) - 1)::INT AS pos, image, raw, NOT image AND NOT contains(raw, chr(10)) AND regexp_matches(raw, '^(#{{1,6}})\s+(.*)$') AS head FROM eg),
ec AS (SELECT *, CASE WHEN head THEN regexp_extract(raw, '^(#{{1,6}})\s+(.*)$', 2) ELSE raw END AS bare FROM ep)"""


@query(rf"""WITH {_STREAM},
cl AS (SELECT *, CASE WHEN image THEN raw ELSE {_sql_clean_en('bare')} END AS text FROM ec),
ok AS (SELECT * FROM cl WHERE image OR (length(bare) >= 10 AND text <> ''))
SELECT doc_id, (row_number() OVER w - 1)::INT AS pos, CASE WHEN image THEN 'image' ELSE 'paragraph' END AS kind, head AS heading, text AS content,
 CASE WHEN image THEN '[IMAGE_PLACEHOLDER_' || (sum(image::INT) OVER w - 1) || ']' ELSE text END AS embed_text FROM ok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def markdown_elements(spark, sf):
    return M.elements(_talks(spark, sf), language="en")


@query(f"""WITH {_PARAS}, k AS (SELECT doc_id, index, content, {_sql_flat("CASE WHEN contains(content, chr(10)) THEN content ELSE regexp_replace(content, '^#{1,6}[ ]+', '') END")} AS key FROM paras),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY index) AS nth FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY index) AS nth FROM k WHERE index % 5 <> 4)
SELECT a.doc_id, a.index AS pos, a.content, coalesce(b.index, -1) AS matched FROM a LEFT JOIN b USING (doc_id, key, nth)""")
def paragraph_matching(spark, sf):
    there = M.paragraphs(_talks(spark, sf))
    return M.matched(there.select("doc_id", F.col("index").alias("pos"), "content"), there.select("doc_id", "index", "content").filter("index % 5 <> 4"))


def _parts(spark, sf):
    """Conversations and what a parser might give for them: four of five paragraphs, an appendix, a table, images."""
    docs = _talks(spark, sf)
    more = docs.select("doc_id", F.lit(1000).alias("index"), F.lit("paragraph").alias("type"), F.lit("An appendix that the text lacks.").alias("content"))
    paras = M.paragraphs(docs).select("doc_id", "index", "type", "content").filter("index % 5 <> 4").unionByName(more)
    tabs = docs.select("doc_id", F.lit(0).alias("index"), F.lit("| a | b |").alias("content"))
    found = M.all_images(docs, docs.select("doc_id", F.lit("http://img.example.com/cover.jpg").alias("url")))
    order = Window.partitionBy("doc_id").orderBy("source", "url")
    images = found.select("doc_id", "url", "filename", "source").withColumn("index", F.row_number().over(order) - 1).filter("filename <> '5.png'")
    return docs, paras, tabs, images


@query(rf"""WITH {_PARAS}, {_STREAM},
gp AS (SELECT doc_id, index, head, content FROM paras WHERE index % 5 <> 4 UNION ALL SELECT doc_id, 1000, false, 'An appendix that the text lacks.' FROM ({_TALKS})),
ki AS (SELECT doc_id, pos, bare, head, {_sql_flat("CASE WHEN contains(bare, chr(10)) THEN bare ELSE regexp_replace(bare, '^#{1,6}[ ]+', '') END")} AS key FROM ec WHERE NOT image),
kg AS (SELECT *, {_sql_flat("CASE WHEN contains(content, chr(10)) THEN content ELSE regexp_replace(content, '^#{1,6}[ ]+', '') END")} AS key FROM gp),
na AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM ki), nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY index) AS nth FROM kg),
iu AS (SELECT doc_id, regexp_extract(raw, '^!\[([^\]]*)\]\(([^)]+)\)$', 2) AS url, regexp_extract(raw, '^!\[([^\]]*)\]', 1) AS alt, pos FROM ec WHERE image),
ig AS (SELECT doc_id, url, regexp_extract(url, '([^/]+)$', 1) AS filename, row_number() OVER (PARTITION BY doc_id ORDER BY src, url) - 1 AS index FROM (SELECT doc_id, url, 'inline' AS src FROM iu UNION ALL SELECT doc_id, 'http://img.example.com/cover.jpg', 'remote' FROM ({_TALKS}))),
ih AS (SELECT * FROM ig WHERE filename <> '5.png'),
ia AS (SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY pos) AS nth FROM iu), ib AS (SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY index) AS nth FROM ih),
alls AS (SELECT na.doc_id, 0 AS tier, na.pos::BIGINT AS at_pos, 'paragraph' AS kind, coalesce(nb.head, na.head) AS heading, coalesce(nb.content, na.bare) AS content, NULL AS url, nb.index::BIGINT AS source FROM na LEFT JOIN nb USING (doc_id, key, nth)
 UNION ALL SELECT nb.doc_id, 1, nb.index, 'paragraph', nb.head, nb.content, NULL, nb.index FROM nb LEFT JOIN na USING (doc_id, key, nth) WHERE na.pos IS NULL
 UNION ALL SELECT doc_id, 2, 0, 'table', false, '| a | b |', NULL, 0 FROM ({_TALKS})
 UNION ALL SELECT ia.doc_id, 0, ia.pos, 'image', false, coalesce(ib.filename, ia.alt), coalesce(ib.url, ia.url), ib.index FROM ia LEFT JOIN ib USING (doc_id, url, nth)
 UNION ALL SELECT ib.doc_id, 3, ib.index, 'image', false, ib.filename, ib.url, ib.index FROM ib LEFT JOIN ia USING (doc_id, url, nth) WHERE ia.pos IS NULL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY tier, at_pos) - 1)::INT AS pos, kind, heading, content, url, source FROM alls""")
def assembled_elements(spark, sf):
    return M.assembled(*_parts(spark, sf))


@query()
def greedy_chunks_semantic(spark, sf):
    return C.chunk_documents(_docs(spark, sf), SIZES.with_(semantic_threshold=0.9), "greedy", separator="\n").drop("metadata")


@query()
def greedy_chunks_enhanced(spark, sf):
    return C.chunk_documents(_docs(spark, sf), SIZES, "greedy_enhanced", separator="\n").drop("metadata")


@query()
def boundary_chunks(spark, sf):
    return C.chunk_documents(_docs(spark, sf), SIZES, "boundary", separator="\n").drop("metadata")


@query()
def markdown_chunks(spark, sf):
    return C.chunk_documents(M.as_documents(M.elements(_talks(spark, sf), language="en")), SIZES).drop("metadata")


@query()
def chunk_summary(spark, sf):
    return Q.summary(C.chunk_documents(_docs(spark, sf), SIZES, "greedy", separator="\n"))


@query(f"""WITH RECURSIVE e AS ({_VEC}), g AS (SELECT doc_id, pos, 0 AS chunk_id, 40 AS size, 1 AS n, e AS total FROM e WHERE pos = 0
  UNION ALL SELECT doc_id, pos, CASE WHEN cut THEN chunk_id + 1 ELSE chunk_id END, CASE WHEN cut THEN add ELSE size + add END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN e ELSE list_transform(list_zip(total, e), lambda x: x[1] + x[2]) END
  FROM (SELECT e.doc_id, e.pos, g.chunk_id, g.size, g.n, g.total, e.e, (40 + (e.pos % 3) * 30)::INT AS add, g.size + 40 + (e.pos % 3) * 30 > 400 OR (g.size >= 200 AND list_dot_product(g.total, e.e) / g.n < 0.1) AS cut FROM g JOIN e ON e.doc_id = g.doc_id AND e.pos = g.pos + 1))
SELECT doc_id, pos, chunk_id FROM g""")
def greedy_assignment(spark, sf):
    v = _vectors(spark, sf).withColumn("size", (F.lit(40) + (F.col("pos") % 3) * 30).cast("int"))
    return C.assign_chunks(v, ChunkConfig(5, 400, 200, 0.0, 0.1))


@query(f"""WITH RECURSIVE
p AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (SELECT doc_id, pos, {_sql_flat('content')} AS content FROM ({_LINES})) WHERE content <> ''),
g AS (SELECT doc_id, k, 0 AS chunk_id, length(content) + 2 AS size FROM p WHERE k = 1
      UNION ALL SELECT p.doc_id, p.k, CASE WHEN g.size + length(p.content) > 800 THEN g.chunk_id + 1 ELSE g.chunk_id END, CASE WHEN g.size + length(p.content) > 800 THEN 0 ELSE g.size END + length(p.content) + 2 FROM g JOIN p ON p.doc_id = g.doc_id AND p.k = g.k + 1)
SELECT g.doc_id, g.chunk_id, string_agg(p.content, chr(10) || chr(10) ORDER BY g.k) AS content, count(*)::INT AS n_parts FROM g JOIN p USING (doc_id, k) GROUP BY g.doc_id, g.chunk_id""")
def fallback_packing(spark, sf):
    return C.fallback_chunks(_docs(spark, sf), SIZES, "\n")


@query(rf"""WITH RECURSIVE b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1) AS block, c FROM (SELECT doc_id, k, {_sql_strip('c')} AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS c, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS k FROM documents)) WHERE c <> ''),
s AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY k) AS k, x FROM (SELECT doc_id, block, k, {_sql_strip('x')} AS x FROM (SELECT doc_id, block, unnest(regexp_split_to_array(c, '[。！？.!?]')) AS x, generate_subscripts(regexp_split_to_array(c, '[。！？.!?]'), 1) AS k FROM b WHERE length(c) > 800)) WHERE x <> ''),
g AS (SELECT doc_id, block, k, 0 AS grp, length(x) + 1 AS size FROM s WHERE k = 1
      UNION ALL SELECT s.doc_id, s.block, s.k, CASE WHEN g.size + length(x) >= 720 THEN grp + 1 ELSE grp END, CASE WHEN g.size + length(x) >= 720 THEN 0 ELSE g.size END + length(x) + 1 FROM g JOIN s ON s.doc_id = g.doc_id AND s.block = g.block AND s.k = g.k + 1),
u AS (SELECT doc_id, block, 0 AS grp, c AS content FROM b WHERE length(c) <= 800 UNION ALL SELECT doc_id, block, grp, string_agg(x || '。', '' ORDER BY k) FROM g JOIN s USING (doc_id, block, k) GROUP BY 1, 2, 3)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block, grp) - 1)::INT AS pos, content FROM u""")
def long_paragraph_repack(spark, sf):
    return C.repacked_paragraphs(_docs(spark, sf), SIZES)


@query(f"WITH RECURSIVE {_PACK} SELECT doc_id, chunk_id, content, n_parts FROM ch")
def save_load_roundtrip(spark, sf):
    """What is written is what is read back."""
    from quernstone.sources.sinks import load_chunks, save_parquet, scratch

    path = scratch(spark, "chunks")
    save_parquet(_chunks(spark, sf), path)
    return load_chunks(spark, path)


from quernstone.plans import fold_queries  # noqa: E402, F401  (adds its own)
