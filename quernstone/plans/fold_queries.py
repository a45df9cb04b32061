"""Queries of the steps that carry state along a document, with recursive SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.config import ChunkConfig
from quernstone.functions import text as T
from quernstone.operators import boundaries as B
from quernstone.operators import chunks as C
from quernstone.operators import markdown as M
from quernstone.operators import quality as Q
from quernstone.plans.pipeline import processing_statistics as run_statistics
from quernstone.plans.queries import _LINES, _WS, _docs, _fixed, _lines, _sql_flat, _sql_strip, _vectors, query

#: Sizes for packing short elements, and for steps over chunks.
PACK = ChunkConfig(min_chunk_size=150, max_chunk_size=700, target_chunk_size=300, overlap_ratio=0.3, semantic_threshold=0.1, language="en")
STEP = ChunkConfig(min_chunk_size=60, max_chunk_size=500, target_chunk_size=300, overlap_ratio=0.1, language="en")

#: Texts of the twenty vectors of a pseudo-document: some end a sentence, some are short titles or list items.
_CONTENT = """CASE WHEN pos % 9 = 8 THEN 'Part ' || pos WHEN pos % 7 = 5 THEN '- item ' || repeat('of a list ', (10 + pos % 4)::INT) || 'end.' ELSE 'Text ' || repeat('runs on ', (7 + (pos * 7) % 11)::INT) || CASE WHEN pos % 3 = 0 THEN 'halts' ELSE 'ends.' END END"""
_SQL_ELEMENTS = f"SELECT doc_id, pos, e, {_CONTENT} AS t, pos % 9 = 8 AS heading FROM (SELECT vec_id // 20 AS doc_id, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS pos, embedding::DOUBLE[] AS e FROM embeddings)"


def _elements(spark, sf):
    return _vectors(spark, sf).withColumns({"content": F.expr(_CONTENT.replace("::INT", "")), "heading": F.col("pos") % 9 == 8})


def _shared(count: str) -> str:
    """How many of ``count`` elements the next chunk takes over."""
    return f"least(greatest(1, floor(({count}) * {PACK.overlap_ratio}::DOUBLE)::INT), ({count}) - 1)"


#: Elements el with lengths summed up to each (total), and sims: cosines with all before, in order.
_MEASURED = f"""
el AS MATERIALIZED (SELECT *, length(t) AS n, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM ({_SQL_ELEMENTS})),
pairs AS MATERIALIZED (SELECT a.doc_id, a.pos AS i, b.pos AS j, list_cosine_similarity(a.e, b.e) AS sim FROM el a JOIN el b ON a.doc_id = b.doc_id AND a.pos < b.pos),
ms AS MATERIALIZED (SELECT el.doc_id, el.pos, el.n, el.total, el.heading, coalesce(s.sims, []) AS sims FROM el LEFT JOIN (SELECT doc_id, j AS pos, list(sim ORDER BY i) AS sims FROM pairs GROUP BY 1, 2) s USING (doc_id, pos))"""

#: Mean of pairs in each range (first, last).
_SCORED = """SELECT r.doc_id, r.chunk_id, r.first, r.last, round(coalesce(avg(p.sim), 1.0), 6) AS score FROM r LEFT JOIN pairs p ON p.doc_id = r.doc_id AND p.i >= r.first AND p.j <= r.last GROUP BY ALL"""


def _greedy_sql(measure: str) -> str:
    """``measure``: SQL over x, the cosines of the new element with those held, oldest first."""
    cut = f"(g.size >= {PACK.min_chunk_size} AND m.heading) OR g.size + m.n > {PACK.max_chunk_size} OR (g.size >= {PACK.target_chunk_size} AND ({measure}) < {PACK.semantic_threshold}::DOUBLE)"
    return f"""WITH RECURSIVE {_MEASURED},
g AS (SELECT doc_id, pos, 0 AS chunk_id, 0::BIGINT AS first, n::HUGEINT AS size FROM ms WHERE pos = 0
  UNION ALL SELECT doc_id, pos, CASE WHEN cut THEN chunk_id + 1 ELSE chunk_id END, CASE WHEN cut THEN pos - {_shared('pos - first')} ELSE first END, CASE WHEN cut THEN n + before - coalesce(list_extract(totals, pos - {_shared('pos - first')}), 0) ELSE size + n END
  FROM (SELECT m.doc_id, m.pos, g.chunk_id, g.first, g.size, m.n, m.total - m.n AS before, a.totals, {cut} AS cut
        FROM (SELECT ms.*, ms.sims AS s FROM ms) m JOIN g ON m.doc_id = g.doc_id AND m.pos = g.pos + 1 JOIN (SELECT doc_id, list(total ORDER BY pos) AS totals FROM el GROUP BY 1) a ON a.doc_id = m.doc_id)),
r AS (SELECT doc_id, chunk_id, min(first)::INT AS first, max(pos)::INT AS last FROM g GROUP BY 1, 2)
{_SCORED}"""


_X = "m.s[g.first + 1 : m.pos]"


def _ranges(spark, sf, mode):
    return C.chunk_ranges(_elements(spark, sf), PACK, mode).withColumn("score", F.round("score", 6))


@query(_greedy_sql(f"list_avg({_X})"))
def greedy_ranges(spark, sf):
    return _ranges(spark, sf, "greedy")


def _weighted(x: str) -> str:
    mean = f"list_sum(list_transform({x}, lambda c, k: c * exp(-0.5::DOUBLE * (len({x}) - k)))) / list_sum(list_transform({x}, lambda c, k: exp(-0.5::DOUBLE * (len({x}) - k))))"
    bends = f"list_avg(list_transform(list_zip({x}[1 : len({x}) - 2], {x}[2 : len({x}) - 1], {x}[3 : len({x})]), lambda c: abs(c[3] - 2 * c[2] + c[1])))"
    jump = f"abs({x}[len({x})] - list_avg({x}[1 : len({x}) - 1]))"
    trend = f"CASE WHEN len({x}) >= 3 THEN -0.1::DOUBLE * ({bends} + least(0.15::DOUBLE, 0.2::DOUBLE * {jump})) ELSE 0 END"
    spread = f"CASE WHEN list_avg({x}) > 0 THEN greatest(0.0, 1 - list_stddev_pop({x}) / list_avg({x})) ELSE 0 END"
    low, high = (f"list_aggregate({x}, 'quantile_cont', {q})" for q in (0.25, 0.75))
    even = f"CASE WHEN len({x}) < 2 THEN 1.0 ELSE {spread} * CASE WHEN len({x}) > 3 AND {x}[len({x})] > {high} + 1.5 * ({high} - {low}) THEN 0.8::DOUBLE ELSE 1 END END"
    return f"least(1.0, greatest(0.0, {mean} + {trend} + least(0.1::DOUBLE, 0.1::DOUBLE * {x}[len({x})]) + 0.1::DOUBLE * ({even})))"


@query(_greedy_sql(_weighted(_X)))
def greedy_ranges_enhanced(spark, sf):
    return _ranges(spark, sf, "greedy_enhanced")


_TITLE = r"regexp_matches(c, '^第[一二三四五六七八九十\d]+[章节部分]') OR regexp_matches(c, '^\d+[\.\s]+[^\n]{1,50}$') OR regexp_matches(c, '^[一二三四五六七八九十]+[\.\s、]+[^\n]{1,50}$') OR (length(c) < 50 AND NOT regexp_matches(c, '[。.！!？?]$'))"


@query(f"""WITH RECURSIVE {_MEASURED},
near AS (SELECT doc_id, i AS pos, sim FROM pairs WHERE j = i + 1), ch AS (SELECT doc_id, pos, abs(sim - lag(sim) OVER (PARTITION BY doc_id ORDER BY pos)) AS c FROM near),
cl AS (SELECT doc_id, avg(c) + stddev_pop(c) AS least FROM ch GROUP BY 1),
tx AS (SELECT doc_id, pos, t, {_sql_strip('t')} AS c, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM el),
marks AS MATERIALIZED (SELECT doc_id, 0::BIGINT AS at_pos FROM el WHERE pos = 0
  UNION SELECT ch.doc_id, ch.pos FROM ch JOIN cl USING (doc_id) JOIN tx ON tx.doc_id = ch.doc_id AND tx.pos = ch.pos WHERE ch.c > cl.least AND (tx.b = '' OR regexp_matches(tx.b, '[。.！!？?；;]$'))
  UNION SELECT doc_id, pos FROM tx WHERE {_TITLE} OR regexp_matches(c, '^(\\d+[\\.\\)]|[•·▪▫]|[-*+])') OR (pos > 0 AND (length(c)::DOUBLE / greatest(1, length(b)) > 3 OR length(c)::DOUBLE / greatest(1, length(b)) < 0.3 OR (length(b) - length(replace(b, '。', '')) > 2 AND NOT contains(c, '。'))))),
sp AS (SELECT doc_id, at_pos FROM marks WHERE at_pos = 0 UNION ALL SELECT sp.doc_id, (SELECT min(marks.at_pos) FROM marks WHERE marks.doc_id = sp.doc_id AND marks.at_pos >= sp.at_pos + 2) FROM sp WHERE sp.at_pos IS NOT NULL),
st AS MATERIALIZED (SELECT doc_id, at_pos AS a, coalesce(lead(at_pos) OVER (PARTITION BY doc_id ORDER BY at_pos), (SELECT count(*) FROM el WHERE el.doc_id = sp.doc_id)) AS b FROM sp WHERE at_pos IS NOT NULL),
sz AS MATERIALIZED (SELECT st.doc_id, a, b, sum(n) AS size FROM st JOIN el ON el.doc_id = st.doc_id AND pos >= a AND pos < b GROUP BY 1, 2, 3),
pk AS (SELECT sz.doc_id, a, b, a AS pos, 0 AS k, a AS first, el.n::HUGEINT AS size FROM sz JOIN el ON el.doc_id = sz.doc_id AND el.pos = sz.a WHERE sz.size > {PACK.max_chunk_size}
  UNION ALL SELECT doc_id, a, b, pos, CASE WHEN cut THEN k + 1 ELSE k END, CASE WHEN cut THEN pos - taken ELSE first END, CASE WHEN cut THEN n + (SELECT coalesce(sum(x.n), 0) FROM el x WHERE x.doc_id = q.doc_id AND x.pos >= q.pos - q.taken AND x.pos < q.pos) ELSE size + n END
  FROM (SELECT pk.doc_id, a, b, el.pos, k, first, size, el.n, size + el.n > {PACK.target_chunk_size} AS cut, CASE WHEN el.pos - first > 1 THEN {_shared('el.pos - first')} ELSE 0 END AS taken FROM pk JOIN el ON el.doc_id = pk.doc_id AND el.pos = pk.pos + 1 AND el.pos < b) q),
u AS (SELECT doc_id, a, 0 AS k, a AS first, b - 1 AS last FROM sz WHERE size <= {PACK.max_chunk_size} UNION ALL SELECT doc_id, a, k, min(first), max(pos) FROM pk GROUP BY 1, 2, 3),
r AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, k) - 1)::INT AS chunk_id, first::INT AS first, last::INT AS last FROM u)
{_SCORED}""")
def boundary_ranges(spark, sf):
    return _ranges(spark, sf, "boundary")


def _line_chunks(spark, sf):
    kept = _lines(spark, sf).withColumn("content", T.collapse(F.col("content"))).filter(F.length("content") >= 5)
    return kept.withColumn("chunk_id", (F.row_number().over(B.order()) - 1).cast("int"))


_LINE_CHUNKS = f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS k, content AS c FROM (SELECT doc_id, pos, {_sql_flat('content')} AS content FROM ({_LINES})) WHERE length(content) >= 5"


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_LINE_CHUNKS}),
g AS (SELECT doc_id, k, 0 AS chunk_id, CASE WHEN length(c) < {STEP.min_chunk_size} THEN length(c) END AS held FROM p WHERE k = 0
  UNION ALL SELECT doc_id, k, CASE WHEN joins THEN chunk_id ELSE chunk_id + 1 END, CASE WHEN n < {STEP.min_chunk_size} THEN CASE WHEN joins THEN held + 2 + n ELSE n END END
  FROM (SELECT p.doc_id, p.k, g.chunk_id, g.held, length(c) AS n, g.held IS NOT NULL AND g.held + length(c) <= {STEP.max_chunk_size} AND (length(c) < {STEP.min_chunk_size} OR g.held < {STEP.target_chunk_size}) AS joins FROM g JOIN p ON p.doc_id = g.doc_id AND p.k = g.k + 1))
SELECT doc_id, chunk_id, string_agg(c, chr(10) || chr(10) ORDER BY k) AS content, list(k ORDER BY k) AS sources, count(*) > 1 AS refresh FROM g JOIN p USING (doc_id, k) GROUP BY 1, 2""")
def merge_small_chunks(spark, sf):
    return C.optimised(_line_chunks(spark, sf), STEP, "merge").drop("start_pos", "end_pos")


_SHARED = int(STEP.target_chunk_size * STEP.overlap_ratio)



def _windows_sql(source: str) -> str:
    """w (id, a, z): the windows of ``source`` (id, text) that end at white space near the target, as SQL of a recursive step."""
    return rf"""w AS (SELECT id, 0 AS a, 0 AS z, length(text) AS n, false AS there FROM {source}
  UNION ALL SELECT id, nexts AS a, CASE WHEN e0 >= n THEN n WHEN after < length(ahead) THEN e0 + after WHEN before < length(behind) THEN e0 - before ELSE e0 END, n, true
  FROM (SELECT *, length(regexp_extract(ahead, '^[^ \n\t]*')) AS after, length(regexp_extract(behind, '[^ \n\t]*$')) AS before
    FROM (SELECT *, substring(text, e0 + 1, least(50, n - e0)) AS ahead, substring(text, greatest(e0 - 50, nexts) + 2, e0 - greatest(e0 - 50, nexts)) AS behind
      FROM (SELECT w.id, d.text, w.n, nexts, least(nexts + {STEP.target_chunk_size}, w.n) AS e0 FROM (SELECT *, CASE WHEN there THEN greatest(a + 1, z - {_SHARED}) ELSE 0 END AS nexts FROM w WHERE NOT there OR z < n) w JOIN {source} d USING (id) WHERE nexts < w.n))))"""


@query(f"""WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents), {_windows_sql('src')}
SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY a) - 1)::INT AS chunk_id, content, a::INT AS start_pos, z::INT AS end_pos FROM (SELECT id, a, z, {_sql_strip('substring(text, a + 1, z - a)')} AS content FROM w JOIN src USING (id) WHERE there) WHERE content <> ''""")
def force_split_chunks(spark, sf):
    whole = _docs(spark, sf).select("doc_id", F.lit(0).alias("chunk_id"), F.col("text").alias("content"))
    return C.optimised(whole, STEP, "force_split").select("doc_id", "chunk_id", "content", "start_pos", "end_pos")


_KEPT = f"CASE WHEN k - first > 1 THEN greatest(1, floor((k - first) * {STEP.overlap_ratio}::DOUBLE)::INT) ELSE 0 END"


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_fixed(900)}),
ss AS MATERIALIZED (SELECT doc_id, chunk_id, list_filter(list_transform(regexp_split_to_array(content, '[.!?;]'), lambda x: {_sql_strip('x')}), lambda x: x <> '') AS s, content FROM p WHERE length(content) > {STEP.max_chunk_size}),
src AS MATERIALIZED (SELECT doc_id * 100000 + chunk_id AS id, content AS text FROM ss WHERE len(s) < 2), {_windows_sql('src')},
g AS (SELECT doc_id, chunk_id, 1 AS k, 0 AS grp, 1 AS first, length(s[1])::BIGINT AS size FROM ss WHERE len(s) > 1
  UNION ALL SELECT doc_id, chunk_id, k, CASE WHEN cut THEN grp + 1 ELSE grp END, CASE WHEN cut THEN k - taken ELSE first END, CASE WHEN cut THEN n + coalesce(list_sum(list_transform(s[k - taken : k - 1], lambda x: length(x))), 0)::BIGINT ELSE size + n END
  FROM (SELECT *, size + n > {STEP.max_chunk_size} AS cut, {_KEPT} AS taken FROM (SELECT g.doc_id, g.chunk_id, g.k + 1 AS k, g.grp, g.first, g.size, ss.s, length(ss.s[g.k + 1]) AS n FROM g JOIN ss USING (doc_id, chunk_id) WHERE g.k < len(ss.s)))),
r AS (SELECT doc_id, chunk_id, grp, min(first) AS first, max(k) AS last FROM g GROUP BY 1, 2, 3),
u AS (SELECT doc_id, chunk_id, 0 AS part, content, false AS refresh FROM p WHERE length(content) <= {STEP.max_chunk_size}
  UNION ALL SELECT r.doc_id, r.chunk_id, grp, array_to_string(s[first : last], ' '), true FROM r JOIN ss USING (doc_id, chunk_id)
  UNION ALL SELECT id // 100000, id % 100000, a, content, true FROM (SELECT id, a, {_sql_strip('substring(text, a + 1, z - a)')} AS content FROM w JOIN src USING (id) WHERE there) WHERE content <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, part) - 1)::INT AS chunk_id, content, refresh FROM u""")
def split_large_chunks(spark, sf):
    return C.optimised(C.window_chunks(_docs(spark, sf), 900), STEP, "split").select("doc_id", "chunk_id", "content", "refresh")


_ENDED = rf"""[。！？；.!?;]["”’'\)\]\s\p{{Z}}]*$"""
_LEAD = r"""(?s)^[^。！？；.!?;]*[。！？；.!?;]["”’'\)\]} \t\r\n]*"""


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _sql_join(a: str, b: str) -> str:
    left, right = f"regexp_replace({a}, '{_WS}+$', '')", f"regexp_replace({b}, '^{_WS}+', '')"
    han = "[' || chr(19968) || '-' || chr(40959) || ']"
    close = f"(regexp_matches({left}, '{han}$') AND regexp_matches({right}, '^{han}')) OR regexp_matches({right}, '^[,，。.！!？?；;:：]')"
    return f"CASE WHEN {left} = '' THEN {right} WHEN {right} = '' THEN {left} WHEN {close} THEN {left} || {right} ELSE {left} || ' ' || {right} END"


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_fixed(200)}),
g AS (SELECT doc_id, chunk_id, content AS own, '' AS moved FROM p WHERE chunk_id = 0
  UNION ALL SELECT doc_id, chunk_id, CASE WHEN shifts THEN rest ELSE content END, CASE WHEN shifts THEN head ELSE '' END
  FROM (SELECT *, head <> '' AND rest <> '' AND held <> '' AND NOT regexp_matches({_sql_strip('held')}, '{_quoted(_ENDED)}') AND length(held) + length(head) <= {STEP.max_chunk_size} AND length(rest) >= {STEP.min_chunk_size} AS shifts
    FROM (SELECT doc_id, chunk_id, content, held, {_sql_strip('substring(content, 1, n)')} AS head, {_sql_strip('substring(content, n + 1)')} AS rest
      FROM (SELECT p.doc_id, p.chunk_id, p.content, g.own AS held, length(regexp_extract(p.content, '{_quoted(_LEAD)}')) AS n FROM g JOIN p ON p.doc_id = g.doc_id AND p.chunk_id = g.chunk_id + 1)))),
o AS (SELECT *, coalesce(lead(moved) OVER (PARTITION BY doc_id ORDER BY chunk_id), '') AS taken FROM g)
SELECT doc_id, chunk_id, CASE WHEN taken <> '' THEN {_sql_join('own', 'taken')} ELSE own END AS content, moved <> '' OR taken <> '' AS refresh FROM o""")
def shift_chunk_boundaries(spark, sf):
    return C.optimised(C.window_chunks(_docs(spark, sf), 200), STEP, "shift").select("doc_id", "chunk_id", "content", "refresh")


@query(f"""WITH l AS (SELECT doc_id, pos, substring(content, 1, 60) AS a, lead(content) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM ({_LINES}))
SELECT doc_id, pos, regexp_matches({_sql_strip('a')}, '{_quoted(_ENDED)}') AS ended, length(regexp_extract(b, '{_quoted(_LEAD)}'))::INT AS lead, {_sql_join('a', 'b')} AS joined,
 regexp_matches(a || '..."', '(\\.\\.\\.|……)["'']$') AND NOT regexp_matches(a || '...」', '(\\.\\.\\.|……)["'']$') AS quoted,
 CASE WHEN regexp_matches('Heading ' || pos, '^Heading [1-6]') THEN regexp_extract('Heading ' || pos, '^Heading ([1-6])', 1)::INT ELSE 0 END AS level FROM l WHERE b IS NOT NULL""")
def boundary_texts(spark, sf):
    """Line ends cut short against the next line."""
    l = _lines(spark, sf).withColumns({"b": F.lead("content").over(B.order()), "a": F.substring("content", 1, 60)}).filter("b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    quoted = T.quoted_ellipsis(F.concat(a, F.lit('..."'))) & ~T.quoted_ellipsis(F.concat(a, F.lit("...」")))
    style = F.concat(F.lit("Heading "), F.col("pos").cast("string"))
    return l.select("doc_id", "pos", T.ends_sentence(a).alias("ended"), T.leading_sentence_length(b).alias("lead"), T.join_at_boundary(a, b).alias("joined"), quoted.alias("quoted"), T.heading_level(style).alias("level"))


_KINDS = "CASE chunk_id % 4 WHEN 0 THEN 'text_content' WHEN 1 THEN 'table_content' WHEN 2 THEN 'mixed_content' ELSE 'image_content' END"


@query(f"""SELECT doc_id, count(*) AS total_chunks, count(*) FILTER (chunk_id % 2 = 0) AS total_paragraphs, count(*) FILTER (chunk_id % 4 IN (1, 2)) AS total_tables, count(*) FILTER (chunk_id % 4 IN (2, 3)) AS total_images,
 list_sort(list(DISTINCT {_KINDS})) AS chunk_types, round(avg(trunc(length(content) / 1.3::DOUBLE)), 6) AS average_chunk_size FROM ({_fixed(300)}) GROUP BY 1""")
def summary_by_kind(spark, sf):
    """Windows as chunks of four kinds in turn."""
    c = C.window_chunks(_docs(spark, sf), 300).withColumns({"chunk_type": F.expr(_KINDS), "token_count": T.token_estimate(F.col("content")), "has_table": (F.col("chunk_id") % 4).isin(1, 2), "has_image": F.col("chunk_id") % 4 >= 2})
    return Q.summary(c).withColumn("average_chunk_size", F.round("average_chunk_size", 6))


@query(rf"""WITH l AS (SELECT doc_id, pos, pos % 4 = 0 AS head, {_sql_flat('substring(content, 1, (5 + pos % 30)::INT)')} AS c FROM ({_LINES})),
n AS (SELECT doc_id, pos, head, CASE WHEN regexp_matches(c, '^第\s*\d+\s*页.*$') OR regexp_matches(c, '^\d+$') OR regexp_matches(c, '^[-=_]{{3,}}$') THEN '' ELSE c END AS c FROM l)
SELECT doc_id, pos, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS type, c AS content FROM n WHERE (head AND c <> '') OR length(c) >= 10""")
def postprocessed_paragraphs(spark, sf):
    """Line starts of growing length, each fourth as a heading."""
    l = _lines(spark, sf).withColumn("content", F.expr("substring(content, 1, 5 + pos % 30)"))
    return M.postprocessed(l.select("doc_id", "pos", F.when(F.col("pos") % 4 == 0, "heading").otherwise("paragraph").alias("type"), "content"))


@query(f"""SELECT count(*) FILTER (length(text) > 300) AS total_processed, count(*) FILTER (length(text) <= 300) AS total_errors, count(*) FILTER (length(text) > 300 AND doc_id % 3 = 0)::BIGINT AS fallback_used,
 round(avg(ceil(length(text) / 300.0::DOUBLE)) FILTER (length(text) > 300), 6) AS mean_chunks, round(count(*) FILTER (length(text) > 300) / count(*)::DOUBLE, 6) AS success_rate FROM documents""")
def processing_statistics(spark, sf):
    """Windows of longer documents, every third said to be a fallback."""
    docs = _docs(spark, sf)
    c = C.window_chunks(docs.filter(F.length("text") > 300), 300).withColumn("processing_mode", F.when(F.col("doc_id") % 3 == 0, "fallback_text").otherwise("greedy"))
    return run_statistics(docs, c).withColumns({k: F.round(k, 6) for k in ("mean_chunks", "success_rate")})
