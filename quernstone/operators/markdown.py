"""Markdown to paragraphs, tables, images, sections and ordered elements: (doc_id, markdown) in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quernstone.functions import text as T

IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
HEADING = r"^(#{1,6})\s+(.*)$"


def clean(lines: Column) -> Column:
    """Markdown with runs of blank lines squeezed, line ends and both ends trimmed."""
    text = F.regexp_replace(lines, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def blocks(docs: DataFrame) -> DataFrame:
    parts = docs.select("doc_id", F.posexplode(F.split("markdown", r"\n\s*\n", -1)).alias("block", "content"))
    return parts.select("doc_id", "block", T.strip(F.col("content")).alias("content")).filter("content <> ''")


def _without_images(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n", -1), T.strip)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(f"^{IMAGE}$"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, index, type, level, content): headings and paragraphs in order, without tables and lone images."""
    rest = blocks(docs).filter(~T.is_markdown_table(F.col("content"))).withColumn("lines", _without_images(F.col("content"))).filter(F.size("lines") > 0)
    first = F.col("lines")[0]
    heading = (F.size("lines") == 1) & first.rlike(HEADING)
    order = Window.partitionBy("doc_id").orderBy("block")
    return rest.select(
        "doc_id", (F.row_number().over(order) - 1).alias("index"), F.when(heading, "heading").otherwise("paragraph").alias("type"),
        F.when(heading, F.length(F.regexp_extract(first, HEADING, 1))).alias("level"),
        F.when(heading, F.regexp_extract(first, HEADING, 2)).otherwise(F.array_join("lines", "\n")).alias("content"),
    )


def postprocessed(paras: DataFrame, least: int = 10) -> DataFrame:
    """``paras`` with cleaned contents: headings while something is left, others of ``least`` characters or more."""
    out = paras.withColumn("content", T.clean_page_noise(F.col("content")))
    return out.filter(((F.col("type") == "heading") & (F.col("content") != "")) | (F.length("content") >= least))


def table_rows(c: Column) -> Column:
    """Cells of a markdown table's lines, rules left out."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), T.strip), lambda x: x.contains("|") & ~x.contains("---"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1), T.strip))


def tables(docs: DataFrame) -> DataFrame:
    """(doc_id, block, data) of tables with two rows or more."""
    return blocks(docs).filter(T.is_markdown_table(F.col("content"))).select("doc_id", "block", table_rows(F.col("content")).alias("data")).filter(F.size("data") > 1)


def rendered(rows: Column, columns: int = 3) -> Column:
    """Rows of cells as markdown lines; a single row gets the default header."""
    cell = lambda x: F.replace(T.collapse(x), F.lit("|"), F.lit(r"\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.coalesce(cell(F.get(r, i)), F.lit(""))), " | "), F.lit(" |"))
    rule, lines = F.lit("| " + " | ".join(["---"] * columns) + " |"), F.transform(rows, line)
    single = F.array(F.lit("| 编号 | 检查项 | 描述 |"), rule, lines[0], rule)
    many = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(F.size(rows) == 0, F.array().cast("array<string>")).when(F.size(rows) == 1, single).otherwise(many)


def inline_images(docs: DataFrame) -> DataFrame:
    """(doc_id, index, alt, url) of images in the text, duplicates kept."""
    found = F.arrays_zip(F.regexp_extract_all("markdown", F.lit(IMAGE), 1).alias("alt"), F.regexp_extract_all("markdown", F.lit(IMAGE), 2).alias("url"))
    return docs.select("doc_id", F.posexplode(found).alias("index", "i")).select("doc_id", "index", "i.alt", "i.url")


def all_images(docs: DataFrame, remote: DataFrame) -> DataFrame:
    """Inline images, and those of ``remote`` (doc_id, url) whose url doesn't stand in the text: (doc_id, url, filename, source)."""
    own = inline_images(docs)
    named = own.select("doc_id", "url", T.image_file_name(F.col("url"), F.col("index")).alias("filename"), F.lit("inline").alias("source"))
    more = remote.join(own.select("doc_id", "url").distinct(), ["doc_id", "url"], "left_anti")
    order = Window.partitionBy("doc_id").orderBy("url")
    return named.unionByName(more.select("doc_id", "url", T.image_file_name(F.col("url"), F.row_number().over(order) - 1).alias("filename"), F.lit("remote").alias("source")))


def sections(paras: DataFrame) -> DataFrame:
    """(doc_id, title, level, start_index, paragraphs): runs of paragraphs after each heading, empty ones left out."""
    order = Window.partitionBy("doc_id").orderBy("index")
    head = F.col("type") == "heading"
    numbered = paras.withColumn("section", F.sum(head.cast("int")).over(order)).filter("section > 0")
    grouped = numbered.groupBy("doc_id", "section").agg(
        F.max(F.when(head, F.col("content"))).alias("title"), F.coalesce(F.max(F.when(head, F.col("level"))), F.lit(1)).alias("level"),
        F.min("index").alias("start_index"), F.sort_array(F.collect_list(F.when(~head, F.col("index")))).alias("paragraphs"),
    )
    return grouped.filter(F.size("paragraphs") > 0).drop("section")


def structure(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_count, heading_count, table_count, image_count) of every document."""
    p = paragraphs(docs).groupBy("doc_id").agg(F.count_if(F.col("type") == "paragraph").alias("paragraph_count"), F.count_if(F.col("type") == "heading").alias("heading_count"))
    t, i = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((tables(docs), "table_count"), (inline_images(docs), "image_count")))
    out = docs.select("doc_id")
    for x in (p, t, i):
        out = out.join(x, "doc_id", "left")
    return out.na.fill(0)


def match_key(c: Column) -> Column:
    """What paragraphs are matched by: white space collapsed, a lone heading without its marks."""
    return T.collapse(F.when(c.contains("\n"), c).otherwise(F.regexp_replace(c, r"^#{1,6}\s+", "")))


def _occurrence_join(asked: DataFrame, there: DataFrame, asked_key: Column, there_key: Column) -> DataFrame:
    """``asked`` with matched, the index of the k-th row of ``there`` with the key for the k-th row that asks for it; null if none."""
    nth = lambda df, key, by: df.withColumn("_q_key", key).withColumn("_q_nth", F.row_number().over(Window.partitionBy("doc_id", "_q_key").orderBy(by)))
    own = nth(there, there_key, "index").select("doc_id", "_q_key", "_q_nth", F.col("index").alias("matched"))
    return nth(asked, asked_key, "pos").join(own, ["doc_id", "_q_key", "_q_nth"], "left").drop("_q_key", "_q_nth")


def matched(asked: DataFrame, there: DataFrame) -> DataFrame:
    """``asked`` (doc_id, pos, content) with matched, the index of the paragraph of ``there`` (doc_id, index, content)
    with the same key; each is taken once, in order, and -1 stands where none is left."""
    key = match_key(F.col("content"))
    return _occurrence_join(asked, there, key, key).select("doc_id", "pos", "content", F.coalesce("matched", F.lit(-1)).alias("matched"))


def _rest(asked: DataFrame, there: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What of both sides isn't matched yet."""
    taken = found.filter("matched IS NOT NULL").select("doc_id", F.col("matched").alias("index"))
    return found.filter("matched IS NULL").drop("matched"), there.join(taken, ["doc_id", "index"], "left_anti")


def matched_tables(asked: DataFrame, there: DataFrame) -> DataFrame:
    """``asked`` (doc_id, pos, content) with the index of the table of ``there`` (doc_id, index, content) with the same
    lines, else of the first table left, else -1."""
    key = F.array_join(F.filter(F.transform(F.split("content", "\n", -1), T.collapse), lambda x: x != ""), "\n")
    first = _occurrence_join(asked, there, key, key)
    left, free = _rest(asked, there, first)
    second = _occurrence_join(left, free, F.lit(0), F.lit(0))
    both = first.filter("matched IS NOT NULL").unionByName(second)
    return both.select("doc_id", "pos", F.coalesce("matched", F.lit(-1)).alias("matched"))


def matched_images(asked: DataFrame, there: DataFrame) -> DataFrame:
    """``asked`` (doc_id, pos, url, alt) with the index of the image of ``there`` (doc_id, index, url, filename) with
    the url, else of one whose file name is the alt text, else -1."""
    first = _occurrence_join(asked, there, F.col("url"), F.col("url"))
    left, free = _rest(asked, there, first)
    second = _occurrence_join(left, free, F.col("alt"), F.col("filename"))
    both = first.filter("matched IS NOT NULL").unionByName(second)
    return both.select("doc_id", "pos", F.coalesce("matched", F.lit(-1)).alias("matched"))


def stream(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, content, url, alt) of paragraphs, tables and images as they follow each other in the markdown.

    An image alone on its line ends the paragraph before it. Tables are theirs whole, paragraphs and headings with their
    marks; url and alt are null but for images. A null markdown has none.
    """
    alone = rf"^{IMAGE}$"
    b = blocks(docs).withColumn("table", T.is_markdown_table(F.col("content")))
    lines = b.filter("NOT table").select("doc_id", "block", F.posexplode(F.split("content", "\n", -1)).alias("line", "content")).withColumn("content", T.strip(F.col("content")))
    lines = lines.filter("content <> ''").withColumn("image", F.col("content").rlike(alone))
    run = F.sum(F.col("image").cast("int")).over(Window.partitionBy("doc_id", "block").orderBy("line"))
    text = lines.withColumn("run", run).filter("NOT image").groupBy("doc_id", "block", "run")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    none = F.lit(None).cast("string")
    paras = text.agg(F.min("line").alias("line"), joined.alias("content")).select("doc_id", "block", "line", F.lit("paragraph").alias("kind"), "content", none.alias("url"), none.alias("alt"))
    images = lines.filter("image").select("doc_id", "block", "line", F.lit("image").alias("kind"), "content", *(T.strip(F.regexp_extract("content", alone, k)).alias(n) for n, k in (("url", 2), ("alt", 1))))
    rows = b.filter("table").select("doc_id", "block", F.lit(0).alias("line"), F.lit("table").alias("kind"), "content", none.alias("url"), none.alias("alt"))
    order = Window.partitionBy("doc_id").orderBy("block", "line")
    return paras.unionByName(images).unionByName(rows).select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "kind", "content", "url", "alt")


def assembled(docs: DataFrame, paras: DataFrame, tabs: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, heading, content, url, source): a parsed document's parts in the order of its markdown.

    ``paras`` (doc_id, index, type, content), ``tabs`` (doc_id, index, content as markdown lines) and ``images`` (doc_id,
    index, url, filename) each go where the markdown has them; source is their index, null for what only the markdown
    has. What it doesn't name follows: paragraphs, tables, images. A document without markdown has these alone. An
    image's content is its file name, or its alt text.
    """
    own = stream(docs)
    kind = lambda k: own.filter(F.col("kind") == k)
    bare = F.when(~F.col("content").contains("\n") & F.col("content").rlike(HEADING), F.regexp_extract("content", HEADING, 2)).otherwise(F.col("content"))
    text = kind("paragraph").withColumns({"marked": ~F.col("content").contains("\n") & F.col("content").rlike(HEADING), "content": bare})
    parts = []
    for n, (name, asked, there, found, value) in enumerate((
        ("paragraph", text, paras.withColumn("head", F.col("type") == "heading"), matched(text.select("doc_id", "pos", "content"), paras.select("doc_id", "index", "content")), "content"),
        ("table", kind("table"), tabs, matched_tables(kind("table").select("doc_id", "pos", "content"), tabs.select("doc_id", "index", "content")), "content"),
        ("image", kind("image"), images, matched_images(kind("image").select("doc_id", "pos", "url", "alt"), images.select("doc_id", "index", "url", "filename")), "filename"),
    ), 1):
        head = F.col("head") if name == "paragraph" else F.lit(False)
        link = F.col("url") if name == "image" else F.lit(None).cast("string")
        given = there.select("doc_id", F.col("index").alias("source"), F.col(value).alias("g_content"), head.alias("g_head"), link.alias("g_url"))
        places = found.select("doc_id", "pos", F.nullif("matched", F.lit(-1)).alias("source"))
        mine = asked.select("doc_id", "pos", *([F.col("marked")] if name == "paragraph" else [F.lit(False).alias("marked")]), F.col("alt" if name == "image" else "content").alias("content"), "url")
        placed = mine.join(places, ["doc_id", "pos"]).join(given, ["doc_id", "source"], "left")
        parts.append(placed.select("doc_id", F.lit(0).alias("tier"), F.col("pos").cast("long").alias("at"), F.lit(name).alias("kind"), F.coalesce("g_head", "marked").alias("heading"), F.coalesce("g_content", "content").alias("content"), F.coalesce("g_url", "url").alias("url"), F.col("source").cast("long").alias("source")))
        rest = given.join(places.filter("source IS NOT NULL").select("doc_id", "source"), ["doc_id", "source"], "left_anti")
        parts.append(rest.select("doc_id", F.lit(n).alias("tier"), F.col("source").cast("long").alias("at"), F.lit(name).alias("kind"), F.col("g_head").alias("heading"), F.col("g_content").alias("content"), F.col("g_url").alias("url"), F.col("source").cast("long").alias("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("doc_id").orderBy("tier", "at")
    return out.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "kind", "heading", "content", "url", "source")


def elements(docs: DataFrame, least: int = 10, language: str = "zh") -> DataFrame:
    """(doc_id, pos, kind, heading, content, embed_text): paragraphs, tables and images in the order of the markdown.

    Paragraphs need ``least`` characters and something left after cleaning; the k-th image's text for embedding names k.
    """
    own = stream(docs)
    heading = (F.col("kind") == "paragraph") & ~F.col("content").contains("\n") & F.col("content").rlike(HEADING)
    bare = F.when(heading, F.regexp_extract("content", HEADING, 2)).otherwise(F.col("content"))
    content = F.when(F.col("kind") == "paragraph", T.clean_text(bare, language)).when(F.col("kind") == "table", F.array_join(rendered(table_rows(F.col("content"))), "\n")).otherwise(F.col("content"))
    kept = own.withColumns({"heading": heading, "size": F.length(bare), "text": content}).filter((F.col("kind") != "paragraph") | ((F.col("size") >= least) & (F.col("text") != "")))
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = F.coalesce(F.sum((F.col("kind") == "image").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text_of = F.when(F.col("kind") == "image", F.concat(F.lit(T.IMAGE_MARK), before.cast("string"), F.lit("]"))).otherwise(F.col("text"))
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "kind", "heading", F.col("text").alias("content"), text_of.alias("embed_text"))


def as_documents(elems: DataFrame) -> DataFrame:
    """One row (doc_id, elements) per document, for chunking."""
    packed = F.sort_array(F.collect_list(F.struct("pos", "content", "kind", "heading")))
    return elems.groupBy("doc_id").agg(F.transform(packed, lambda x: F.struct(x["content"].alias("content"), x["kind"].alias("kind"), x["heading"].alias("heading"))).alias("elements"))


def remote_images(images: Column) -> Column:
    """Urls of image structs that name them in one of several fields."""
    return F.transform(images, lambda x: F.coalesce(*[F.nullif(x[k], F.lit("")) for k in ("url", "image_url", "src", "path")]))


SCHEMA = T_.StructType([T_.StructField("doc_id", T_.LongType()), T_.StructField("markdown", T_.StringType())])
