"""Text expressions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks and words that the rules look for (fixed values).
TABLE_MARK = "[表格内容]"
IMAGE_MARK = "[IMAGE_PLACEHOLDER_"
TABLE_WORDS = ["编号", "检查项", "描述", "项目", "内容", "序号", "名称", "说明"]
SENTENCE_ENDS = {"zh": "[。！？；]", "en": "[.!?;]"}
#: Characters with Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Characters that cleaning keeps.
KEPT = {
    "zh": r"[^\x{4e00}-\x{9fff}\x{3000}-\x{303f}A-Za-z0-9\s.,!?;:\"()（）【】\[\]<>《》]",
    "en": r"[^\w\s.,!?;:\"'()\[\]<>-]",
}


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, which is evaluated once however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def count_of(c: Column, part: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, r"(?U)\s+", -1), lambda x: x != "")


def clean_text(c: Column, language: str = "zh") -> Column:
    """White space collapsed and, unless there's an image in markdown, characters outside the allowed set dropped."""
    flat = collapse(c)
    return F.when(flat.contains("![") & flat.contains("]("), flat).otherwise(strip(F.regexp_replace(flat, "(?U)" + KEPT["zh" if language == "zh" else "en"], "")))


def clean_chunk(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_page_noise(c: Column) -> Column:
    """White space collapsed; page headers, bare numbers and rules become empty."""
    flat = collapse(c)
    return F.when(flat.rlike(r"(?U)^第\s*\d+\s*页.*$") | flat.rlike(r"(?U)^\d+$") | flat.rlike(r"^[-=_]{3,}$"), F.lit("")).otherwise(flat)


def for_embedding(c: Column, language: str = "zh") -> Column:
    blank = F.length(strip(c)) == 0
    short = F.substring(collapse(c), 1, 512 if language == "zh" else 256)
    return F.when(c.isNull() | blank, F.lit("")).when(c.contains(IMAGE_MARK), F.lit("图片内容")).otherwise(short)


def token_estimate(c: Column, language: str = "zh") -> Column:
    if language == "zh":
        return (F.length(c) / F.lit(1.3).cast("double")).cast("int")
    return (F.size(words(c)) / F.lit(0.75).cast("double")).cast("int")


def sentences(c: Column, language: str = "zh") -> Column:
    parts = F.transform(F.split(c, SENTENCE_ENDS["zh" if language == "zh" else "en"], -1), strip)
    return F.filter(parts, lambda x: x != "")


def quality_sentences(c: Column) -> Column:
    """Sentences as the quality measures take them: Chinese ends in any language, longer than five characters."""
    return F.filter(F.transform(F.split(c, SENTENCE_ENDS["zh"], -1), strip), lambda x: F.length(x) > 5)


def ends_sentence(c: Column) -> Column:
    return strip(c).rlike(r"(?U)[。！？；.!?;][\"”’'\)\]\s]*$")


def ends_with_stop(c: Column, semicolon: bool = True) -> Column:
    return rstrip(c).rlike("[。.！!？?" + ("；;" if semicolon else "") + "]$")


def leading_sentence_length(c: Column) -> Column:
    """Characters up to the first sentence end and what closes it; 0 if none."""
    return F.length(F.regexp_extract(c, r"(?s)^[^。！？；.!?;]*[。！？；.!?;][\"”’'\)\]} \t\r\n]*", 0))


def join_at_boundary(left: Column, right: Column) -> Column:
    a, b = rstrip(left), lstrip(right)
    cjk = a.rlike(r"[\x{4e00}-\x{9fff}]$") & b.rlike(r"^[\x{4e00}-\x{9fff}]")
    return F.when(a == "", b).when(b == "", a).when(cjk | b.rlike("^[,，。.！!？?；;:：]"), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def is_markdown_table(c: Column) -> Column:
    """Two lines that aren't blank or more, a rule and a pipe."""
    lines = F.filter(F.split(c, "\n", -1), lambda x: strip(x) != "")
    return (F.size(lines) >= 2) & F.exists(lines, lambda x: x.contains("---")) & F.exists(lines, lambda x: x.contains("|"))


def is_table(c: Column) -> Column:
    """Whether a text looks like a table or a list of numbered or marked items."""
    pipes, lines = count_of(c, "|"), F.split(c, "\n", -1)
    ruled = (F.size(lines) >= 2) & F.exists(lines, lambda x: x.contains("---")) & F.exists(lines, lambda x: x.contains("|"))
    named = c.rlike("|".join(TABLE_WORDS)) & (pipes >= 2)
    asked = c.rlike(r"(?U)\d+\s+[^0-9]+?\?\s*示例[：:]\s*[^0-9]*\d+\s+")
    numbered = F.regexp_count(c, F.lit(r"(?U)\b\d+\s+[^\d]+?(?=\s*\d+\s+|$)")) >= 3
    cells = ((pipes >= 2) | c.contains("\t")) & (F.size(F.filter(F.split(c, r"[|\t]", -1), lambda x: strip(x) != "")) >= 3)
    listed = F.regexp_count(c, F.lit(r"(?U)[-•·]\s*[^-•·]+")) >= 3
    return c.startswith(TABLE_MARK) | (pipes >= 3) | ruled | named | asked | numbered | cells | listed


def is_chapter_title(c: Column) -> Column:
    numbered = c.rlike(r"(?U)^第[一二三四五六七八九十\d]+[章节部分]") | c.rlike(r"(?U)^\d+[\.\s]+[^\n]{1,50}$") | c.rlike(r"(?U)^[一二三四五六七八九十]+[\.\s、]+[^\n]{1,50}$")
    return numbered | ((F.length(c) < 50) & ~c.rlike("[。.！!？?]$"))


def is_list_start(c: Column) -> Column:
    return c.rlike(r"(?U)^(\d+[\.\)]|[•·▪▫]|[-*+])")


def is_paragraph_shift(before: Column, now: Column) -> Column:
    ratio = F.length(now) / F.greatest(F.length(before), F.lit(1))
    return (ratio > 3) | (ratio < 0.3) | ((count_of(before, "。") > 2) & ~now.contains("。"))


def is_pdf_heading(c: Column) -> Column:
    upper = (F.upper(c) == c) & (F.lower(c) != c)
    return (F.length(c) <= 100) & (upper | c.rlike(r"^[A-Z][^.!?]*$") | c.rlike(r"(?U)^\d+[\.\s]+[A-Z]"))


def heading_level(style: Column) -> Column:
    n = F.regexp_extract(style, r"^Heading ([1-6])", 1)
    return F.when(n != "", n.cast("int")).when(style == "Title", 1).when(style == "Subtitle", 2).otherwise(0)


def quoted_ellipsis(c: Column) -> Column:
    """Whether a text ends with an ellipsis and a straight closing quote."""
    return c.rlike("(\\.\\.\\.|……)[\"']$")


def image_file_name(url: Column, index: Column) -> Column:
    base = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"([^/]+)$", 1)
    return F.when(F.coalesce(base, F.lit("")) != "", base).otherwise(F.concat(F.lit("image_"), (index + 1).cast("string"), F.lit(".png")))


def cache_key(c: Column) -> Column:
    return F.concat(F.length(c).cast("string"), F.lit("_"), F.substring(F.md5(c), 1, 16))
