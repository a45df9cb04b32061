"""Files as (doc_id, path, markdown, …): text, markdown and the zipped office formats, read with binaryFile."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.folds import markdown_rows, parse_table
from quernstone.sources import pdf

SUPPORTED = (".txt", ".md", ".docx", ".xlsx", ".pptx", ".pdf")
#: Known to callers, not readable here: each needs a library of its own, or a parser from the caller.
NEEDS_LIBRARY = (".doc", ".xls")
Parser = Callable[[bytes], str]
SCHEMA = "doc_id long, path string, format string, markdown string, n_tables int, images array<struct<filename:string,size:long,format:string>>, properties map<string,string>, error string"
_MAGIC = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"RIFF", "webp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"))
_LEAST_IMAGE = 100
_DATE = re.compile(r"[ymdhs]", re.IGNORECASE)


def image_format(data: bytes) -> str | None:
    """Format by leading bytes; None if it's no image that is known."""
    return next((k for m, k in _MAGIC if data.startswith(m)), None)


def decoded(data: bytes) -> str:
    for name in ("utf-8-sig", "gb18030", "latin-1"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _find(node, name: str) -> list:
    return [x for x in node.iter() if _name(x.tag) == name]


def _attr(node, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _name(k) == name), "")


def _media(z: zipfile.ZipFile, folder: str) -> list[dict]:
    out = []
    for n in z.namelist():
        if n.startswith(folder) and (kind := image_format(data := z.read(n))) and len(data) >= _LEAST_IMAGE:
            out.append({"filename": n.rsplit("/", 1)[-1], "size": len(data), "format": kind})
    return out


def _properties(z: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in z.namelist():
        return {}
    return {_name(x.tag): x.text for x in ElementTree.fromstring(z.read("docProps/core.xml")) if x.text}


def text_markdown(data: bytes, least: int = 10) -> tuple[str, int]:
    """Blocks over ``least`` characters; those that are tables as markdown tables."""
    out, n = [], 0
    for b in (x.strip() for x in re.split(r"\n\s*\n", decoded(data).replace("\r\n", "\n"))):
        if len(b) > least:
            rows = parse_table(b)
            n += rows is not None
            out.append("\n".join(markdown_rows(rows)) if rows else b)
    return "\n\n".join(out), n


def docx_markdown(z: zipfile.ZipFile) -> tuple[str, int]:
    """Paragraphs by style, then the tables."""
    body = _find(ElementTree.fromstring(z.read("word/document.xml")), "body")[0]
    text = lambda node: "".join(x.text or "" for x in _find(node, "t")).strip()
    out, tables, nth = [], [], 0
    for node in body:
        if _name(node.tag) == "tbl":
            tables.append([[text(c) for c in _find(r, "tc")] for r in _find(node, "tr")])
        if _name(node.tag) != "p" or not (t := text(node)):
            continue
        style = next((_attr(x, "val") for x in _find(node, "pStyle")), "")
        level = re.match(r"(?i)heading\s*(\d)", style)
        nth = nth + 1 if re.search(r"(?i)list\s*number", style) else 0
        if level or style.lower() in ("title", "subtitle"):
            t = "#" * (int(level[1]) if level else 1 + (style.lower() == "subtitle")) + " " + t
        elif nth:
            t = f"{nth}. {t}"
        elif re.search(r"(?i)list", style) or _find(node, "numPr"):
            t = f"- {t}"
        elif any(_attr(x, "val") == "center" for x in _find(node, "jc")):
            t = f"<center>{t}</center>"
        out.append(t)
    rows = ["\n".join(markdown_rows(t)) for t in tables if t]
    return "\n\n".join([*out, *rows]), len(rows)


def cell_text(kind: str, value: str, is_date: bool, shared: list[str]) -> str:
    """A cell as text: dates without a time at midnight, whole numbers without a point."""
    if kind == "s":
        return shared[int(value)]
    if kind in ("str", "inlineStr", "b", "e", "d"):
        return value.replace("T", " ") if kind == "d" else value
    try:
        x = float(value)
    except ValueError:
        return value
    if is_date:
        when = datetime(1899, 12, 30) + timedelta(seconds=round(x * 86400))
        return when.strftime("%Y-%m-%d" if (when.hour, when.minute, when.second) == (0, 0, 0) else "%Y-%m-%d %H:%M:%S")
    return str(int(x)) if x.is_integer() else str(x)


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(_attr(x, "numFmtId")): _attr(x, "formatCode") for x in _find(root, "numFmt")}
    built_in = {*range(14, 23), *range(45, 48)}
    dates = built_in | {k for k, v in own.items() if _DATE.search(re.sub(r'"[^"]*"|\[[^\]]*\]', "", v))}
    xfs = next(iter(_find(root, "cellXfs")), [])
    return {i for i, x in enumerate(xfs) if int(_attr(x, "numFmtId") or 0) in dates}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_markdown(z: zipfile.ZipFile) -> tuple[str, int]:
    """Each sheet over one cell as a table of its rows that aren't blank."""
    shared = ["".join(t.text or "" for t in _find(x, "t")) for x in _find(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    dates, out = _date_styles(z), []
    book = ElementTree.fromstring(z.read("xl/workbook.xml")) if "xl/workbook.xml" in z.namelist() else None
    names = [_attr(x, "name") for x in _find(book, "sheet")] if book is not None else []
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1])[0]))
    for k, n in enumerate(files):
        rows = []
        for r in _find(ElementTree.fromstring(z.read(n)), "row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(_find(r, "c")):
                value = "".join(x.text or "" for x in c.iter() if _name(x.tag) in ("v", "t"))
                if value:
                    cells[_column(_attr(c, "r")) if _attr(c, "r") else i] = cell_text(_attr(c, "t"), value, int(_attr(c, "s") or 0) in dates, shared)
            if any(v.strip() for v in cells.values()):
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
        if len(rows) > 1 or (rows and len(rows[0]) > 1):
            out.append((names[k] if k < len(names) else f"Sheet{k + 1}", rows))
    return "\n\n".join(f"## {name}\n\n" + "\n".join(markdown_rows(rows)) for name, rows in out), len(out)


def pptx_markdown(z: zipfile.ZipFile) -> tuple[str, int]:
    """A heading per slide and a block per shape with text."""
    out = []
    files = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1])[0]))
    for k, n in enumerate(files, 1):
        shapes = []
        for s in _find(ElementTree.fromstring(z.read(n)), "sp"):
            t = "\n".join("".join(x.text or "" for x in _find(p, "t")) for p in _find(s, "p")).strip()
            shapes += [t] if t else []
        out.append("\n\n".join([f"## 幻灯片 {k}", *shapes]))
    return "\n\n".join(out), 0


def parse(path: str, data: bytes, parsers: dict[str, Parser] | None = None) -> dict:
    """One file's row; what can't be read has an error instead of markdown. ``parsers`` by suffix go before the own ones."""
    kind = re.search(r"\.[^./\\]+$", path.lower())
    kind = kind[0] if kind else ""
    row = {"path": path, "format": kind, "markdown": None, "n_tables": 0, "images": [], "properties": {}, "error": None}
    try:
        if parsers and kind in parsers:
            row["markdown"] = parsers[kind](data)
        elif kind == ".pdf":
            row["markdown"], row["n_tables"], row["properties"] = pdf.markdown(data)
        elif kind in (".txt", ".md"):
            row["markdown"], row["n_tables"] = text_markdown(data) if kind == ".txt" else (decoded(data), 0)
        elif kind in SUPPORTED:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                reader, folder = {".docx": (docx_markdown, "word/media/"), ".xlsx": (xlsx_markdown, "xl/media/"), ".pptx": (pptx_markdown, "ppt/media/")}[kind]
                row["markdown"], row["n_tables"] = reader(z)
                row["images"], row["properties"] = _media(z, folder), _properties(z)
        else:
            row["error"] = f"{kind} needs a library that isn't there" if kind in NEEDS_LIBRARY else f"unsupported format {kind!r}"
    except Exception as e:
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def _parsed(parsers: dict[str, Parser] | None):
    image = pa.struct([("filename", pa.string()), ("size", pa.int64()), ("format", pa.string())])
    kinds = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("format", pa.string()), ("markdown", pa.string()), ("n_tables", pa.int32()), ("images", pa.list_(image)), ("properties", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": d} | parse(p, c.as_py(), parsers) for d, p, c in zip(batch["doc_id"].to_pylist(), batch["path"].to_pylist(), batch["content"])]
            yield pa.RecordBatch.from_pylist([r | {"properties": list(r["properties"].items())} for r in rows], kinds)

    return run


def _binary(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def read_files(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Files under ``path``, a row each; doc_id is a hash of the path. Files that can't be read are rows with an error.

    ``parsers`` maps suffixes such as ".doc" to functions from bytes to markdown, which run in the workers.
    """
    return _binary(spark, path).mapInArrow(_parsed(parsers), SCHEMA)


_IMAGES = "doc_id long, path string, filename string, format string, position int, size long, data binary"


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("filename", pa.string()), ("format", pa.string()), ("position", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])
    for batch in batches:
        for d, path, content in zip(batch["doc_id"].to_pylist(), batch["path"].to_pylist(), batch["content"]):
            rows: list[dict] = []
            if zipfile.is_zipfile(data := io.BytesIO(content.as_py())):
                with zipfile.ZipFile(data) as z:
                    for n in z.namelist():
                        if re.match(r"(word|xl|ppt)/media/", n) and (kind := image_format(raw := z.read(n))) and len(raw) >= _LEAST_IMAGE:
                            rows.append({"doc_id": d, "path": path, "filename": n.rsplit("/", 1)[-1], "format": kind, "position": len(rows), "size": len(raw), "data": raw})
            yield pa.RecordBatch.from_pylist(rows, kinds)


def read_images(spark: SparkSession, path: str, base_url: str | None = None) -> DataFrame:
    """Images within the office files under ``path``, with their bytes, a row each; position counts them within a file.

    With ``base_url`` there is a url too, where a server of ``base_url`` could offer them: base_url/doc_id/filename.
    """
    images = _binary(spark, path).mapInArrow(_pictures, _IMAGES)
    if base_url is None:
        return images
    return images.withColumn("url", F.concat_ws("/", F.lit(base_url.rstrip("/")), F.col("doc_id").cast("string"), "filename"))
