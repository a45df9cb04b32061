"""Text of simple PDF files: plain or deflated streams, fonts whose codes are Latin characters.

Pages come in the order of the file's page tree. Lines that a page sets apart by more than one and a half times the size
of their letters are paragraphs. Encrypted files, and pages whose fonts number glyphs in a way of their own, are errors;
a parser for them can be given to ``read_files``.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?(?:\d+\.?\d*|\.\d+)|/[^\s/\[\]()<>]+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
#: Names of the document's properties as rows show them.
PROPERTIES = {"Title": "title", "Author": "author", "Subject": "subject", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "modification_date"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, those within object streams too."""
    out = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            raw, first = _data(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            head = [int(x) for x in raw[:first].split()]
            places = head[1::2]
            for n, a, b in zip(head[::2], places, [*places[1:], len(raw) - first]):
                out[n] = raw[first + a : first + b]
    return out


def _data(body: bytes) -> bytes:
    found = _STREAM.search(body)
    raw = found[1] if found else b""
    filters = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", body)
    names = re.findall(rb"/(\w+)", filters[1]) if filters else []
    for n in names:
        if n != b"FlateDecode":
            raise ValueError(f"a PDF stream in {n.decode()}")
        raw = zlib.decompressobj().decompress(raw)
    return raw


def _refs(body: bytes, key: bytes) -> list[int]:
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found else []


def _pages(objects: dict[int, bytes], at: int, seen: set[int]) -> list[int]:
    body = objects.get(at, b"")
    if at in seen:
        return []
    seen.add(at)
    if re.search(rb"/Type\s*/Pages\b", body):
        return [p for k in _refs(body, b"Kids") for p in _pages(objects, k, seen)]
    return [at] if re.search(rb"/Type\s*/Page\b", body) else []


def page_text(content: bytes) -> str:
    """Lines of a content stream's strings, a blank one where the gap between two is wide."""
    lines: list[list] = []  # height, letter size, text
    stack: list = []
    size = leading = y = 0.0
    scale, at_line, in_array, run = 1.0, None, False, []

    def show(text: str) -> None:
        nonlocal at_line
        if at_line is None or abs(at_line - y) > 0.01:
            lines.append([y, size * abs(scale) or 1.0, text])
        else:
            lines[-1][2] += text
        at_line = y

    number = lambda k: float(stack[-k]) if len(stack) >= k and re.fullmatch(rb"[-+.\d]+", stack[-k]) else 0.0
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token == b"[":
            in_array, run = True, []
        elif token == b"]":
            in_array = False
        elif in_array:
            if token[:1] in b"(<":
                run.append(_string(token))
            elif re.fullmatch(rb"[-+.\d]+", token) and float(token) < -200:
                run.append(" ")
        elif token[:1].isalpha() or token[:1] in b"'\"":
            if token == b"BT":
                y, scale = 0.0, 1.0
            elif token == b"Tf":
                size = number(1)
            elif token == b"TL":
                leading = number(1)
            elif token in (b"Td", b"TD"):
                y += number(1) * scale
                leading = -number(1) if token == b"TD" else leading
            elif token == b"Tm":
                y, scale = number(1), number(3) or 1.0
            elif token in (b"T", b"T*", b"'", b'"'):
                y -= leading * scale
            if token == b"TJ":
                show("".join(run))
            elif token in (b"Tj", b"'", b'"') and stack and stack[-1][:1] in b"(<":
                show(_string(stack[-1]))
            stack = []
        else:
            stack.append(token)
    out = ""
    for k, (height, letters, text) in enumerate(lines):
        gap = abs(lines[k - 1][0] - height) if k else 0.0
        out += ("" if not k else "\n\n" if gap > 1.5 * max(letters, lines[k - 1][1]) else "\n") + text
    return out


def read(data: bytes) -> tuple[list[str], dict[str, str]]:
    """The pages' texts, and the document's properties."""
    if not data.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    if re.search(rb"/Encrypt\s+\d+", data):
        raise ValueError("an encrypted PDF")
    objects = _objects(data)
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    pages = [p for k in _refs(objects.get(root, b""), b"Pages") for p in _pages(objects, k, set())]
    if not pages:
        raise ValueError("a PDF without a page tree")
    if any(re.search(rb"/Encoding\s*/Identity-[HV]\b", b) for b in objects.values()):
        raise ValueError("a PDF with numbered glyphs")
    texts = [page_text(b"\n".join(_data(objects[c]) for c in _refs(objects[p], b"Contents") if c in objects)) for p in pages]
    info = next((int(n) for n in re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", data)), None)
    found = re.findall(rb"/(" + b"|".join(k.encode() for k in PROPERTIES) + rb")\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", objects.get(info, b""))
    return texts, {PROPERTIES[k.decode()]: _string(v) for k, v in found} | {"page_count": str(len(pages))}


def _heading(text: str) -> bool:
    upper = text.isupper()
    return len(text) <= 100 and bool(upper or re.match(r"[A-Z][^.!?]*$", text) or re.match(r"\d+[.\s]+[A-Z]", text))


def markdown(data: bytes, least: int = 10) -> tuple[str, int, dict[str, str]]:
    """Blocks of ``least`` characters or more in page order, headings marked; no tables; properties."""
    texts, properties = read(data)
    blocks = [x for t in texts for b in t.split("\n\n") if len(x := " ".join(b.split())) >= least]
    return "\n\n".join(f"## {b}" if _heading(b) else b for b in blocks), 0, properties
