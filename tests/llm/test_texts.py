"""Token counts, media columns, pieces, quality and language."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import avi, language_id, pieces, quality, token_counts
from quernstone.llm.token_counts import tokenizer_path

ODD = [None, "", " ", "\n\n \t x", "a<|endoftext|>b<|endoftext|>", "it's we'LL 'tis  3.14\r\n", "naïve ß 中文 　 🙂\U000107bb ՘ ꟎", "word " * 30000, "y" * 40000, "same", "same"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(None if i == 3 else i, t, "n") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("block", [50, 10_000_000])
def test_token_counts(docs, block):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(token_counts.TOKENIZER))
    want = []
    for i, t in enumerate(ODD):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((None if i == 3 else i, len((t or "").encode()), n, n > 512))
    got = token_counts.token_counts(docs, block=block, part=20_000).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_token_counts_empty(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_media_round_trip(docs):
    import hashlib

    rows = avi.media_column(docs).mapInArrow(avi._digest, avi._DIGEST).collect()
    want = collections.Counter(hashlib.sha256(avi.payload_of((t or "").encode())).hexdigest() for t in ODD)
    assert collections.Counter(r.payload_sha256 for r in rows) == want
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 for r in rows)


def test_any_bytes_and_other_tables():
    data = bytes(random.Random(4).randrange(256) for _ in range(64 * 37))
    frames, fps = avi.read_avi(avi.write_avi(avi.encode_frames(data)))
    assert fps == 25 and b"".join(avi.decode_frame(f).tobytes() for f in frames) == data
    frame = frames[0]
    head = frame[: frame.index(b"\xff\xda")]
    h, w, table9, codes = avi._plan(head)
    bits = np.unpackbits(np.frombuffer(avi._BITS[np.arange(511)].copy().tobytes(), np.uint8).reshape(-1, 9)[:, :].astype(np.uint8), axis=1)[:, 7::8]
    assert table9 is not None and (avi._slow(bits.ravel(), 511, codes) == np.arange(-255, 256)).all()
    assert avi.read_avi(avi.write_avi([frame]).replace(b"idx1", b"JUNK"))[0] == [frame]
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFF    WAVE")


def baseline(planes, factors, every=0):
    """A baseline JPEG of planes whose sides fill their blocks, with codes of one length: 4 bits for DC, 8 for AC symbols."""
    import struct

    k = np.arange(8)
    cosine = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    zigzag, row, column = [], 0, 0
    for _ in range(64):
        zigzag.append(8 * row + column)
        if (row + column) % 2 == 0:
            row, column = (row + 1, 7) if column == 7 else (max(row - 1, 0), column + 1)
        else:
            row, column = (7, column + 1) if row == 7 else (row + 1, max(column - 1, 0))
    symbols = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]

    def number(x):
        n = abs(x).bit_length()
        return format(x if x > 0 else x + (1 << n) - 1, f"0{n}b") if n else ""

    def block(b, before):
        x = np.rint(cosine @ (b.astype(float) - 128) @ cosine.T).astype(int).ravel()[zigzag].tolist()
        bits, run = format(abs(x[0] - before).bit_length(), "04b") + number(x[0] - before), 0
        for v in x[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits, run = bits + format(symbols.index(0xF0), "08b"), run - 16
            bits, run = bits + format(symbols.index(run << 4 | abs(v).bit_length()), "08b") + number(v), 0
        return bits + (format(0, "08b") if run else ""), x[0]

    most_h, most_v = max(f[0] for f in factors), max(f[1] for f in factors)
    height, width = planes[0].shape
    scan, bits, before = b"", "", [0] * len(planes)

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    across, down = width // (8 * most_h), height // (8 * most_v)
    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            scan, bits, before = scan + flush(bits) + bytes([0xFF, 0xD0 + (mcu // every - 1) % 8]), "", [0] * len(planes)
        for c, (p, (h, v)) in enumerate(zip(planes, factors)):
            for y in range(v):
                for x in range(h):
                    a, b = 8 * (mcu // across * v + y), 8 * (mcu % across * h + x)
                    more, before[c] = block(p[a : a + 8, b : b + 8], before[c])
                    bits += more
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"AVI1") + segment(0xDB, b"\0" + b"\1" * 64)
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(factors)))
    head += segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    head += segment(0xDD, struct.pack(">H", every)) if every else b""
    return head + segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0]) for c in range(len(planes))) + b"\0\x3f\0") + scan + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("factors", "every"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_baseline_frames(factors, every):
    rng = np.random.default_rng(8)
    y, x = np.mgrid[:32, :48]
    light = np.clip(128 + 90 * np.sin(x / 7) * np.cos(y / 5) + rng.normal(0, 12, (32, 48)), 0, 255).astype(np.uint8)
    most_h, most_v = max(f[0] for f in factors), max(f[1] for f in factors)
    planes = [light, *(rng.integers(0, 255, (32 // most_v, 48 // most_h), np.uint8) for _ in factors[1:])]
    frame = baseline(planes, factors, every)
    got = avi.decode_frame(frame)
    assert got.shape == light.shape and np.abs(got.astype(int) - light).max() <= 2
    for at in (frame.index(b"\xff\xc0"), frame.index(b"\xff\xc4")):
        with pytest.raises(ValueError):
            avi.decode_frame(frame[:at] + (b"\xff\xc2" if frame[at + 1] == 0xC0 else b"\xff\xfe") + frame[at + 2 :])
    first = avi.write_avi([frame, frame])
    second = avi.write_avi([frame])
    second = second[:8] + b"AVIX" + second[12:].replace(b"idx1", b"JUNK")
    assert avi.read_avi(first + second)[0] == [frame] * 3


def test_media_digest_against_plain_reading(docs):
    """All columns from the stored bytes, read without the operator's reader."""
    import hashlib
    import zlib

    stored = {(r.doc_id, r.n_bytes): bytes(r.media) for r in avi.media_column(docs).collect()}
    for r in avi.media_column(docs).mapInArrow(avi._digest, avi._DIGEST).collect():
        data = stored[r.doc_id, r.n_bytes]
        text = next(t or "" for i, t in enumerate(ODD) if (None if i == 3 else i) == r.doc_id).encode()
        payload = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        frames = -(-len(payload) // 1024)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest())
        assert r.n_frames == frames == data.count(b"00dc") // 2 and r.feature.startswith(f"{frames} frames; clips from 0.00")
        pictures = [payload[i : i + 1024] for i in range(0, len(payload), 1024)]
        share = [[sum(b >> 4 == k for b in p) / len(p) for k in range(16)] for p in pictures]
        far = [sum(abs(a - b) for a, b in zip(x, y)) for x, y in zip(share, share[1:])]
        cuts, seen = [0], []
        for k, x in enumerate(far, 1):
            last = np.array(seen[-8:])
            if x > 0.25 and (not len(last) or x > last.mean() + 2 * last.std()):
                cuts, seen = [*cuts, k], []
            else:
                seen.append(x)
        assert r.n_clips == len(cuts) and r.feature.split("from ")[1] == ",".join(f"{c / 25:.2f}" for c in cuts)
    assert avi.media_column(docs.limit(0)).collect() == []


def test_clips(spark):
    still = [np.full((16, 64), 10, np.uint8)] * 5 + [np.full((16, 64), 200, np.uint8)] * 4
    assert avi.clips(still) == [(0, 4, 0.0, 0.2), (5, 8, 0.2, 0.36)]
    media = avi.write_avi(avi.encode_frames(b"".join(f.tobytes() for f in still)))
    table = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(avi.write_avi([])))], "doc_id long, media binary")
    assert [tuple(r)[:4] for r in avi.clip_table(table).orderBy("clip").collect()] == [(1, 0, 0, 4), (1, 1, 5, 8)]


def test_pieces_against_all_segmentations():
    model = pieces.lattice(tokenizer_path(pieces.MODEL))

    def every(into, b):
        if not b:
            yield 0.0
        for a, s, _ in into[b]:
            for x in every(into, a):
                yield x + s

    r = random.Random(1)
    for _ in range(60):
        t = " ".join("".join(r.choice("theo\nañ") for _ in range(r.randrange(0, 5))) for _ in range(r.randrange(1, 4)))
        norm = model.library.normalize(t)
        want = sorted(every(model.edges(norm), len(norm)), reverse=True)[:4] if norm else [0.0]
        got = model.encode(t, 4)
        assert [s for s, _ in got] == want
        assert all(model.decode(ids) == t == model.library.decode(ids) for _, ids in got)
        assert len({tuple(ids) for _, ids in got}) == len(got)


def test_pieces_round_trip(docs):
    model = pieces.lattice(tokenizer_path(pieces.MODEL))
    encoded = pieces.encode(docs, ["doc_id", "text", "n_tokens"])
    out = encoded.collect()
    assert len(out) == len(ODD) and all(r.decoded == (r.text or "") and r.library_ids == model.library.encode(r.text or "") for r in out)
    back = pieces.decode(encoded.select("doc_id", F.col("text").alias("decoded"), "pieces")).collect()
    assert all(r.text == (r.decoded or "") for r in back)
    assert pieces.encode(docs.limit(0), ["doc_id"]).collect() == [] == pieces.decode(encoded.limit(0).select("pieces")).collect()


def test_nbest_segmentations(spark):
    model, n = pieces.lattice(tokenizer_path(pieces.MODEL)), pieces.N

    def every(into, b):
        if not b:
            yield 0.0, ()
        for a, s, ids in into[b]:
            for x, before in every(into, a):
                yield x + s, before + ids

    r = random.Random(2)
    texts = ["", "a", *{" ".join("".join(r.choice("theo\nañ") for _ in range(r.randrange(0, 5))) for _ in range(r.randrange(1, 4))) for _ in range(40)}]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pieces.encode(rows, ["doc_id", "text"]).collect()
    assert len(found) == len(texts) and any(len(x.nbest) == n for x in found)
    for x in found:
        norm = model.library.normalize(x.text)
        want = sorted(every(model.edges(norm), len(norm)), reverse=True)
        assert x.scores == [s for s, _ in want[:n]] and x.nbest[0] == x.pieces and len(x.nbest) == len(x.scores)
        assert len({tuple(ids) for ids in x.nbest}) == len(x.nbest)
        assert all((s, tuple(ids)) in want and model.decode(ids) == x.text for s, ids in zip(x.scores, x.nbest))


def test_nbest_query(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda ids: hashlib.sha256(np.array(ids, np.int32).tobytes()).hexdigest()
    want = {x.doc_id: x for x in pieces.encode(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "text"]).collect()}
    rows = pieces.op4_sentencepiece_nbest(spark, sf).collect()
    assert len(rows) == len(want)
    for x in rows:
        w = want[x.doc_id]
        assert x.nbest_sha256 == [sha(ids) for ids in w.nbest] and x.scores == w.scores and x.nbest_round_trip
        assert x.ids_sha256 == x.nbest_sha256[0] and x.n_pieces == len(w.pieces) and x.decoded_sha256 == hashlib.sha256(w.decoded.encode()).hexdigest()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op6_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(docs, labels).collect()} == {0.5}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_scores(none, labels).collect() == []
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, some).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    good = {r.doc_id for r in rows if r.predicted}
    kept = quality.keep_good(docs, some).collect()
    assert collections.Counter(r.doc_id for r in kept) == collections.Counter(r.doc_id for r in rows if r.doc_id in good)


def test_isotonic():
    at, value = quality.isotonic(np.arange(4.0), np.array([10, 10, 10, 10.0]), np.array([1, 6, 4, 9.0]))
    assert (np.diff(value) >= 0).all() and value[2] == value[3] and len(at) == len(value)
    at, value = quality.isotonic(np.array([0.0, 1.0]), np.array([1.0, 100.0]), np.array([0.0, 20.0]))
    assert list(at) == [0, 0, 1, 1] and list(value) == [0, 0, 0.2, 0.2]
    r = random.Random(2)
    n, y = np.array([r.randrange(1, 9) for _ in range(60)], float), []
    for x in n:
        y.append(float(r.randrange(int(x) + 1)))
    at, value = quality.isotonic(np.arange(60.0), n, np.array(y))
    # the least squares fit by the max-min formula
    mean = lambda a, b: sum(y[a:b]) / n[a:b].sum()
    want = [max(min(mean(a, b) for b in range(i + 1, 61)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(np.interp(np.arange(60.0), at, value), want)


def fused(pages, texts):
    """(page_id, posterior) by plain sums over lists of (page_id, url, html) and (lang, text)."""
    import html
    import math
    import re

    def grams(t):
        b = " ".join(t.lower().split()).encode()
        return collections.Counter((((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1) % 2**32) >> 19 for i in range(len(b) - 2))

    names = sorted({n for n, _ in texts if n})
    seen = {n: sum((grams(t or "") for m, t in texts if m == n), collections.Counter()) for n in names}
    total = {n: sum(seen[n].values()) + 0.5 * 8192 for n in names}
    rows = []
    for page_id, url, page in pages:
        c = grams(html.unescape(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", page or "")))
        n = sum(c.values())
        s = [sum(v * math.log((seen[x][g] + 0.5) / total[x]) for g, v in c.items()) * min(n, 60) / max(n, 1) for x in names]
        p = [math.exp(x - max(s)) for x in s]
        host = (re.match(r"[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", url or "") or [""] * 2)[1].lower()
        said = re.search(r"(?i)<html[^>]*?\s(?:xml:)?lang=['\"]?([a-z]+)", page or "") or re.search(r"(?i)<meta http-equiv='content-language' content='([a-z]+)", page or "")
        labels = host.split(".")
        rows.append((page_id, labels[-1], ".".join(labels[-2:]) if len(labels) > 1 else "", host, said[1].lower() if said else "", [x / sum(p) for x in p]))
    out = []
    for r, (page_id, tld, domain, host, said, p) in enumerate(rows):
        def level(above, same):
            others = [q[5] for j, q in enumerate(rows) if j != r and same(q)]
            return [(sum(q[i] for q in others) + 5 * a) / (len(others) + 5) for i, a in enumerate(above)]

        prior = level([1 / len(names)] * len(names), lambda q: True)
        country = {"de": "de", "fr": "fr", "uk": "en", "mx": "es"}.get(tld)
        if country in names:
            prior = [x * (0.7 if n == country else 0.3 / (len(names) - 1)) for x, n in zip(prior, names)]
            prior = [x / sum(prior) for x in prior]
        for at in (1, 2, 3):
            prior = level(prior, lambda q: q[1 : 1 + at] == (tld, domain, host)[:at])
        joint = [a * b for a, b in zip(p, prior)]
        if said in names:
            for i, n in enumerate(names):
                others = [q for j, q in enumerate(rows) if j != r and q[4] in names]
                here = sum(q[5][i] for q in others if q[4] == said)
                joint[i] *= (here + 5 * (0.85 if n == said else 0.15 / (len(names) - 1))) / (sum(q[5][i] for q in others) + 5)
        out.append((page_id, [x / sum(joint) for x in joint]))
    return out


def test_language_against_plain_sums(spark):
    r = random.Random(9)
    words = {"de": "der und ist nicht ein", "en": "the and is not a", "fr": "le et est pas un"}
    texts = [(n, " ".join(r.choice(w.split()) for _ in range(60))) for n, w in words.items()] + [(None, "x y z"), ("en", None)]
    pages = []
    for i in range(40):
        n = r.choice(list(words))
        body = " ".join(r.choice(words[n].split()) for _ in range(r.choice([0, 2, 8, 40])))
        head = r.choice(["<html>", f"<html lang='{n}'>", "<html xml:lang='fr'>", "<html lang=xx>", f"<html><meta http-equiv='content-language' content='{n}'>"])
        host = r.choice(["a.news.de", "b.news.de", "c.org", "shop.co.uk", "x.fr", ""])
        pages.append((i, f"https://{host}/p" if host else None, f"{head}<p>{body}&eacute;</p><script>der der</script>"))
    docs = spark.createDataFrame(texts, "lang string, text string")
    got = {x.page_id: x.posterior for x in language_id.classify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    want = dict(fused(pages, texts))
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    got = {r.page_id: r for r in language_id.classify(pages, docs).collect()}
    want = {r.page_id: r.url.split("/")[3] for r in pages.collect()}
    assert sum(got[p].lang == w for p, w in want.items()) >= 0.98 * len(want)
    odd = [(1, None, None), (2, "x", ""), (3, "https://a.example.de/", None), (4, "http://b.example.com", "<html lang='fr'>"), (5, "http://b.example.com", "<html lang='xx'><p>" + "the and of " * 9), (5, None, "<")]
    rows = spark.createDataFrame([(*r, 0) for r in odd], "page_id long, url string, html string, lang int")
    found = collections.defaultdict(list)
    for r in language_id.classify(rows, docs).collect():
        found[r.page_id].append(r.lang)
    assert found[3] == ["de"] and found[4] == ["fr"] and "en" in found[5] and sum(map(len, found.values())) == len(odd)
    assert language_id.classify(rows.limit(0), docs).collect() == []
    assert {r.lang for r in language_id.classify(rows, docs.limit(0)).collect()} == {None}
