"""Language of web pages by Bayesian evidence fusion (operator 5).

Likelihoods of the visible text (byte trigrams, trained on the labelled documents) and of the declared language are
multiplied with a prior of the page's host. Host priors are soft counts of all other pages' text posteriors, by grouped
aggregation, smoothed towards the registered domain, that towards the address suffix and that towards all pages as the
suffix's country turns them: a suffix counts once. How far a declaration can be trusted is counted likewise, by declared
and found language.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import table, text_or_empty, trimmed, written

#: Buckets of hashed trigrams; trigrams of a text that count in full, longer texts being no more certain.
BUCKETS, FULL = 8192, 60.0
#: Chance that a declared language and a country suffix are right before pages are counted, and the pages that this, or
#: a level's parent, counts for.
DECLARED, SUFFIX, WEIGHT = 0.85, 0.7, 5.0
#: Country suffixes by main language (fixed values).
SUFFIXES = {
    "ar": "ae bh dz eg iq jo kw lb ly ma om qa sa sy tn ye", "bg": "bg", "cs": "cz", "da": "dk", "de": "at de li", "el": "cy gr", "en": "au ie nz uk us", "es": "ar bo cl co cr cu do ec es gt hn mx ni pa pe py sv uy ve",
    "et": "ee", "fa": "ir", "fi": "fi", "fr": "bj ci cm fr ga mc ml sn tg", "he": "il", "hi": "in", "hr": "hr", "hu": "hu", "id": "id", "is": "is", "it": "it sm va", "ja": "jp", "ko": "kr", "lt": "lt", "lv": "lv", "ms": "my",
    "nl": "nl sr", "no": "no", "pl": "pl", "pt": "ao br mz pt", "ro": "md ro", "ru": "by kz ru su", "sk": "sk", "sl": "si", "sr": "rs", "sv": "se", "th": "th", "tr": "tr", "uk": "ua", "vi": "vn", "zh": "cn hk tw",
}
COUNTRIES = {tld: lang for lang, tlds in SUFFIXES.items() for tld in tlds.split()}
#: Where a page declares its language, the first that does counts.
_DECLARATIONS = (
    r"(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]+)",
    r"(?i)<meta\b[^>]*?(?:http-equiv|name)\s*=\s*[\"']?(?:content-)?language\b[^>]*?\scontent\s*=\s*[\"']?([A-Za-z]+)",
    r"(?i)<meta\b[^>]*?\scontent\s*=\s*[\"']?([A-Za-z]+)[^>]*?(?:http-equiv|name)\s*=\s*[\"']?(?:content-)?language\b",
)

_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.DOTALL | re.IGNORECASE)


def trigrams(text: str) -> np.ndarray:
    b = np.frombuffer(" ".join(text.lower().split()).encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return np.bincount(h >> np.uint32(32 - 13), minlength=BUCKETS).astype(float)


def visible(page: str) -> str:
    return html.unescape(_HIDDEN.sub(" ", page))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, t in zip(batch["lang"].to_pylist(), batch["text"]):
            sums[lang] = sums.get(lang, 0) + trigrams(t.as_py() or "")
    for lang, c in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * BUCKETS), pa.array(np.arange(BUCKETS), pa.int32()), pa.array(c)], names=["lang", "at", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log chances of each bucket: BUCKETS numbers per language reach the driver. Null languages don't count."""
    rows = docs.filter(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(trimmed(_counted), "lang string, at int, n double")
    got = rows.filter("n > 0").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in got})
    c = np.full((len(names), BUCKETS), 0.5)
    for r in got:
        c[names.index(r["lang"]), r["at"]] += r["n"]
    return names, np.log(c / c.sum(axis=1, keepdims=True))


def _text_posteriors(names: list[str], model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch["html"]:
                c = trigrams(visible(t.as_py() or ""))
                n = c.sum()
                s = model @ c * (min(n, FULL) / max(n, 1))
                p = np.exp(s - s.max(initial=-np.inf)) if len(names) else s
                out.append((p / p.sum()).tolist() if len(names) else [])
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in ("page_id", "host", "domain", "tld", "declared")), pa.array(out, pa.list_(pa.float64()))], names=["page_id", "host", "domain", "tld", "declared", "p"])

    return run


def _address(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain and last label, empty where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"([^.]+)$", 1)


def _level(pages: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    return pages.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias(f"c_{name}"))


def classify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host, posterior array) for each row of ``pages``.

    ``posterior`` follows the languages of ``docs`` in code point order. A null or empty page says nothing, so that the
    other evidence decides; a null or odd url has an empty host, which is a host like others; a declared language that
    isn't among those known says nothing. Of equal chances the first language counts. Repeated rows are pages of their
    own. Without labelled documents lang is null. Other columns aren't read. An empty table gives an empty one.
    """
    names, model = train(docs)
    k = len(names)
    host, domain, tld = _address(text_or_empty("url"))
    declared = F.lower(F.coalesce(*[F.nullif(F.regexp_extract(text_or_empty("html"), d, 1), F.lit("")) for d in _DECLARATIONS], F.lit("")))
    asked = pages.select("page_id", host.alias("host"), domain.alias("domain"), tld.alias("tld"), declared.alias("declared"), "html")
    own = asked.mapInArrow(trimmed(_text_posteriors(names, model)), "page_id long, host string, domain string, tld string, declared string, p array<double>")
    if not k:
        return own.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", F.col("p").alias("posterior"))
    own = written(own, "text-posteriors")
    hosts = _level(own, ["tld", "domain", "host"], k, "host")
    hosts = written(hosts, "hosts")
    domains = _above(hosts, "domain", ["tld", "domain"], "host", k)
    tlds = _above(domains, "tld", ["tld"], "domain", k)
    every = _above(tlds, "all", [], "tld", k).first()
    chain = hosts.join(domains, ["tld", "domain"]).join(tlds, "tld")
    known = own.join(chain, ["tld", "domain", "host"])
    known = known.withColumns({"n_all": F.lit(every["n_all"] or 0), "c_all": F.array(*[F.lit(float(x or 0)) for x in every["c_all"]])})
    prior = _smoothed("all", F.array(*[F.lit(1.0 / k)] * k))
    country = F.coalesce(F.create_map(*[F.lit(y) for x in COUNTRIES.items() for y in x])[F.col("tld")], F.lit(""))
    suffix = F.array(*[F.when(~country.isin(names), 1.0).when(country == x, SUFFIX).otherwise((1 - SUFFIX) / max(1, k - 1)) for x in names])
    known = known.withColumn("above", F.zip_with(prior, suffix, lambda x, y: x * y))
    prior = F.transform("above", lambda x: x / F.aggregate("above", F.lit(0.0), lambda a, y: a + y))
    for level in ("tld", "domain", "host"):
        prior = _smoothed(level, prior)
    fused = known.withColumns({"prior": prior, "said": _declaration(own, names)})
    fused = fused.withColumn("joint", F.array(*[F.col("p")[i] * F.col("prior")[i] * F.col("said")[i] for i in range(k)]))
    total = F.aggregate("joint", F.lit(0.0), lambda a, x: a + x)
    fused = fused.withColumn("posterior", F.transform("joint", lambda x: x / total))
    label = lambda c: F.element_at(F.array(*map(F.lit, names)), F.array_position(c, F.array_max(c)).cast("int"))
    return fused.select("page_id", label(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), label(F.col("p")).alias("text_lang"), "declared", "host", "posterior")


def _declaration(pages: DataFrame, names: list[str]) -> Column:
    """Chance of a page's declared language given each language: soft counts of all other pages, drawn towards DECLARED.

    A row per known language reaches the driver.
    """
    k = len(names)
    rows = pages.filter(F.col("declared").isin(names)).groupBy("declared").agg(*[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(k)]).collect()
    counts = {r["declared"]: [r[f"c{i}"] for i in range(k)] for r in rows}
    every = [sum(c[i] for c in counts.values()) for i in range(k)]
    base = lambda d, i: DECLARED if d == names[i] else (1 - DECLARED) / max(1, k - 1)
    chance = lambda d, i: (F.greatest(F.lit(c[i]) - F.col("p")[i], F.lit(0.0)) + WEIGHT * base(d, i)) / (F.greatest(F.lit(every[i]) - F.col("p")[i], F.lit(0.0)) + WEIGHT)
    said = F.lit(None).cast("array<double>")
    for d, c in sorted(counts.items()):
        said = F.when(F.col("declared") == d, F.array(*[chance(d, i) for i in range(k)])).otherwise(said)
    return F.coalesce(said, F.array(*[F.lit(1.0)] * k))


def _smoothed(level: str, above: Column) -> Column:
    """A level's share of each language without the page's own, drawn towards the level above."""
    n, three = F.col(f"n_{level}"), F.arrays_zip(F.col(f"c_{level}").alias("c"), F.col("p").alias("p"), above.alias("q"))
    return F.transform(three, lambda x: (F.greatest(x["c"] - x["p"], F.lit(0.0)) + WEIGHT * x["q"]) / (n - 1 + WEIGHT))


def _above(below: DataFrame, name: str, keys: list[str], up: str, k: int) -> DataFrame:
    """The level above: sums of counts and of soft counts of the level below."""
    return below.groupBy(*keys).agg(F.sum(f"n_{up}").alias(f"n_{name}"), F.array(*[F.sum(F.col(f"c_{up}")[i]) for i in range(k)]).alias(f"c_{name}"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select("page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "host")
