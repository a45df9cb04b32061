"""python -m quernstone FILES: chunks files, prints statistics and a preview, writes JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quernstone.config import ChunkConfig
from quernstone.operators.quality import evaluate, preview, report, statistics
from quernstone.plans.pipeline import Chunker
from quernstone.sources.sinks import save_json


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quernstone")
    ap.add_argument("path", help="a file or folder")
    ap.add_argument("--out", help="folder for JSON; default: PATH.chunks.json")
    ap.add_argument("--preset")
    for name, kind, value in (("min-size", int, 200), ("max-size", int, 1500), ("target-size", int, 800), ("overlap", float, 0.1), ("threshold", float, 0.7)):
        ap.add_argument(f"--{name}", type=kind, default=value)
    ap.add_argument("--language", choices=("zh", "en"), default="zh")
    ap.add_argument("--mode", default="greedy")
    ap.add_argument("--preserve-structure", action="store_true")
    ap.add_argument("--stats", action="store_true")
    ap.add_argument("--preview", type=int, default=0)
    ap.add_argument("--report", action="store_true")
    a = ap.parse_args(argv)
    cfg = ChunkConfig.preset(a.preset) if a.preset else ChunkConfig(a.min_size, a.max_size, a.target_size, a.overlap, a.threshold, language=a.language, preserve_structure=a.preserve_structure)
    spark = SparkSession.builder.getOrCreate()
    chunks = Chunker(cfg, a.mode).files(spark, a.path).cache()
    if a.stats:
        statistics(chunks).show(vertical=True)
    if a.preview:
        preview(chunks, a.preview).show(truncate=False)
    if a.report:
        for r in report(evaluate(chunks)).toLocalIterator():
            print(r["report"])
    save_json(chunks, a.out or f"{a.path.rstrip('/')}.chunks.json", cfg)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
