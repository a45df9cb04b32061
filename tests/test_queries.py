"""Every query of the chunking engine against its SQL, and the entry points."""

import ast
import os
import pathlib

import duckdb
import pytest

import verify
from quernstone.plans import queries

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in verify.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(verify.canon(r[c]) for c in cols) for r in df.collect())
    assert len(set(cols)) == len(df.columns)
    if name in queries.ORACLES:
        rel = con.execute(queries.ORACLES[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(verify.canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    else:
        assert rows


@pytest.mark.parametrize("name", ["quality_evaluation", "quality_report"])
def test_measures_on_the_thresholds_of_advice(spark, tmp_path, name):
    words = " ".join("abcdefghijklmnopqrst"[i % 20] for i in range(35))  # 20 of 35: density 0.4
    parts = ["word" * 125 + "……", "短。" + "word" * 125 + "。", "短。" + "text" * 125 + "。"]  # completeness 0.5, 0.8, 0.8
    spark.createDataFrame([(1, words), (2, "\n".join(parts))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES[name](spark, str(tmp_path))
    rel = duckdb.connect().execute(queries.ORACLES[name].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(verify.canon(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(verify.canon, r)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "quernstone").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(os.sep)[0].split(".") for n in names), path
