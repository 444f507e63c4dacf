"""Each registered query against its SQL on small tables, and the entry points without the llm subpackage."""

import subprocess
import sys

import duckdb
import pytest

from veilspan.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return made


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: str(list(v)) if hasattr(v, "__iter__") and not isinstance(v, str) else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_points_without_the_llm_subpackage(tmp_path):
    code = f"""
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("veilspan.llm", "corpus_pipeline"): raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone()); sys.path.insert(0, {str(__import__('pathlib').Path(__file__).parents[2])!r})
import __spark_entry__ as e
assert "detect_documents" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
