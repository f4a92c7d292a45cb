import os

import duckdb
import pytest

import __spark_entry__
from tallyweave.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["cm_topk", "count_topk", "hll_estimate", "dd_permille", "cm_change", "cm_periodic", "spread_periodic_live", "count_change_kernel", "accuracy_cm"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(tuple(map(float, r)) for r in d[cols].itertuples(index=False))
    assert key(got) == key(want)


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0


def test_a_broken_subpackage_is_not_passed_over(tmp_path):
    """Only a missing subpackage is: its queries go, the others stay."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tallyweave", tmp_path / "tallyweave", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    names = [sys.executable, "-B", "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), 'cm_topk' in e.oracle_sql())"]
    run = lambda: subprocess.run(names, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    shutil.rmtree(tmp_path / "tallyweave" / "llm", ignore_errors=True)
    assert run().stdout.split() == ["0", "True"]
    (tmp_path / "tallyweave" / "llm").mkdir()
    (tmp_path / "tallyweave" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert run().returncode != 0
