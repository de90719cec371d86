"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@needs_data
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4


@needs_data
@pytest.mark.parametrize("name", ["xray_lineitem_basic", "xray_nulls", "histogram_price", "mad", "outliers_zscore", "corr_matrix_spearman", "category_top_bottom", "drop_missing_rows_thresh", "data_cleaning_full", "usability", "ks_uniform_stat"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    wanted = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    out = e.queries()[name](spark, SF)
    assert sorted(out.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain([tuple(r[n] for n in names) for r in out.collect()]) == plain(wanted.fetchall())


def test_the_rest_works_without_the_optional_part(tmp_path):
    for name in ("tabulith", "__spark_entry__.py"):
        source = f"{ROOT}/{name}"
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 40; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
