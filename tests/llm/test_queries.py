"""The registered queries and the pipeline on the smallest driver tables."""

import collections
import hashlib
import os
import re

import pytest
from tabulith.llm import decontam, queries
from tabulith.llm.common import materialize, shared_dir

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_gives_a_row_for_each_row(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table = {"op5_url_filters": "pages", "op11_warc": "pages"}.get(name, "documents")
    if name not in ("op4_token_counts", "op13_variants"):
        assert out.count() == queries.table(spark, SF, table).count()
    else:
        assert out.count() > 0


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    out = queries.QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in out.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def test_pipeline_stage_by_stage(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    rows = docs.collect()
    seen = [rows]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "test")
        if k < 4:
            assert docs.columns == columns
        seen.append(docs.collect())
    text = [{r["doc_id"]: r["text"] for r in part} for part in seen[:5]]
    quality = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op2_quality"](spark, SF).collect()}
    assert set(text[1]) == {i for i in text[0] if quality[i]}
    # one document of each group, no two near copies left
    assert len(text[2]) == len(seen[2]) < len(text[1])
    # no string of 100 bytes stands twice
    windows = collections.Counter(t.encode()[s : s + 100] for t in text[3].values() for s in range(len(t.encode()) - 99))
    before = collections.Counter(t.encode()[s : s + 100] for t in text[2].values() for s in range(len(t.encode()) - 99))
    assert set(text[3]) == set(text[2]) and sum(v > 1 for v in windows.values()) < max(1, 0.02 * sum(v > 1 for v in before.values()))
    hit = {r["doc_id"]: r["contaminated"] for r in decontam.report(decontam.scan(spark.createDataFrame(list(text[3].items()), "doc_id long, text string"), queries.table(spark, SF, "benchmark"))).collect()}
    assert set(text[4]) == {i for i in text[3] if not hit[i]}
    assert {r["doc_id"]: r["decoded_sha256"] for r in seen[5]} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in text[4].items()}


def test_run_equals_the_stages(spark):
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_and_empty_tables(spark, odd, nothing):
    frame, rows = odd
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
        assert stage(spark, frame, SF).count() <= len(rows)


def test_run_takes_odd_rows(spark, odd, tmp_path):
    frame, rows = odd
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1), (5, None, None), (5, 1, 1), (7, 9, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", None), (None, "one two three"), ("c", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < len(rows)
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tabulith.llm import common

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
