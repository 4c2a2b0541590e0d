"""Registered queries against their SQL, on the smallest test tables where these are at hand."""

import datetime
import decimal
import os

import pytest

from lintel import queries, queries_sources, queries_taint

FOLDER = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "events", "orders", "pages", "part")
NEW = sorted(n for n, f in queries.QUERIES.items() if n in queries.ORACLE_SQL and f.__module__ in (queries_sources.__name__, queries_taint.__name__))


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", [*NEW, "statement_parents"])
def test_query_is_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    rows = sorted(tuple(_plain(v) for v in r) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(_plain(v) for v in r) for r in want)


def test_caps_deal_out_what_is_left(spark):
    from lintel.operators import paging

    counts = spark.createDataFrame([(0, 5), (1, 0), (2, 9), (3, 1), (4, 7), (5, 50)], "file_idx long, n long")
    for most, want in ((100, None), (12, {0: 3, 2: 3, 3: 1, 4: 2, 5: 2}), (1, {0: 1}), (4, {0: 1, 2: 1, 3: 1, 4: 1})):
        kept, cut = paging.chunk_quotas(counts, most, chunk=4)
        kept = {r.file_idx: r.kept for r in kept.collect()}
        total, expected, limited = 0, {}, False
        files = [(0, 5), (1, 0), (2, 9), (3, 1), (4, 7), (5, 50)]
        for c in range(0, 6, 4):
            if total >= most:
                limited = True
                break
            quota = max((most - total) // len(files[c : c + 4]), 1)
            for i, n in files[c : c + 4]:
                k = min(n, quota, most - total)
                limited |= k < n
                if k:
                    expected[i] = k
                total += k
        assert kept == expected and cut == limited and (want is None or kept == want)


def test_content_cache_computes_each_text_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from lintel.sources import store

    cache, asked = store.ContentCache(spark, f"file://{tmp_path}/cache", "long"), []

    def lengths(texts):
        asked.append(texts.count())
        return texts.select("content", F.length("text").cast("long").alias("value"))

    objects = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abc"), (4, None)], "object_key long, text string")
    assert sorted((r.object_key, r.value) for r in cache.of(objects, "k", lengths).collect()) == [(1, 2), (2, 2), (3, 3), (4, 0)]
    more = objects.union(spark.createDataFrame([(5, "new")], objects.schema))
    assert cache.of(more, "k", lengths).count() == 5
    assert cache.of(more, "other", lengths).count() == 5
    assert asked == [3, 1, 4]


def test_lookup_never_takes_one_of_several(spark):
    from lintel.sources import planning

    rows = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "c")], "member string, id string")
    assert [r.id for r in planning.looked_up(rows, "m", "b").collect()] == ["b"]
    assert planning.looked_up(rows, "m", "x").count() == 0
    assert planning.looked_up(rows, "m", "").count() == 0
    assert [r.id for r in planning.looked_up(rows, "n", "").collect()] == ["c"]


def test_declared_paths(spark, tmp_path):
    from lintel.sources import planning

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("x")
    got = planning.described(spark, [f"{tmp_path}/d/", f"{tmp_path}/d/a.txt", f"{tmp_path}/none", " "])
    assert [r.kind for r in got.orderBy("ordinal").collect()] == ["directory", "file", "missing", "missing"]


def test_deadline_cuts_a_job_off(spark):
    from pyspark.sql import functions as F

    from lintel.plans.audit import with_deadline

    assert with_deadline(spark, 60, lambda: spark.range(10).count()) == (10, False)
    slow = F.udf(lambda x: __import__("time").sleep(30), "string")
    assert with_deadline(spark, 3, lambda: spark.range(2).select(slow("id")).collect()) == (None, True)
    with pytest.raises(ValueError):
        with_deadline(spark, 60, lambda: int("x"))


def test_source_files_leave_others_unread(spark, tmp_path):
    from lintel.sources import discovery

    for name in ("a.TXT", "b.md", "c.Xml", "d.zip", "txt"):
        (tmp_path / name).write_text("x")
    assert {r.path.rsplit("/", 1)[-1] for r in discovery.source_files(spark, str(tmp_path)).select("path").collect()} == {"a.TXT", "c.Xml", "d.zip"}
    assert discovery.list_paths(spark, str(tmp_path)).count() == 5


def test_two_writers_claim_two_runs(spark, tmp_path):
    from lintel.sources.store import History

    history = History(spark, f"file://{tmp_path}/history")
    assert [history._claimed() for _ in range(3)] == [1, 2, 3]
