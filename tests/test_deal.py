"""Tasks have a bounded share of what is made of the rows, however short the rows are."""

from pyspark.sql import functions as F

from lintel import queries as q
from lintel.operators import deal, project, taint
from lintel.plans import corpus
from lintel.sources import packages, readers

SF = "/root/testdata/sf0.001"


def _tasks(df):
    return df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()


def test_lines_come_in_shares_of_text(spark, monkeypatch):
    monkeypatch.setattr(deal, "TEXT_BYTES", 500)
    text = corpus.event_objects(spark, SF).agg(F.sum(F.octet_length("text"))).first()[0]
    objects = deal.by_text(corpus.event_objects(spark, SF))
    assert objects.rdd.getNumPartitions() == -(-text // 500) and objects.count() == objects.select("object_key").distinct().count()
    # No lines but those of the rows' own exchange: what adaptive execution reads is not merged.
    assert len(_tasks(q._lines(spark, SF))) > 4 and len(_tasks(q.default_findings(spark, SF))) > 4
    assert deal.by_text(objects.where("false")).count() == 0


def test_files_come_in_shares_of_rows(spark, monkeypatch):
    monkeypatch.setattr(deal, "ROWS", 10)
    files = corpus.xml_files(spark, SF)
    assert len(_tasks(files)) > 4 and len(_tasks(readers.read_objects(files)[0])) > 4
    monkeypatch.setattr(readers, "BATCH_ROWS", 3)
    assert readers.read_objects(files)[0].count() == readers.read_objects(files)[0].select("path").distinct().count()


def test_ranges_of_members_share_partitions_beyond_a_number(monkeypatch):
    ranges = [packages.Members([(f"p{i // 5}", i % 5 * 20, i % 5 * 20 + 20)]) for i in range(100)] + [packages.Members([("small", 0, None), ("last", 0, None)])]
    assert packages._shared(ranges) == ranges
    monkeypatch.setattr(packages, "PARTITIONS", 10)
    got = packages._shared(ranges)
    read = [(p, k) for m in got for p, a, b in m.parts for k in (range(a, b) if b else [None])]
    assert len(got) == 10 and read == [(f"p{i // 5}", i % 5 * 20 + k) for i in range(100) for k in range(20)] + [("small", None), ("last", None)]
    assert sum(len(m.parts) for m in got) < 40


def test_param_outs_needs_no_traces(spark, monkeypatch):
    want = {tuple(r) for r in project.summarize(corpus.chain_objects(spark, SF).where("object_key < 20")).param_outs.collect()}

    def none(*_):
        raise AssertionError("traces are not asked for")

    monkeypatch.setattr(taint, "traces", none)
    monkeypatch.setattr(corpus, "chain_objects", lambda spark, sf_dir, made=corpus.chain_objects: made(spark, sf_dir).where("object_key < 20"))
    assert {tuple(r) for r in q.QUERIES["param_outs"](spark, SF).collect()} == want and want


def test_rule_2_7_3_holds_no_object_in_each_row(spark):
    """A list of an object's hits in each of its lines would be a thousand MB here."""
    from lintel.operators.lines import parse_lines
    from lintel.operators.rules import CONDITIONS, line_findings

    n = 6_000
    lines = [f"{CONDITIONS[(i // 7 if i < 300 else i) % 5]} = {CONDITIONS[i * i % 5]} = 1" if i % 3 else f"{CONDITIONS[-(i // 40) % 5]} += 1" for i in range(n)]
    seen, want = set(), []
    for i, line in enumerate(lines):
        met = [v for v in CONDITIONS if line.find(v) >= 0 and line[line.find(v) + len(v) :].lstrip().startswith(("=", "+=")) and not line[line.find(v) + len(v) :].lstrip().startswith("==")]
        hit = next((v for v in met if v in seen), None)
        seen.update(met if hit is None else met[: met.index(hit)])
        want += [(i + 1, hit)] if hit else []
    objects = spark.createDataFrame([(1, "\n".join(lines))], "object_key long, text string")
    found = line_findings(parse_lines(objects), ["GX.2.7.3", "GX.2.5", "GX.1.3"]).where("rule_id = 'GX.2.7.3'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(r273" not in plan
    got = sorted((r.line_number, r.emit_line, r.line_content, next(v for v in sorted(CONDITIONS, key=len, reverse=True) if v in r.description)) for r in found.collect())
    assert got == [(i, i, lines[i - 1], v) for i, v in want] and len(want) > n - 100
