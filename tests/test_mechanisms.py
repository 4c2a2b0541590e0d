"""Packages in ranges, exports in any case, and rules of the user."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lintel.operators import user_rules
from lintel.operators.lines import parse_lines
from lintel.sources import packages, readers
from lintel.sources.exports import Malformed, xml_objects


def export(k, head="<?xml version='1.0'?>\n"):
    return f"{head}<ExportFile><GXObject><Procedure/><Info><Name>P{k}</Name></Info><Events><![CDATA[&a = {k}]]></Events></GXObject></ExportFile>".encode()


def package(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)


def test_a_large_package_is_many_tasks(spark, tmp_path):
    members = [("folder/", b"")] + [(f"m{k:03d}.xml", export(k) + b"<!--" + os.urandom(300).hex().encode() + b"-->") for k in range(60)]
    package(tmp_path / "big.xpz", members)
    package(tmp_path / "small1.zip", [("a.xml", export(1000))])
    package(tmp_path / "small2.zip", [("b.xml", export(1001)), ("c.xml", b"<broken"), ("blank.xml", b" ")])
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    rows = packages.read_members(spark, str(tmp_path), splitBytes=4096)
    assert rows.rdd.getNumPartitions() >= 6
    tasks = rows.where(F.col("path").endswith("big.xpz")).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= 5
    got = {(r.path.rsplit("/", 1)[-1], r.ord): (r.member, bytes(r.content or b"")) for r in rows.collect() if r.error is None}
    assert {k: v for k, v in got.items() if k[0] == "big.xpz"} == {("big.xpz", k): (n, d) for k, (n, d) in enumerate(members[1:])}
    objects, failures = packages.read_package_objects(spark, str(tmp_path), splitBytes=4096)
    whole, lost = readers.read_objects(spark.read.format("binaryFile").load(f"{tmp_path}/big.xpz"))
    same = lambda df: sorted((r.id, r.member, r.text, r.code_start_line) for r in df.collect())
    assert same(objects.where(F.col("path").endswith("big.xpz"))) == same(whole) and lost.count() == 0
    assert sorted(r.error.split(":")[0] for r in failures.collect()) == ["malformed XML", "unreadable package"]
    assert objects.select("object_key").distinct().count() == objects.count() == 62


def test_filters_and_limits_of_members(spark, tmp_path):
    package(tmp_path / "p.zip", [(f"m{k}.xml", b"x" * (10 * k)) for k in range(8)])
    package(tmp_path / "q.zip", [("m3.xml", b"q")])
    rows = packages.read_members(spark, f"{tmp_path}/*.zip", splitBytes=1)
    one = rows.where((F.col("member") == "m3.xml") & F.col("path").endswith("p.zip"))
    assert [(r.ord, r.bytes) for r in one.collect()] == [(3, 30)]
    assert one.rdd.getNumPartitions() <= 8  # q.zip was not planned
    reader = packages.PackageReader({"path": f"{tmp_path}/*.zip"})
    rest = list(reader.pushFilters([packages.EqualTo(("member",), "m3.xml"), packages.EqualTo(("bytes",), 30), packages.StringEndsWith(("path",), "q.zip")]))
    assert [f.attribute for f in rest] == [("bytes",)] and len(reader.partitions()) == 1
    limited = packages.read_members(spark, f"{tmp_path}/p.zip", maxMembers=6, maxMemberBytes=40, maxExpandedBytes=70).orderBy("ord").collect()
    assert [(r.ord, r.error is None) for r in limited] == [(0, True), (1, True), (2, True), (3, True), (4, False), (5, False), (6, False), (7, False)]
    assert "of the package" in limited[4].error and "exceeds 40" in limited[5].error and "more than 6" in limited[6].error
    with pytest.raises(Exception, match="nowhere"):
        packages.read_members(spark, f"{tmp_path}/nowhere.zip").collect()


def test_exports_in_any_case():
    text = """<?xml version="1.0"?>
<exportfile><GXOBJECT><transaction/><INFO><x><name> Deep </name></x><Folder>F</Folder></INFO>
<documentation><source><![CDATA[no code]]></source><events><![CDATA[nor here]]></events></documentation>
<EVENTS><![CDATA[one
]]> between <![CDATA[two]]></EVENTS><rules><![CDATA[  ]]></rules>
<Subroutines>
<![CDATA[three]]></Subroutines></GXOBJECT><gxobject><A/></gxobject></exportfile>"""
    found, recognized = xml_objects(text, "stem")
    assert recognized == 2 and len(found) == 1
    x = found[0]
    assert (x["id"], x["object_type"], x["package"], x["text"]) == ("Deep", "transaction", "F", "one\ntwo\n\nthree")
    assert x["segments"] == [{"kind": "EVENTS", "text_start_line": 1, "member_start_line": 4}, {"kind": "Subroutines", "text_start_line": 4, "member_start_line": 7}]
    loose, none = xml_objects("<Thing NAME='n' Package='p'><events><![CDATA[e]]></events></Thing>")
    assert none == 0 and (loose[0]["id"], loose[0]["object_type"], loose[0]["package"]) == ("n", "Thing", "p")
    unnamed, _ = xml_objects("<E><GXObject><Rules><![CDATA[r]]></Rules></GXObject></E>", "stem")
    assert (unnamed[0]["id"], unnamed[0]["object_type"]) == ("stem", "Rules")
    with pytest.raises(Malformed):
        xml_objects("<a>")


def test_user_rules_of_all_kinds(spark):
    registry = user_rules.Registry()
    registry.line_rule("U.1", "WARNING", "No msg", F.col("clean_lower").startswith("msg("), F.concat(F.lit("mensaje: "), F.col("clean")))

    @registry.relation_rule("U.2", "INFO", "Long objects")
    def long(lines):
        return lines.groupBy("object_key").agg(F.max("line_no").cast("int").alias("line_number"), F.lit("largo").alias("description"), F.max_by("raw", "line_no").alias("line_content")).where("line_number > 2")

    @registry.stateful_rule("U.3", "ERROR", "Repeated lines")
    class Repeated(user_rules.Stateful):
        def __init__(self):
            self.seen = {}

        def line(self, number, raw, clean):
            if raw in self.seen:
                yield number, f"igual a {self.seen[raw]}", raw
            self.seen.setdefault(raw, number)

        def finish(self):
            yield 1, f"{len(self.seen)} distintas", ""

    texts = ["msg('a')\n&x = 1\n\n&x = 1", "one", "", "b\na\nb\na"]
    lines = parse_lines(spark.createDataFrame([(f"o{i}", t) for i, t in enumerate(texts)], "object_key string, text string").repartition(3))
    rows = registry.findings(lines).collect()
    got = sorted((r.rule_id, r.object_key, r.line_number, r.description, r.phase) for r in rows)
    assert got == [
        ("U.1", "o0", 1, "mensaje: msg()", 0), ("U.2", "o0", 4, "largo", 0), ("U.2", "o3", 4, "largo", 0), ("U.3", "o0", 1, "2 distintas", 1), ("U.3", "o0", 4, "igual a 2", 0),
        ("U.3", "o1", 1, "1 distintas", 1), ("U.3", "o3", 1, "2 distintas", 1), ("U.3", "o3", 3, "igual a 1", 0), ("U.3", "o3", 4, "igual a 2", 0),
    ]
    assert {r.severity for r in rows if r.rule_id == "U.3"} == {"ERROR"} and len({r.rule_ord for r in rows}) == 3
    assert {r.rule_id for r in registry.findings(lines, ["U.2"]).collect()} == {"U.2"}
    for wrong in (lambda: registry.findings(lines, ["U.9"]), lambda: registry.line_rule("U.1", "INFO", "x", F.lit(True), F.lit("")), lambda: registry.line_rule("GX.1.1", "INFO", "x", F.lit(True), F.lit("")), lambda: registry.line_rule("U.4", "BAD", "x", F.lit(True), F.lit(""))):
        with pytest.raises(ValueError):
            wrong()


def test_deep_pages_read_their_ranges(spark):
    import random

    from lintel.operators.rank_index import RankIndex

    rng = random.Random(2)
    rows = [(rng.randrange(50), i, f"x{i}") for i in range(2000)]
    index = RankIndex(spark.createDataFrame(rows, "a int, b int, t string").repartition(3), [F.col("a"), F.col("b")], ranges=8)
    want = sorted(rows)
    assert index.count() == 2000
    for offset, limit in ((0, 10), (995, 20), (1990, 50), (5000, 10), (0, 2000), (7, 0)):
        assert [tuple(r) for r in index.page(offset, limit).collect()] == [(offset + k, *r) for k, r in enumerate(want[offset : offset + limit])]
    assert sorted(tuple(r) for r in index.ranked().collect()) == [(k, *r) for k, r in enumerate(want)]
    page = index.page(1200, 10)
    assert 1 <= len({f.split("lintel_range=")[1].split("/")[0] for f in page.inputFiles()}) <= 8
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lintel_range" in plan or "PartitionFilters: [lintel_range" in plan
    page.collect()
    read = page._jdf.queryExecution().executedPlan().toString()
    assert len(index.ranges.where("before < 1210 and before + n > 1200").collect()) <= 2 and "lintel_range" in read
    empty = RankIndex(spark.createDataFrame([], "a int, b int, t string"), [F.col("a"), F.col("b")])
    assert empty.count() == 0 and empty.page(0, 5).collect() == []


def test_counters_come_with_the_run(spark):
    from lintel.plans import audit

    texts = ["&i = &i + 1\n//\n\nif &a\nendif", "clean"]
    rows = spark.createDataFrame([(f"o{i}", t, i) for i, t in enumerate(texts)], "object_key string, text string, ord long")
    one = audit.audit(rows, ["GX.1.7.2", "GX.2.7.2", "GX.1.5"]).counters
    assert (one["objects_extracted"], one["source_bytes"], one["lines_evaluated"], one["findings_emitted"]) == (2, sum(map(len, texts)), 5, 2)
    assert one["rule_evaluations"] == 5 + 2 + 2  # all lines; the two with & or =; the two with if (in endif too)
    assert one["first_finding_millis"] > 0 and one["fact_model_requests"] == 0 and one["rule_factory_invocations"] == 3
    two = audit.audit(rows, ["GX.2.7.5", "GX.SEC.3"]).counters
    assert (two["objects_extracted"], two["fact_model_requests"], two["project_objects"], two["findings_emitted"], two["first_finding_millis"]) == (2, 2, 2, 0, None)
    assert audit.audit(rows, ["GX.2.7.4"]).counters["lines_evaluated"] == 5
    assert audit.audit(rows, ["GX.SEC.2"]).counters["objects_extracted"] == 2


def test_snapshots_and_versions_of_the_history(spark, tmp_path):
    from lintel.operators import decisions
    from lintel.plans import audit
    from lintel.sources import store

    folder = f"file://{tmp_path}/history"
    rows = spark.createDataFrame([("o", "&i = &i + 1")], "object_key string, text string")
    result = audit.audit(rows, policy=decisions.Absolute(9, 9))
    # A folder of version 1: no log, no columns of later versions.
    one = spark.createDataFrame([(1, "Absolute", "complete", "pass", 1, 1, 0, 0)], "id long, policy string, completion string, verdict string, total_findings long, errors long, warnings long, info long")
    one.withColumn("started", F.current_timestamp()).write.parquet(f"{folder}/audit_runs")
    spark.createDataFrame([(1, 0, "GX.2.5", "ERROR", 3, "x", "d"), (7, 0, "GX.2.5", "ERROR", 3, "x", "died")], store._schema(store.ISSUE_COLUMNS, 1)).write.partitionBy("run_id").parquet(f"{folder}/audit_issues")
    history = store.History(spark, folder)
    assert [(r.id, r.verdict, r.snapshot, r.counters) for r in history.runs().collect()] == [(1, "pass", None, None)]
    assert [(r.run_id, r.description, r.object_key) for r in history.issues().collect()] == [(1, "d", None)]
    # Between a writer's two steps nobody sees its run, and a kept snapshot stays as it was.
    assert history.persist(result) == 2
    before = history.snapshot()
    token = history.written(result, 9)
    assert [r.id for r in history.runs().orderBy("id").collect()] == [1, 2] and history.issues().where("run_id = 9").count() == 0
    assert history.published(9, token, {"policy": "p", "completion": "complete", "verdict": "pass"}) == before + 1
    assert [r.id for r in history.runs().orderBy("id").collect()] == [1, 2, 9] and history.issues().where("run_id = 9").count() == history.issues().where("run_id = 2").count() > 0
    assert [r.id for r in history.runs(before).orderBy("id").collect()] == [1, 2] and history.issues(before).where("run_id = 9").count() == 0
    # Two writers with one number: the second takes the next.
    assert not history._placed(f"log/{before + 1:012d}.json", "{}")
    assert history.published(10, "none", {}) == before + 2
    history.written(result, 11)
    assert history.vacuum() == 1 and history.vacuum() == 0 and history.issues().where("run_id = 9").count() > 0
    assert '"findings_emitted"' in history.runs().where("id = 2").first().counters
    history.keep_newest(2, f"file://{tmp_path}/kept")
    assert [r.id for r in store.History(spark, f"file://{tmp_path}/kept").runs().orderBy("id").collect()] == [9, 10]


def test_a_second_run_computes_what_changed_and_its_callers(spark, tmp_path):
    from lintel.operators import project
    from lintel.operators.incremental import IncrementalProject

    texts = {
        "Top": "parm(in:&a)\ncall('Mid', &a, &r)\n&file.Open(&r)", "Mid": "parm(in:&p, out:&q)\n&q = Trim(&p)\ncall('Leaf', &p)", "Leaf": "parm(in:&x)\n&cmd.Shell(&x)",
        "Alone": "parm(in:&z)\n&sql.Execute(&z)", "Waits": "parm(in:&w)\ncall('Later', &w)",
    }

    def rows(t):
        return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(t.items())], "object_key string, text string, ord long")

    def findings(df):
        return sorted((r.object_key, r.line_number, r.description, r.confidence, tuple(map(tuple, r.trace))) for r in df.collect())

    store = IncrementalProject(spark, f"file://{tmp_path}/project")
    runs = [
        (texts | {"Leaf": "parm(in:&x)"}, (5, 5, 5)),
        (texts | {"Leaf": "parm(in:&x)"}, (5, 0, 0)),
        (texts | {"Later": "parm(in:&v)\n&html.Write(&v)"}, (6, 2, 5)),  # Leaf, Mid, Top; Later, which was called before it was there, Waits
        ({k: v for k, v in texts.items() if k != "Leaf"} | {"Mid": "parm(in:&p, out:&q)\n&q = 1"}, (4, 3, 3)),  # Leaf and Later are gone, Mid gives nothing back
    ]
    for k, (t, want) in enumerate(runs):
        found, cover, work = store.analyze(rows(t))
        assert (work.objects, work.changed, work.summarized) == want
        if k > 1:
            assert findings(found) == findings(project.analyze(rows(t), with_components=False)[0])
        assert cover.objects == len(t)


def test_profiles_come_from_a_file_or_the_store(spark, tmp_path):
    from lintel.plans.catalog import DEFAULT
    from lintel.sources.store import chosen_profile

    (tmp_path / "rules.csv").write_text(",1 Grupo,x,Error\n,1.1 Nombres,d,Advertencia\n,1.3 Bucles,d,Error\n,2.7.4 Sin uso,d,Error\n,9.9 Otra,d,Error\n,Porcentaje de Error,10,\n")
    csv = f"file://{tmp_path}/rules.csv"
    assert chosen_profile(spark, csv=csv) == ["GX.1.3", "GX.2.7.4"]  # 1.1 is off by default, 2.7.4 is not spoken of
    stored = spark.createDataFrame([("GX.1.1", True), ("GX.1", True), ("GX.2.5", False), ("GX.2.6", True)], "rule_id string, enabled boolean")
    assert chosen_profile(spark, rules=stored) == ["GX.1.1", "GX.2.6"]
    assert chosen_profile(spark, csv=csv, rules=stored, disable=["GX.1.3"]) == ["GX.2.7.4"]
    assert chosen_profile(spark, enable=["GX.2.5"], csv=csv) == ["GX.2.5"] and chosen_profile(spark) == list(DEFAULT)
    with pytest.raises(ValueError):
        chosen_profile(spark, rules=stored.where("not enabled"))


def test_callers_of_objects_with_the_same_outputs_keep_their_summaries(spark, tmp_path):
    from lintel.operators import project
    from lintel.operators.incremental import IncrementalProject

    texts = {
        "Top": "parm(in:&a)\ncall('Mid', &a, &r)\n&file.Open(&r)", "Mid": "parm(in:&p, out:&q)\n&q = Trim(&p)\ncall('Leaf', &p)", "Leaf": "parm(in:&x)\n&cmd.Shell(&x)", "Alone": "parm(in:&z)\n&sql.Execute(&z)",
    }

    def rows(t):
        return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(t.items())], "object_key string, text string, ord long")

    def findings(df):
        return sorted((r.object_key, r.line_number, r.description, r.confidence, tuple(map(tuple, r.trace))) for r in df.collect())

    store = IncrementalProject(spark, f"file://{tmp_path}/project")
    first = store.update(rows(texts | {"Leaf": "parm(in:&x)"}))
    assert (first.objects, first.changed, first.summarized) == (4, 4, 4)
    without = texts | {"Mid": "parm(in:&p)\n&q = 1"}
    for t, want in ((without, (4, 2, 3)), (texts, (4, 1, 2))):  # Leaf, Mid without its output, so Top; Mid with it, so Top again
        found, _, work = store.analyze(rows(t), by_outputs=True)
        assert (work.objects, work.changed, work.summarized) == want
        got = findings(found)
        assert any(f[:2] == ("top", 3) for f in got) == (t is texts)
    assert got == findings(project.analyze(rows(texts), with_components=False)[0])
    same = store.update(rows(texts | {"Leaf": "parm(in:&x)"}), by_outputs=True)
    assert (same.changed, same.summarized) == (1, 1)  # its callers pass it what they did


def test_places_of_findings_need_no_ways_there(spark, tmp_path):
    from lintel.operators import project
    from lintel.operators.incremental import IncrementalProject

    texts = {
        "Top": "parm(in:&a, out:&o)\ncall('Mid', &a, &r)\n&file.Open(&r)\n&o = &r", "Mid": "parm(in:&p, out:&q)\n&q = Trim(&p)\ncall('Leaf', &p)\ncall('Mid', &q, &p)", "Leaf": "parm(in:&x)\n&cmd.Shell(&x)\ncall('Gone', &x)",
        "Open": "if &a\nparm(in:&z)\n&sql.Execute(&z)", "Own": "&c = GetCookie('n')\n&html.Write(&c)\ncall('Open', &c)", "Idle": "parm(in:&u, out:&v)\n&v = 1\n&sql.Execute(&v)",
    }

    def rows(t):
        return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(t.items())], "object_key string, text string, ord long")

    columns = ["object_key", "line_number", "sink_class", "cwe"]
    want = sorted(map(tuple, project.analyze(rows(texts), with_components=False)[0].select(*columns).collect()))
    assert {w[:2] for w in want} == {("leaf", 2), ("top", 3), ("own", 2), ("open", 3)}
    store = IncrementalProject(spark, f"file://{tmp_path}/project")
    store.update(rows(texts | {"Mid": "parm(in:&p)"}))
    got = store.places(rows(texts), by_outputs=True)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want


def test_calls_of_lines_with_one_parenthesis_are_those_of_windows(spark):
    from lintel.operators import calls, semantics

    lines = ["call('p', &a, 'it''s')", "x)&b.Run(&A, \"q\")", "&r = Foo (&a", ") Foo(&a) + &b)", "1 (&a)", "if (&a)", "Foo()", "'('", "a.b.Load(&a", "&v.Foo(&w)", "Foo", "// Foo(&a)", "'x'.Foo(&a)", ".Foo(&a)"]
    model = semantics.model(spark.createDataFrame([("o", "\n".join(lines))], "object_key string, text string"))
    got = [tuple(map(str, r)) for r in calls.calls_in_lines(model).collect()]
    assert sorted(got) == sorted(tuple(map(str, r)) for r in calls._nested(model).collect()) and len(got) == 9
    assert sum("Window" in p for p in calls._single(model)._jdf.queryExecution().optimizedPlan().toString().split()) == 0


def test_objects_are_complete_by_their_blocks(spark):
    from lintel.operators import semantics

    texts = ["&a = 1", "", "if &a\n&b = 1\nendif", "if &a\n&b = 1", "endif\n&a = 1", "for each\nendif\nendfor", "do case\nif &a\nendif\nendcase\n&z = 2", "\r\n  \n// x"]
    model = semantics.model(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "object_key string, text string"))
    got = sorted(r.object_key for r in semantics.complete(model).collect())
    assert got == sorted(r.object_key for r in semantics.coverage(model).where("complete").collect()) == ["0", "2", "6"]
