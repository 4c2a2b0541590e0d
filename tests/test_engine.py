"""Rules, model, flows, decisions, sources and sinks of the engine."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lintel.functions import lexical as x
from lintel.operators import decisions, paging, project, semantics
from lintel.operators.lines import parse_lines, split_lines
from lintel.operators.calls import calls_in_lines
from lintel.operators.graph import strong_components
from lintel.operators.taint import local_taint
from lintel.plans import audit
from lintel.plans.catalog import CONCRETE, DEFAULT, RULES, profile
from lintel.sources import discovery, readers, reports, store

#: One rule enabled: (rule, text that it finds, text that it does not).
CASES = [
    ("GX.1.1", "&myvar = 1", "&Myvar = 1"),
    ("GX.1.2", "for each Customer\n&x = 1\nendfor", "for each Customer\n    &x = 1\nendfor"),
    ("GX.1.3", "for each\nendfor // Customer", "for each Customer\nwhere Att1 = &v\ndefined by idx1\nendfor // Customer"),
    ("GX.1.3", "for each Customer\nwhere Att1 = &v\nendfor // Customer", "for each Customer\nendfor // Customer"),
    ("GX.1.3", "for each Customer\nendfor", "for each Customer\nendfor Customer"),
    ("GX.1.3.1", "for each Customer\n&x = 1\nendfor", "for each Customer\n    &x = 1\nendfor"),
    ("GX.1.3.2", "if &a = 1\n    &x = 2\nendif", "if &a = 1\n    &x = 2\nelse\n    &x = 3\nendif"),
    ("GX.1.3.2", "if &a = 1\nif &b = 1\nelse\nendif\nendif", "if &a = 1\nif &b = 1\nelse\nendif\nelse\nendif"),
    ("GX.1.3.3", "do case\ncase &a = 1\nendcase", "do case\ncase &a = 1\notherwise\nendcase"),
    ("GX.1.4.1", "&data = 1\n" + "// x\n" * 16 + "&data = 2", "&data = 1\n&y = 1\n&data = 2"),
    ("GX.1.4.1", "&data = 1\n" + "// x\n" * 16 + "&data = 2", "&ok = 1\n" + "// x\n" * 16 + "&ok = 2"),
    ("GX.1.4.2", "if CustomerId = 1\nendif", "if &CustomerId = 1\nendif"),
    ("GX.1.4.3", "parm(&ClientId, out:&Name)", "parm(in:&ClientId, out:&Name)"),
    ("GX.1.4.3", "parm(&ClientId,\n  out:&Name)", "parm(in:&ClientId,\n  out:&Name)"),
    ("GX.1.5", "if &a = 1 and &b = 2 and &c = 3 and &d = 4", "if &a = 1 and &b = 2"),
    ("GX.1.6.1", "&x = 1\ndo 'Proc'", "// says why\ndo 'Proc'"),
    ("GX.1.6.1", "do 'Proc'", "do case"),
    ("GX.1.6.2", "sub 'X'\n    &y = 1\nendsub", "sub 'X'\n    // says what\nendsub"),
    ("GX.1.7.1", "&x = 1", "rules:\n// CODIGO INICIATIVA: 1\n// DESCRIPCION: d\n// RESPONSIBLE: r\n// VERSION: 1"),
    ("GX.1.7.2", "// ====", "// says something"),
    ("GX.1.7.2", "//", "// = b"),
    ("GX.2.1", "for each C\nwhere A = &b when &x = 1\nendfor", "for each C\nwhere A = &b\nendfor"),
    ("GX.2.1", "for each C\nwhere A = &b\nwhen &x = 1\nendfor", "where A = &b when &x = 1"),
    ("GX.2.2", "for each C\nwhere A = &a or A = &b\nendfor", "for each C\nwhere A between &a and &b\nendfor"),
    ("GX.2.3", "for each A\nfor each B\nfor each C\nendfor\nendfor\nendfor", "for each A\nfor each B\nendfor\nfor each C\nendfor\nendfor"),
    ("GX.2.4", "for each C\nwhere upper(A) = &v\nendfor", "for each C\nwhere A = &v.Trim()\nendfor"),
    ("GX.2.5", "for each C\nwhere A = 1\nendfor", "for each C\nwhere A = &id\nendfor"),
    ("GX.2.6", "sub 'X'\n&y = 1\nendsub", "sub 'X'\n&y = nullvalue(0)\nendsub"),
    ("GX.2.7.1", "do while &i < 10\nenddo", "do while &Index < 10\nenddo"),
    ("GX.2.7.2", "&i = &i + 1", "&Counter = &Counter + 1"),
    ("GX.2.7.3", "&ok = true\n&ok = false", "&ok = true"),
    ("GX.2.7.4", "&UnusedData = 1", "&Data = 1\n&y = &Data\nmsg(&y)"),
    ("GX.2.7.5", "&x = 1\n&x = 2\n&y = &x", "&x = 1\n&y = &x\n&x = &x + 1"),
    ("GX.SEC.1", "&password = 'S3cr3t!'", "&password = 'changeme'\n&tokenCount = 1\n&password = ''\n&password = &p"),
    ("GX.SEC.2", "parm(in:&Filtro)\n&sql = 'select ' + &Filtro\n&Result = &sql.Execute()", "parm(out:&Filtro)\n&sql = 'select ' + &Filtro\n&Result = &sql.Execute()"),
]


def objects(spark, texts):
    return spark.createDataFrame([(f"o{i}", t, i) for i, t in enumerate(texts)], "object_key string, text string, ord long")


def test_every_rule_finds_and_leaves_alone(spark):
    ids = [i for i in CONCRETE if i != "GX.SEC.3"]
    assert {c[0] for c in CASES} == set(ids)
    texts = [t for _, bad, good in CASES for t in (bad, good)]
    found = {(r.object_key, r.rule_id) for r in audit.findings(objects(spark, texts), ids).select("object_key", "rule_id").collect()}
    wrong = [(rule, k) for k, (rule, _, _) in enumerate(CASES) if (f"o{2 * k}", rule) not in found or (f"o{2 * k + 1}", rule) in found]
    assert not wrong


def test_one_exchange_for_all_line_rules(spark, capsys):
    found = audit.line_findings(parse_lines(objects(spark, ["&x = 1"])), ["GX.1.3", "GX.2.3", "GX.2.5", "GX.1.4.3"])
    found.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_catalogue():
    assert len(RULES) == 34 and len(CONCRETE) == 28 and len(DEFAULT) == 15
    assert profile(disable=["GX.2.5"]) == [r for r in DEFAULT if r != "GX.2.5"]
    for bad in ({"enable": ["GX.9"]}, {"enable": ["GX.1"]}, {"enable": ["GX.1.1", "GX.1.1"]}):
        with pytest.raises(ValueError):
            profile(**bad)


def _mask(text):
    """Block comments outside strings as spaces, character by character."""
    out, i, mode = list(text), 0, ""
    while i < len(text):
        c = text[i]
        if mode in ("'", '"'):
            if c == mode:
                if text[i + 1 : i + 2] == mode:
                    i += 1
                else:
                    mode = ""
        elif c in ("'", '"'):
            mode = c
        elif text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                break
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end >= 0:
                for j in range(i, end + 2):
                    out[j] = out[j] if out[j] in "\r\n" else " "
                i = end + 1
        i += 1
    return "".join(out)


def test_masking_is_the_scanner(spark):
    import random

    rng = random.Random(1)
    symbols = ["'", '"', "/", "*", "\\", "\n", "\r", "\t", " ", "a", "Z", "&", "=", "_", "0", "á", "€", "//", "/*", "*/"]
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randrange(120))) for _ in range(1500)]
    rows = objects(spark, texts).select("ord", x.mask_blocks(F.col("text")).alias("m"), x.clean(F.col("text")).alias("c")).collect()
    for r in rows:
        assert r.m == _mask(texts[r.ord])
        assert len(r.c) <= len(texts[r.ord])


def test_lines_are_numbered_and_cut(spark):
    lines = parse_lines(objects(spark, ["a\r\n\n  b // c\n/* x\ny */ &z = '/*'\nGenerated Subroutines (PUBLIC)\nq", ""]))
    got = [(r.line_no, r.raw, r.clean, r.code) for r in lines.orderBy("line_no").collect()]
    assert got == [(1, "a", "a", "a"), (3, "  b // c", "b", "b"), (5, "y */ &z = '/*'", "&z =", "&z = '/*'")]
    assert split_lines(objects(spark, ["a\nb", ""])).count() == 3


def test_model_of_nested_blocks(spark):
    model = semantics.model(objects(spark, ["sub 'a'\nif &x = 1\n&y = 2.5 // c\nelse\nendif\nendsub", "if &x\nendfor", "parm(in:&a, &b out, &c)"]))
    rows = {(r.object_key, r.line_no): (r.kind, r.depth, r.parent) for r in semantics.statements(model).collect()}
    assert rows["o0", 3] == ("Assignment", 2, 1) and rows["o0", 5] == ("EndIf", 2, 1) and rows["o0", 6] == ("EndSub", 1, 0) and rows["o0", 1] == ("Sub", 0, None)
    cover = {r.object_key: tuple(r)[1:] for r in semantics.coverage(model).collect()}
    assert cover == {"o0": (0, 0, True), "o1": (0, 1, False), "o2": (0, 0, True)}
    assert [(r.param_idx, r.name, r.direction) for r in semantics.parameters(model).where("object_key = 'o2'").orderBy("param_idx").collect()] == [(0, "&a", "In"), (1, "&b", "Out"), (2, "&c", "Unspecified")]


def test_taint_traces(spark):
    text = "parm(in:&a, out:&r)\n&b = Trim(&a)\n&sql = Wash(&b)\n&x = &sql.Execute(&sql)\n&f = GetCookie('c')\n&file.Open(&f)"
    rows = local_taint(objects(spark, [text, "if &x\n&sql.Execute(&HttpRequest)"])).orderBy("line_number").collect()
    assert [(r.object_key, r.line_number, r.cwe, r.confidence, r.unsupported) for r in rows] == [("o0", 4, 89, "low", 2), ("o0", 6, 22, "high", 2)]
    assert [s.kind for s in rows[0].trace] == ["source", "propagate", "unsupported_call", "propagate", "sink"]


def test_taint_goes_round_in_passes_and_takes_the_shortest_way(spark):
    """A value that goes up by a line a pass is reached in four passes and no further; of two ways the shorter is told, then the smaller name."""
    up = "\n".join(f"&v{k + 1} = &v{k}" for k in reversed(range(6))) + "\n" + "\n".join(f"&sql.Execute(&v{k})" for k in range(7))
    ways = "parm(in:&b, in:&a)\n&c = &a\n&d = &c + &b\n&e = &b + &a\n&sql.Load(&d)\n&sql.Load(&e)"
    rows = local_taint(objects(spark, ["parm(in:&v0)\n" + up, ways, "parm(in:&a\nif &a\n&sql.Execute(&a)"])).collect()
    first = sorted((r.line_number, len(r.trace)) for r in rows if r.object_key == "o0")
    assert first == [(8 + k, 2 + k) for k in range(5)]
    second = {r.line_number: [s.detail for s in r.trace] for r in rows if r.object_key == "o1"}
    assert second == {5: ["parm entrada &b", "&d = ... &b ...", "&sql.load"], 6: ["parm entrada &a", "&e = ... &a ...", "&sql.load"]}
    assert not [r for r in rows if r.object_key == "o2"]  # an open block


def test_calls_by_depth(spark):
    rows = calls_in_lines(semantics.model(objects(spark, ["&x = A(B(&p, 'q''r'), (&s)).C(&t) + ) D(", "(E(1)) F", "if (&a)", "", None]))).orderBy("object_key", "pos").collect()
    got = [(r.receiver, r.method, r.variables, r.strings, r.inner) for r in rows]
    assert got == [(None, "a", ["&p", "&s"], ["q'r"], ["b"]), (None, "c", ["&t"], [], []), (None, "d", [], [], []), (None, "e", [], [], [])]


def test_strong_components(spark):
    import random

    rng = random.Random(4)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(55)] + [("n00", "n00"), ("n01", "gone")]
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b in reach:
                    reach[n].add(b)
    want = {n: max(m for m in reach[n] if n in reach[m]) for n in nodes}
    frame = spark.createDataFrame([(n,) for n in nodes], "node string")
    assert {r.node: r.component for r in strong_components(frame, spark.createDataFrame(edges, "a string, b string")).collect()} == want
    assert strong_components(frame.limit(0), spark.createDataFrame([], "a string, b string")).collect() == []


def test_values_come_back_from_calls(spark):
    """Through two callees and back: what an output parameter returns is followed in the caller."""
    outer = "parm(in:&In)\ncall('Mid', &In, &Got)\n&file.Open(&Got)"
    middle = "parm(in:&A, out:&B)\ncall('Leaf', &A, &B)"
    leaf = "parm(in:&P, out:&Q)\n&Q = Trim(&P)\n&cmd.Shell(&P)"
    quiet = "parm(in:&X)\n&sql.Execute('select ')\n&n = GetCookie('c')\n&html.Write(&n)"
    rows = spark.createDataFrame([("Outer", outer, 0), ("Mid", middle, 1), ("Leaf", leaf, 2), ("Quiet", quiet, 3)], "object_key string, text string, ord long")
    found, cover = project.analyze(rows)
    got = {(r.object_key, r.line_number): r for r in found.collect()}
    assert set(got) == {("leaf", 3), ("quiet", 4)}  # the middle object gives nothing back by its own statements
    assert got["leaf", 3].description.endswith("desde 'mid'.") and [s.kind for s in got["leaf", 3].trace] == ["source", "call", "sink"]
    direct = rows.where("object_key <> 'Outer'").union(spark.createDataFrame([("Outer", outer.replace("Mid", "Leaf"), 0)], rows.schema))
    back = {(r.object_key, r.line_number): [s.detail for s in r.trace] for r in project.analyze(direct)[0].collect()}
    assert back["outer", 3] == ["parm entrada &in (frontera del proyecto)", "call('leaf')", "&got ← out de 'leaf'", "&file.open"]


def test_a_cut_project_is_partial(spark):
    rows = spark.createDataFrame([("A", "parm(in:&a)\n&sql.Execute(&a)", 0), ("B", "x", 1)], "object_key string, text string, ord long")
    assert audit.audit(rows, ["GX.SEC.3"]).completion == "complete"
    part = audit.audit(rows, ["GX.SEC.3"], limits=project.Limits(objects=1))
    assert (part.completion, part.verdict, part.projects[0].reasons) == ("partial", "error", ["proyecto truncado: 2 objetos > máximo 1"])
    assert project.analyze(rows, project.Limits(objects=2, bytes=3))[1].truncated and project.analyze(rows, project.Limits(findings=0))[1].truncated


def test_flows_between_objects(spark):
    caller, sink = "parm(in:&Entrada)\ncall('ProcSink', &Entrada)", "parm(in:&Valor)\n&sql = 'select ' + &Valor\n&R = &sql.Execute()"
    rows = spark.createDataFrame([("Caller", caller, 0), ("ProcSink", sink, 1), ("Other", "call('procsink', &q)", 2)], "object_key string, text string, ord long")
    found, cover = project.analyze(rows)
    got = [(r.object_key, r.line_number, r.cwe) for r in found.collect()]
    assert got == [("procsink", 3, 89)]
    assert (cover.objects, cover.edges, cover.sccs, cover.truncated) == (3, 2, 3, False)
    deps = project.dependencies(project.call_edges(rows), rows)
    assert {(r.caller, r.callee) for r in deps.collect()} == {("caller", "procsink"), ("other", "procsink")}
    assert sorted(r.object_key for r in project.frontier(deps, rows).collect()) == ["caller", "other"]
    assert {r.object_key for r in project.dependents(deps, ["ProcSink"]).collect()} == {"procsink", "caller", "other"}
    assert project.components(deps, rows).select("component").distinct().count() == 3
    _, small = project.analyze(rows, project.Limits(objects=1))
    assert small.truncated and small.objects == 1


def test_edges_of_the_call_graph_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(f"Obj{i}", f"call('obj{i + 1}', &v)\ncall('gone')", i) for i in range(4)], "object_key string, text string, ord long")
    edges = project.call_edges(rows).mapInArrow(counted, "caller string, callee string, line_no int")
    found = project.dependents(project.dependencies(edges, rows), ["obj2"])
    assert sorted(r.object_key for r in found.collect()) == ["obj0", "obj1", "obj2"]
    assert seen.value == 8


def test_calls_that_lines_begin_with_are_those_of_their_tokens(spark):
    said = {
        "call('A', &v)": "a", "  CALL ( 'b''c' )": "b'c", "call('')": None, "call('ab\"": "ab", "udp (　' NÉ ')": "né", "callx('a')": None, "x = call('q')": "q", "call (/* c */ 'z')": "z", "call('u//v')": "u//v",
        "// call('n')": None, "/* call('a') */ call('b')": "b", "call('a''": "a'", "call(&x, 'late')": "late", "call('  ', 'y')": None, "f(call('in'))": None, "&call('v')": None, "call.x('m')": None,
        "call('')('p')": None, "call('cr')\r": "cr", "'s' call('t')": "s", "call('''')": "'", "\u0085call('nel')": "nel",
    }
    rows = spark.createDataFrame([(f"o{i}", "\n" + line) for i, line in enumerate(said)], "object_key string, text string")
    got = {r.caller: (r.callee, r.line_no) for r in project.call_edges(rows).collect()}
    assert got == {f"o{i}": (name, 2) for i, name in enumerate(said.values()) if name is not None}


def test_flow_query_covers_all_objects_and_their_calls(spark, tmp_path):
    from lintel import queries
    from lintel.plans import corpus

    n = 5000  # more objects than the default limit
    spark.range(1, 2 * n + 1).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % n).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    rows = corpus.flow_objects(spark, str(tmp_path))
    found, cover = project.analyze(rows, with_components=False)
    assert cover.objects == n and not cover.truncated and cover.edges > n // 2
    got = queries.QUERIES["rule_sec_3"](spark, str(tmp_path))
    assert got.count() == found.count() > 2000
    assert got.where("description like '%llega al parámetro%'").count() > 0
    assert got.where("cast(substring(object_key, 4) as int) >= 4500").count() > 0


def test_decisions(spark):
    result = audit.audit(objects(spark, ["&i = &i + 1\n//"]), policy=decisions.Absolute(1, 1))
    assert (result.metrics["errors"], result.metrics["warnings"], result.verdict, result.exit_code) == (1, 1, "pass", 0)
    assert audit.audit(objects(spark, ["&i = &i + 1"])).verdict == "reject"
    assert audit.audit(objects(spark, ["&password = 'abc123x'"]), ["GX.SEC.1"], decisions.Absolute(9)).verdict == "reject"
    assert audit.audit(objects(spark, ["x"]), failures=[("f", "bad")]).completion == "failed"
    part = audit.audit(objects(spark, ["&i = 1\n&j = 1\n&k = 1"]), max_findings=2)
    assert (part.completion, part.verdict, part.metrics["total_findings"]) == ("partial", "error", 2)
    assert [r.line_number for r in part.findings.collect()] == [1, 2]
    assert audit.audit(objects(spark, ["x"]), policy=decisions.Percentage(0.0)).verdict == "pass"
    pct = decisions.percentiles(spark.range(1, 11).withColumn("v", F.col("id")), "v").first()
    assert tuple(pct) == (1, 5, 10, 10)


def test_percentiles_hold_no_column_in_one_array(spark, capsys, tmp_path):
    import random

    from lintel import queries

    rng = random.Random(3)
    values = [rng.choice([None, -1.5, 0.0, rng.random(), float(rng.randrange(9))]) for _ in range(2001)]
    rows = spark.createDataFrame([(i, i % 50, v) for i, v in enumerate(values)], "event_id long, user_id long, value double").repartition(5)
    v = sorted(x for x in values if x is not None)
    want = (v[0], v[-(-len(v) // 2) - 1], v[-(-len(v) * 95 // 100) - 1], v[-1])
    got = decisions.percentiles(rows, "value")
    assert [tuple(r) for r in got.collect()] == [want]
    got.explain()
    assert "collect_list" not in capsys.readouterr().out
    assert decisions.percentiles(rows.where("false"), "value").count() == decisions.percentiles(rows.where("value is null"), "value").count() == 0
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(queries.QUERIES["event_percentiles"](spark, str(tmp_path)).first()) == want


def test_pages_visit_each_issue_once(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["INFO", "ERROR", "WARNING", "ERROR", "INFO", "WARNING", "ERROR"], 1)], "id long, severity string")
    seen, cursor = [], None
    while True:
        page = paging.keyset_page(rows, cursor, 3).collect()
        seen += [r.id for r in page[:3]]
        if len(page) <= 3:
            break
        cursor = f"{page[2]['rank']}:{page[2].id}"
    assert seen == [2, 4, 7, 3, 6, 1, 5]
    kept = paging.sessions_kept(spark.createDataFrame([(i, 20_000) for i in range(12)], "id long, findings long"))
    assert sorted(r.id for r in kept.collect()) == [10, 11]


EXPORT = """<?xml version="1.0"?>
<ExportFile>
 <GXObject><Procedure><Info><Name>P1</Name><Folder>Root</Folder></Info><Documentation><Source><![CDATA[no]]></Source></Documentation>
  <Events><![CDATA[&x = 1
&y = 2]]></Events>
  <Rules><![CDATA[parm(in:&a);]]></Rules></Procedure></GXObject>
 <GXObject><Table><Info><Name>T</Name></Info></Table></GXObject>
</ExportFile>"""


def test_sources(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_bytes("﻿&i = &i + 1\n".encode())
    (folder / "sub" / "b.PRG").write_bytes("// año".encode("cp1252"))
    (folder / "e.txt").write_bytes(b"  \n")
    (folder / "bad.xml").write_bytes(b"<a><b></a>")
    (folder / "exp.xml").write_text(EXPORT)
    (folder / "r.rar").write_bytes(b"Rar!....")
    (folder / "n.md").write_text("x")
    (folder / ".hidden.txt").write_text("x")
    with zipfile.ZipFile(folder / "p.xpz", "w") as z:
        z.writestr("in/x.xml", EXPORT)
        z.writestr("note.txt", "plain")
    files, excluded = discovery.discover(discovery.list_files(spark, str(folder)), f"file:{folder}")
    assert files.count() == 7 and excluded == 1
    found, failures = readers.read_objects(files)
    got = {(r.member, r.id): r for r in found.collect()}
    assert got["a.txt", "a"].text == "&i = &i + 1\n" and got["b.PRG", "b"].text == "// año"
    one = got["exp.xml", "P1"]
    assert (one.object_type, one.package, one.text) == ("Procedure", "Root", "&x = 1\n&y = 2\n\nparm(in:&a);")
    assert [tuple(s) for s in one.segments] == [("Events", 1, 4), ("Rules", 4, 6)]
    assert got["in/x.xml", "P1"].text == one.text
    assert {r.path.rsplit("/", 1)[1]: r.error.split(":")[0] for r in failures.collect()} == {"e.txt": "empty source", "bad.xml": "malformed XML", "r.rar": "unsupported container"}
    only = discovery.Policy(include=("*.txt",), exclude=("e*",), ignore_lines=("# no", ""))
    assert discovery.discover(discovery.list_files(spark, str(folder)), f"file:{folder}", only)[0].count() == 1
    with pytest.raises(ValueError):
        discovery.glob_pattern("a[")
    assert readers.package_members((folder / "p.xpz").read_bytes()) == ["in/x.xml", "note.txt"]
    small, failed = readers.read_objects(files, readers.Budget(member_bytes=10))
    assert failed.where("error like '%limits of size%'").count() == 1


def test_legacy_document_is_one_object():
    found, n = readers.xml_objects('<Procedure name="P" package="K">\n<Events><![CDATA[a\nb]]></Events></Procedure>')
    assert n == 0 and found[0]["id"] == "P" and found[0]["package"] == "K" and found[0]["segments"][0]["member_start_line"] == 2


def test_sinks_and_history(spark, tmp_path):
    result = audit.audit(objects(spark, ["&i = &i + 1\n//", "x"]))
    text = reports.text_summary(result)
    assert "hallazgos: 2 (1 ERROR / 1 WARNING / 0 INFO)" in text and text.endswith("quality gate: REJECT (absolute)\n") and "ERROR   GX.2.7.2   línea 1    " in text
    assert len(json.loads(reports.to_json(result))["findings"]) == 2
    reports.write_json_lines(result, f"file://{tmp_path}/out")
    lines = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert len(lines) == 3 and sum(r.get("type") == "summary" for r in lines) == 1
    assert {r.page for r in reports.paged(result.findings).collect()} == {1}
    history = store.History(spark, f"file://{tmp_path}/store")
    assert (history.persist(result), history.persist(result)) == (1, 2)
    assert [r.id for r in history.run_page().collect()] == [2, 1] and history.page(2).count() == 2
    history.keep_newest(1, f"file://{tmp_path}/kept")
    assert [r.id for r in store.History(spark, f"file://{tmp_path}/kept").runs().collect()] == [2]
    rules = spark.createDataFrame([("GX.1.1", True)], "rule_id string, enabled boolean")
    assert store.seeded(rules, spark).count() == 34 and store.missing_ids(rules, spark).count() == 33
    settings = store.with_setting(spark.createDataFrame([], "key string, value string"), "max_errors", "3")
    assert store.setting(settings, "max_errors") == "3" and store.setting(settings, "max_error_pct") == "10.0"
    path = tmp_path / "rules.csv"
    path.write_text(',"2.1 Evitar When",Se debe evitar,Error\n,Grupo,,\n,Porcentaje de Error,10,\n')
    found, pct = store.catalogue_csv(spark, f"file://{path}")
    assert [tuple(r) for r in found.collect()] == [("2.1", "Evitar When", "Se debe evitar", "ERROR")]
    assert pct in (10.0, None)


def test_stream_is_the_batch(spark, tmp_path):
    from lintel.streaming import watch

    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"&i = {i}\nif &a\nendif\n")
    query = watch.watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out/findings")).select("rule_id", "line_number", "description").collect()
    found, _ = readers.read_objects(discovery.list_files(spark, str(folder)))
    batch = audit.findings(found).select("rule_id", "line_number", "description").collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch)) and len(batch) == 6


def test_text_functions(spark):
    row = spark.range(1).select(
        x.wrapped(F.lit("one two three four"), 9).alias("w"), x.setting_type(F.lit("12")).alias("i"), x.setting_type(F.lit("1.5")).alias("f"), x.setting_type(F.lit("True")).alias("b"), x.setting_type(F.lit("z")).alias("s"),
        x.redacted(F.lit("a 'x' b 'x'"), F.lit("'x'")).alias("r"), x.literal_value(F.lit("'it''s'")).alias("v"), x.called_subroutine(F.lit("do  'My   Sub';")).alias("c"), x.leading_width(F.lit("  a")).alias("l"),
    ).first()
    assert row.w == ["one two", "three", "four"] and (row.i, row.f, row.b, row.s) == ("int", "float", "bool", "string")
    assert (row.r, row.v, row.c, row.l) == ("a '***' b '***'", "it's", "my sub", 2)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
