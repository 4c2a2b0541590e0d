"""A deterministic corpus of program text over the test tables.

Statement templates are dealt out by keys of a table: an object is a key, its
lines are the key's rows in order.  The same literals and arithmetic are used by
the SQL that the queries are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deal

TEMPLATES = (
    "for each Customer", "    where CustomerId = &Id", "endfor", "    where upper(CustomerName) = &Name and CustomerType = 'VIP'", "    defined by IdxCustomer",
    "if &a = 1 and &b = 2 and &c = 3 and &d = 4", "    &x = 1", "else", "endif", "do case", "    case &Kind = 1", "otherwise", "endcase", "parm(in:&Entrada, &Salida, out:&Total);", "sub 'Cargar'",
    "    &Total = nullvalue(&Total)", "endsub", "// comentario explicativo", "//", "// ======", "do 'Cargar'", "do 'Cargar' // con nota", "&i = &i + 1", "for &k = 1 to 10", "    &ok = true",
    "&flag = &ok", "&password = 'S3cr3t!'", "&sql = 'select * from t where id = ' + &Entrada", "&Result = &sql.Execute()", "call('Proc', &Entrada, &Salida)", "rules:", "events:",
    "// CODIGO INICIATIVA: 12", "// VERSION: 1.0 RESPONSIBLE: JP", "    where CustomerStatus = \"Active\" when &Only = 1", "    order CustomerId", "if CustomerId = 1", "    &x = &x + 1", "msg('hola /* no */ // tampoco')",
    "/* bloque", "cerrado */ &y = 2", "endfor // Customer", "do while &j < 3", "enddo", "    where a between 1 and 3", "        for each Order.Line", "&Data = &x", "", "  ", "&token == 'abc'", "for each", "sub 'Dos'",
    "&status = 1 &cond = 2", "    and b in (1, 2)", "&name = GetCookie('c')", "&file.Open(&name)",
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEMPLATES)), "idx long, line string")


def _objects(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """object_key, text of rows (object_key, pos, idx)."""
    dealt = rows.join(F.broadcast(templates(spark)), "idx")
    return dealt.groupBy("object_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object for each user, a line for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mixed = (F.col("event_id") * 7 + F.col("user_id") + F.col("event_id") * F.col("event_id") % 11) % len(TEMPLATES)
    return _objects(spark, e.select(F.col("user_id").alias("object_key"), F.col("event_id").alias("pos"), mixed.alias("idx")))


def order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object for each customer, a line for each order: many small objects."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mixed = (F.col("o_orderkey") * 5 + F.col("o_custkey") * 3) % len(TEMPLATES)
    return _objects(spark, o.select(F.col("o_custkey").alias("object_key"), F.col("o_orderkey").alias("pos"), mixed.alias("idx")))


def flow_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object ``obj<k>`` for each customer key k, with object_key, ord, text: its parameters go into calls of other customers' objects and into its own statements."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = o.select(F.col("o_custkey").alias("key")).distinct()
    # The callee is the customer of another order where there is one: keys of orders that are not there call nothing.
    near = o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_custkey").alias("callee"))
    callee = F.concat(F.lit("call('obj"), F.coalesce("callee", F.col("o_custkey") + 1).cast("string"), F.lit("', &Entrada, &Salida)"))
    kind = F.col("o_orderkey") % 4
    line = F.when(kind < 2, callee).when(kind == 2, "&Salida = Trim(&Entrada)").otherwise("&sql = 'select ' + &Entrada\n&Result = &sql.Execute()")
    first = keys.select("key", F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("parm(in:&Entrada, out:&Salida);").alias("line")).alias("l"))
    rest = o.join(near, "o_orderkey", "left").select(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderkey").cast("long").alias("pos"), line.alias("line")).alias("l"))
    texts = first.union(rest).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
    return texts.select(F.concat(F.lit("obj"), F.col("key").cast("string")).alias("object_key"), F.col("key").alias("ord"), "text")


#: Statements whose values go round between variables, through calls inside calls, and into sinks of all classes.
CHAINS = (
    "&a = &b", "&b = &c", "&c = &Entrada", "&d = Clean(&c)", "&e = Trim(Upper(&d)) + &a", "&sql = 'x' + &e", "&Result = &sql.Execute(&a)", "&cmd.Shell(&d)", "&file.Open(Path(&b))",
    "&HttpResponse.Write(&HttpRequest)", "&f = GetParameter('p') + &a", "&g = &f + &d", "&q.Load(&g, Foo(&b, 'select 1'))", "&b = &g", "&c = &HttpRequestX", "&h = Wash(&Both) + &e", "&Out = &h",
    "x = Foo(Bar(&a) ) (", "&os.Run((&h)).Exec(&a)", "&p = Foo(&z)", "&a = &a + &q", "&q = Strange(&b) + &c + &h", "&file2.Write(&q) &html.Write(&a)", "// &a = &b", "&z = (Inner(Foo('it''s'), &b), (&a)) + Next(&c)",
)


def chain_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object for each customer with parameters of all directions, a line of ``CHAINS`` for each order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dealt = F.get(F.array(*map(F.lit, CHAINS)), ((F.col("o_orderkey") * 11 + F.col("o_custkey") * 5) % len(CHAINS)).cast("int"))
    first = o.select("o_custkey").distinct().select("o_custkey", F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("parm(in:&Entrada, inout:&Both, out:&Out);").alias("line")).alias("l"))
    rest = o.select("o_custkey", F.struct(F.col("o_orderkey").cast("long").alias("pos"), dealt.alias("line")).alias("l"))
    return first.union(rest).groupBy(F.col("o_custkey").cast("string").alias("object_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


def call_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object ``obj<k>`` for each customer key k whose orders call other objects by key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.concat(F.lit("call('obj"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 400).cast("string"), F.lit("', &v)"))
    rows = o.select(F.concat(F.lit("obj"), F.col("o_custkey").cast("string")).alias("object_key"), F.col("o_custkey").alias("ord"), F.struct(F.col("o_orderkey").alias("pos"), line.alias("line")).alias("l"))
    return rows.groupBy("object_key", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of a file for each page: folders d0 to d6, some of them hidden, with six extensions."""
    k = F.col("page_id")
    hidden = F.when(k % 13 == 0, ".old/").otherwise("")
    extension = F.element_at(F.array(*map(F.lit, ("txt", "XML", "prg", "md", "zip", "py"))), (k % 6 + 1).cast("int"))
    path = F.concat(F.lit("/src/d"), (k % 7).cast("string"), F.lit("/"), hidden, F.lit("f"), k.cast("string"), F.lit("."), extension)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(path.alias("path"))


#: Declared inputs over that listing: folders inside each other, files given twice, a missing one and one of no use.
INPUTS = ((0, "/src/d1", "directory"), (1, "/src", "directory"), (2, "/src/d2/f2.prg", "file"), (3, "/src/d3/f3.md", "file"), (4, "/none", "missing"), (5, "/empty", "directory"))


def xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of an export for each customer: with an object, without objects, cut off, or with an object without code."""
    k = F.col("c_custkey").cast("string")
    head = '<?xml version="1.0"?>\n'
    whole = F.concat(
        F.lit(f"{head}<ExportFile><GXObject><Procedure/><Info><Name>P"), k, F.lit("</Name><Folder>F</Folder></Info><Events><![CDATA[&a = "), k,
        F.lit("\n&b = 2]]></Events><Rules><![CDATA[parm(in:&a);]]></Rules></GXObject></ExportFile>"),
    )
    loose = F.concat(F.lit(f'{head}<Thing name="L'), k, F.lit('" package="pk"><Events><![CDATA[e'), k, F.lit("]]></Events></Thing>"))
    bare = F.lit(f"{head}<ExportFile><GXObject><X/><Info><Name>n</Name></Info></GXObject></ExportFile>")
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, whole).when(kind == 1, loose).when(kind == 2, F.lit("<ExportFile><GXObject>")).otherwise(bare)
    rows = deal.by_count(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    return rows.select(F.concat(F.lit("/x/c"), k, F.lit(".xml")).alias("path"), F.encode(text, "UTF-8").alias("content"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of a text file for each document."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.concat(F.lit("/t/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _zipped(batches):
    import io
    import zipfile

    import pyarrow as pa

    for batch in batches:
        out = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as archive:
                for name, data in (("folder/", b""), ("folder/a.xml", content), ("b.xml", content), ("blank.xml", b"  ")):
                    archive.writestr(name, data)
            out.append((path[:-4] + ".xpz", held.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], ["path", "content"])


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of a package for each customer: its export twice, a folder and a blank member."""
    return xml_files(spark, sf_dir).mapInArrow(_zipped, "path string, content binary")


def _packed(folder: str):
    def run(key, table):
        import io
        import zipfile

        import pyarrow as pa

        from ..sources.packages import written

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for path, content in sorted(zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True), key=lambda x: int(x[0][4:-4])):
                archive.writestr(path.removeprefix("/x/"), b"<r/>" if content == b"<ExportFile><GXObject>" else content)
        written(f"{folder}/p{key[0].as_py()}.xpz", held.getvalue())
        return pa.table({"files": pa.array([1], pa.int64())})

    return run


def package_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of package files, one for each hundred customers, with their exports as members; exports that are cut off stand there without objects."""
    from ..sources.rounds import Rounds

    folder = Rounds(spark, "packages").folder
    files = xml_files(spark, sf_dir).withColumn("g", F.floor(F.regexp_extract("path", r"c(\d+)", 1).cast("long") / 100))
    deal.by_count(files, "g").groupBy("g").applyInArrow(_packed(folder), "files long").agg(F.sum("files")).collect()
    return folder
