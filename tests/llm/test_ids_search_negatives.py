"""Id files, ranked search and hard negatives against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import hard_negatives, id_files, lexical_search, queries
from lintel.llm.scratch import Scratch

EXTRA = ("term", "uid", "item", "rank", "score", "impact", "tie", "at", "part", "block", "ids", "n", "m", "v", "cell", "h", "w", "anchor", "doc")


def _more(df):
    for c in EXTRA:
        df = df.withColumn(c, F.lit("x"))
    return df


# -- id files ---------------------------------------------------------------------------


@pytest.mark.parametrize("n,kinds,least", [(0, 3, 8), (1, 3, 8), (7, 1, 2), (500, 4, 3), (20_000, 300, 8), (5_000, 1, 8)])
def test_grammars_expand_to_what_they_were_made_of(n, kinds, least):
    rng = np.random.default_rng(n + kinds)
    ids = (rng.zipf(1.4, n) % kinds).astype("<u4")
    ends = rng.random(n) < 0.02
    ends[-1:] = True
    shard, closed = id_files.compress(ids, ends, least)
    assert shard.expand(shard.symbols).tolist() == ids.tolist()
    assert (np.cumsum(shard.sizes(shard.symbols))[closed] - 1).tolist() == np.flatnonzero(ends).tolist()  # no pair crosses an end
    for start, count in ((0, 5), (n // 2, 40), (n - 1, 9), (n + 3, 2), (2, 0)):
        if start >= 0:
            assert shard.ids(start, count).tolist() == ids[start : start + count].tolist()
    if kinds == 1 and n > 1000:
        assert len(shard.symbols) < n / 20  # a symbol or two for each document


def test_rules_are_used_and_refer_to_earlier_ones():
    ids = np.array([1, 2, 3, 4] * 50, dtype="<u4")
    shard, _ = id_files.compress(ids, np.zeros(len(ids), dtype=bool), least=3)
    assert len(shard.symbols) < 30
    assert all(max(pair) < shard.base + k for k, pair in enumerate(shard.rules.tolist()))
    assert shard.lengths.sum() == sum(len(shard.expand(np.array([shard.base + k]))) for k in range(len(shard.rules)))


def test_symbols_beyond_two_bytes():
    ids = np.array([70_000, 5] * 40, dtype="<u4")
    shard, _ = id_files.compress(ids, np.zeros(len(ids), dtype=bool))
    assert shard.symbols.itemsize == 4 and shard.expand(shard.symbols).tolist() == ids.tolist()


def _brute_ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files_give_all_ids_back(spark):
    rng = random.Random(3)
    words = "alpha beta gamma Delta unbelievable token's 12,5 é日本 x".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "<|endoftext|> it"), (504, " ".join(f"w{i}x" for i in range(4000))), (505, "same"), (505, "same")]
    rng.shuffle(rows)
    df = _more(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    files = id_files.write_ids(df, queries.tokenizer_path(), shard_ids=700)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in id_files.read_ids(files, True).orderBy("start").collect()]
    want = _brute_ids(sorted(rows, key=lambda r: r[0]))
    assert got == want
    assert files.shards.count() > 5
    stream = [i for r in want for i in r[4]]
    for start, count in ((0, 10), (650, 200), (len(stream) - 4, 100), (len(stream), 1)):
        assert id_files.read_range(files, start, count) == stream[start : start + count]


def test_files_of_rows_without_ids_and_of_nothing(spark):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "c"), (None, None)], "doc_id long, text string")
    rows = id_files.read_ids(id_files.write_ids(df, queries.tokenizer_path())).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(4)]
    assert id_files.read_ids(id_files.write_ids(df.limit(0), queries.tokenizer_path())).collect() == []


# -- ranked search ----------------------------------------------------------------------


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute_search(docs, items, k=10):
    words = [(d, Counter(_terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in words]
    big_n, big_l = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in words for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for (d, c), n in zip(words, sizes, strict=True):
            m = 25 + (75 * n * big_n) // big_l if big_l else 0
            s = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def _found(df):
    return sorted(((r.item, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("vocabulary,part", [(2_000_000, 200_000), (7, 5)])
def test_search_is_brute_force(spark, vocabulary, part):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "It's", "a-b"]
    docs = [(i, " ".join(rng.choices(words, weights=[60 / (j + 1) for j in range(len(words))], k=rng.randrange(1, 80)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(15)]  # more copies than places
    docs += [(600, None), (601, ""), (602, "..."), (603, "rare once"), (None, docs[9][1]), (9, docs[9][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(8)] + [(20, docs[7][1]), (21, "rare"), (22, "unknown words only"), (23, None), (24, "w0 W0 w0"), (None, "w1"), (25, "w3"), (25, "w4 w4")]
    got = _found(lexical_search.search(_more(spark.createDataFrame(docs, "doc_id long, text string")), _more(spark.createDataFrame(items, "item_id long, text string")), vocabulary=vocabulary, part=part))
    assert got == _brute_search(docs, items)


def test_search_in_nothing_and_for_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs.limit(0), items.limit(0)).collect() == []


def test_search_reads_lists_to_the_threshold_only(spark):
    """A list whose impacts are all below a query's threshold gives no candidates."""
    docs = [(i, "common filler") for i in range(200)] + [(1000 + i, f"gem{i % 4} gem{(i + 1) % 4} gem0 gem1") for i in range(30)]
    items = [(1, "gem0 gem1 gem2 gem3 common")]
    keep = Scratch(spark, "test")
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item long, text string")
    wanted = i.mapInArrow(lexical_search._query_terms, "item long, term long").groupBy("item", "term").agg(F.count("*").alias("n"))
    search = lexical_search.Search(lexical_search.Index(d, wanted, keep), wanted, keep)
    candidates = search.candidates(search.bounds())
    assert 10 <= candidates.count() <= 30


# -- hard negatives ---------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def _brute_negatives(rows, k=5):
    rows = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in rows), default=0)
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (width - len(v)), y) for i, v, y in rows]
    out = []
    for a, v, y in {(i, tuple(v), y) for i, v, y in whole if i % 100 == 0}:
        scores = sorted((-sum(p * q for p, q in zip(v, u, strict=True)), i, z) for i, u, z in whole if i != a)
        for s, i, _ in [x for x in scores if x[2] == y][:5]:
            fits = [x for x in scores if x[2] != y and -80 * s <= -100 * x[0] <= -100 * s][:k]
            out += [(a, i, r, n, -s, -t) for r, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def _vectors(seed, n, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 12))
    out = []
    for i in range(n):
        g = int(rng.integers(groups))
        v = (centres[g] + rng.normal(scale=0.3, size=12)).astype(np.float32)
        out.append((i, v.tolist(), g if rng.random() < 0.6 else int(rng.integers(4))))
    return out


@pytest.mark.parametrize("chunk_values,block", [(1 << 18, 512), (12, 2)])
def test_negatives_are_brute_force(spark, monkeypatch, chunk_values, block):
    monkeypatch.setattr(hard_negatives, "LEAF", 32)
    monkeypatch.setattr(hard_negatives, "CELL_CHUNKS", 2)
    rows = _vectors(1, 700)
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(40)]  # ties
    rows += [(700, None, 1), (800, [1.0, None] + [0.0] * 10, 1), (801, [float("nan")] * 12, 2), (802, [float("inf")] * 12, 2), (None, rows[0][1], 1), (803, rows[0][1], None)]
    rows += [(900, [0.5, 0.25], 1), (901, [], 1), (1100, [0.0] * 12, 2), rows[100], (200, rows[5][1], 3)]  # short, empty, zero, repeated row, other row of an anchor's id
    got = hard_negatives.mine(_more(spark.createDataFrame(rows, VECTORS)).repartition(4), F.col("vec_id") % 100 == 0, chunk_values=chunk_values, block=block)
    assert sorted(tuple(r) for r in got.collect()) == _brute_negatives(rows)


def test_negatives_of_one_label_and_of_nothing(spark):
    rows = [(i, [1.0, i / 7], 1) for i in range(30)]
    df = spark.createDataFrame(rows, VECTORS)
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("vec_id") < 0).collect() == []


def test_leaves_outside_an_annulus_are_not_read(spark):
    """Bounds hold for every row, and prune leaves of clustered vectors."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-9, 9, (300, 8)) + 200 * np.eye(8, dtype=np.int64)[g] for g in range(8)])
    limit = float((x * x).sum(axis=1).max())
    tree, leaves = hard_negatives.Tree.fit(x, limit, 3)
    top, bottom = tree.bounds(x[::100])
    scores = x[::100] @ x.T
    for n, rows in enumerate(leaves):
        assert (scores[:, rows] <= top[:, n, None]).all() and (scores[:, rows] >= bottom[:, n, None]).all()
    assert (top < 20_000).mean() > 0.2
    opened = tree.opened()
    cell = opened.leaf(x)
    top, bottom = opened.bounds(x[::100])
    for n in range(8):
        assert (scores[:, cell == n] <= top[:, n, None]).all() and (scores[:, cell == n] >= bottom[:, n, None]).all()


# -- places in long texts ---------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 127, 128, 129, 256, 257, 1000])
def test_places_of_many_matches(spark, n):
    from lintel.llm import spans

    rng = random.Random(n)
    text = "é" + "".join(rng.choice(["ab1", " x ", "77", "日", "z9z9"]) for _ in range(n)) + "5" * (n % 2)
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(spans.find(F.col("text"), "([a-z])?[0-9]+", 1)).alias("f")).select("f.*").collect()
    assert [(r.start, r.end, r.text, r.part) for r in rows] == [(m.start(), m.end(), m[0], m[1] or "") for m in re.finditer("([a-z])?[0-9]+", text)]
    assert all(text[: r.start].endswith(r.before) and text[r.end :].startswith(r.after) for r in rows)


def test_secrets_of_a_long_list(spark, tmp_path):
    """A checksum list of 2 MB: time is in proportion to its matches."""
    import time

    from lintel.llm import secrets

    rng = random.Random(9)
    text = "\n".join(f"{rng.getrandbits(96):024x}" for _ in range(80_000))
    began = time.time()
    row = secrets.digest(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), str(tmp_path / "ledger"), "doc_id")).first()
    assert row.n_hex == 80_000 and row.spans.endswith(f"hex:{25 * 79_999}:{25 * 79_999 + 24}")
    assert time.time() - began < 60


# -- pages ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div class='content has-sidebar'><h1>Head</h1><p>Body</p></div>", "Head\n\nBody"),
        ("<div class='layout right-sidebar'><article><p>Body</p></article><div class='sidebar'>Side</div></div>", "Body"),
        ("<article><p>One</p><div class='cookie-recipe'><p>Two eggs</p></div><div class='cookie-bar'>We use cookies</div></article>", "One\n\nTwo eggs"),
        ("<article><p>One</p><ol class='commentlist'><li>First!</li></ol><div class='user-replies'>Me too</div></article>", "One"),
        ("<body class='no-sidebar'><main><p>x</p></main><div class='sidebar-right'>y</div></body>", "x"),
    ],
)
def test_wrappers_stay_and_comment_lists_go(spark, page, want):
    from lintel.llm import html_text

    rows = [(i, f"http://h{i}.example/{i}", page) for i in range(3)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {want}


def test_a_page_that_closes_nothing(spark):
    import time

    from lintel.llm import html_text

    deep = "".join(f"<div>text{i}" for i in range(20_000)) + "</section>" * 2_000
    began = time.time()
    got = html_text.extract(spark.createDataFrame([(1, "http://a.example/1", deep), (2, "http://a.example/2", "<p>x</p>")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert got[0].text.split("\n\n") == [f"text{i}" for i in range(20_000)] and got[1].text == "x"
    assert time.time() - began < 60


# -- labelled texts beyond the sample's bytes -------------------------------------------


def test_one_long_labelled_text_leaves_room_for_others(spark):
    from lintel.llm import toxicity

    rng = random.Random(12)
    plain = [f"word{i}" for i in range(300)]
    said = [(i, int(i % 3 == 0), " ".join(rng.choices(plain, k=40) + (["vile", "filthy"] if i % 3 == 0 else []))) for i in range(240)]
    hashes = {r.id: r.h for r in spark.range(240).select("id", F.xxhash64("id").alias("h")).collect()}
    first = min((i for i, y, _ in said if y), key=hashes.get)
    said = [(i, y, " ".join(rng.choices(plain, k=60_000)) if i == first else t) for i, y, t in said]
    docs = spark.createDataFrame([(i, t) for i, _, t in said], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in said if i < 180], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, size=(200_000, 100_000))
    assert model is not None
    scores = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id >= 180"), model).collect()}
    assert all((scores[i] >= toxicity.THRESHOLD) == bool(y) for i, y, _ in said if i >= 180)
