import math
import random

import pytest
from pyspark.sql import functions as F

from tablescry.functions import values as V
from tablescry.operators import cells, edits, lookups, order, search, sequences, stats, unions
from tablescry.plans.contracts import Limits, Report, fits_clipboard, probed
from tablescry.plans.view import View


def table(spark, rows, headers):
    return cells.Table(spark.createDataFrame(list(enumerate(rows)), "row_id long, cells array<string>"), tuple(headers))


def ids(t):
    return [r["row_id"] for r in t.rows.collect()]


def test_blanks_last_both_ways(spark):
    t = table(spark, [["10"], ["2"], [""], ["1"]], ["n"])
    assert ids(order.ordered(t, order.Sort(0))) == [3, 1, 0, 2]
    assert ids(order.ordered(t, order.Sort(0, True))) == [0, 1, 3, 2]
    assert ids(order.ordered(t, None)) == [0, 1, 2, 3]


def test_types_and_statistics(spark):
    t = table(spark, [["1", "2024-01-02", "x", " "], ["2", "2024/02/03", "1", ""], ["", "2024-03-04", "", ""]], ["n", "d", "t", ""])
    assert [r["type"] for r in order.column_types(t).orderBy("column").collect()] == ["number", "date", "text", "text"]
    s = stats.column_statistics(t).orderBy("column").collect()
    assert (s[0]["count"], s[0]["mean"], s[0]["min"], s[0]["max"], s[0]["n"]) == (2, 1.5, 1.0, 2.0, 2) and math.isclose(s[0]["null_fraction"], 1 / 3)
    assert s[2]["mean"] is None and s[3]["count"] == 0
    empty = cells.Table(t.rows.limit(0), ("a",))
    assert stats.column_statistics(empty).first()["null_fraction"] == 0


def test_types_of_odd_cells(spark):
    """One cell a column: short cuts agree with the full definitions of numbers and dates."""
    odd = ["5", "5.", ".5", "+5", "-.5e3", ".", "+", "5 ", "\u00a05", "5\x01", "5\u0085", "1e999", "9" * 400, "9" * 300 + ".0", "0x1F", "0xg", "0b2", "123e-5", "5L", "NaN", "Infinity", "１２", "e5", "~", "\x7f", "é", " x",
           "", "  ", "\u3000", "2024-02-28", "2024-02-29", "2023-02-29", "2024/12/31", "2024-13-01", "0000-01-01", "2024-01-02\n", "2024-01-02x", "2024-01-2T", "2024-01-02T23:59:59.999Z", "2024-01-02 23:59", "2024-01-02T24:00:00Z", "2024-01-02T01:02:03+14:00", "2024-01-02Z"]
    t = table(spark, [odd, [None] * len(odd)], [str(i) for i in range(len(odd))])
    found = [r["type"] for r in order.column_types(t).orderBy("column").collect()]
    c = V.trimmed(F.col("c"))
    full = F.when(c == "", "text").when(V.numeric(c).isNotNull(), "number").when(V.is_date(c), "date").otherwise("text")
    want = [r["w"] for r in spark.createDataFrame(list(enumerate(odd)), "i int, c string").select("i", full.alias("w")).orderBy("i").collect()]
    assert list(zip(odd, found)) == list(zip(odd, want)) and {*want} == {"number", "date", "text"}
    assert [order.inferred(t, i) for i in (0, 26, 30)] == ["number", "text", "date"]


def test_sort_cycle_and_pages(spark):
    a = order.next_sort(None, 1)
    b = order.next_sort(a, 1)
    assert (a, b, order.next_sort(b, 1), order.next_sort(b, 2)) == (order.Sort(1), order.Sort(1, True), None, order.Sort(2))
    p = order.Page(7, 10)
    assert p.clamped(35).index == 3 and p.count(0) == 1 and p.resized(25) == order.Page(2, 25)
    assert order.shown(spark.range(10), 3).first()["total"] == 10


def test_view(spark):
    t = table(spark, [["b10", "x"], ["b9", "y"], ["", "x"], ["B1", "X"]], ["k", "v"])
    v = View(t).toggled(0).searched("x")
    assert len(v.rows().collect()) == 4  # one letter doesn't filter
    assert [r["row_id"] for r in View(t).toggled(0).searched("b").rows().collect()] == [3, 1, 0, 2]
    assert [r["row_id"] for r in View(t).toggled(0).searched("b1").rows().collect()] == [3, 0]
    assert [r["row_id"] for r in View(t).resized(3).paged(1).rows().orderBy("row_id").collect()] == [3]
    assert v.statistics().first()["total"] == 4


def test_named_project_json(spark):
    t = table(spark, [["1", "a", "2"]], ["x", "", "x"])
    assert t.as_json().first()["json"] == '{"x":"2","col1":"a"}'
    with pytest.raises(ValueError):
        t.named()
    assert t.project(2, 1).headers == ("x", "") and t.project(0, 1).but(t.project(0, 1).rows, ("p", "q")).named().first()["q"] == "a"


def test_from_frame(spark):
    df = spark.sql("select 5L id, 4.572756E7D d, struct(1 as a) s, date'2024-01-02' t, cast(null as string) n, true b, X'01ff' y")
    assert cells.from_frame(df, "id").rows.first()["cells"] == ["5", "45727560", '{"a":1}', "2024-01-02", "", "true", "[1,255]"]
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("v"))
    n = cells.numbered(many, "k").collect()
    assert sorted((r["k"], r["row_id"]) for r in n) == [(i, i) for i in range(1000)]


def test_grid_and_dense(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 3, "d")], "r int, c int, w string")
    m = spark.createDataFrame([(1, 1, 2, 1)], "r0 int, c0 int, r1 int, c1 int")
    assert [(r["w"], r["row_span"]) for r in cells.grid(c, m).collect()] == [("a", 2), ("b", 1), ("d", 1)]
    assert [r["cells"] for r in cells.dense(c).rows.orderBy("row_id").collect()] == [["a", "b", ""], ["c", "", ""], ["", "", "d"]]
    assert cells.dense(c.limit(0)).headers == ()


def test_grid_of_large_ranges(spark):
    at = [(r, c) for r in (0, 1, 63, 64, 65, 200, 500_000) for c in (0, 1, 63, 64, 130)]
    ranges = [(1, 1, 64, 64), (200, 0, 500_000, 1), (0, 130, 0, 130)]
    out = cells.grid(spark.createDataFrame([(r, c, "x") for r, c in at], "r int, c int, w string"), spark.createDataFrame(ranges, "r0 int, c0 int, r1 int, c1 int"))
    want = []
    for r, c in at:
        over = [m for m in ranges if m[0] <= r <= m[2] and m[1] <= c <= m[3]]
        if not over or (r, c) == over[0][:2]:
            want.append((r, c, *((over[0][2] - r + 1, over[0][3] - c + 1) if over else (1, 1))))
    assert sorted((r["r"], r["c"], r["row_span"], r["col_span"]) for r in out.collect()) == sorted(want)


def test_wide_ranges_cost_no_more(spark):
    rng = random.Random(6)
    points = [rng.uniform(-1e6, 1e6) for _ in range(300)] + [0.0, -1e6, 1e6, 7.0]
    ranges = [(0.0, 0.0), (-1e6, 1e6), (7.0, 7.5), (5.0, 4.0), (-1e12, 1e12)] + [(a, a + 10 ** rng.uniform(-2, 6)) for a in (rng.uniform(-1e6, 1e6) for _ in range(100))]
    df, of = spark.createDataFrame([(p,) for p in points], "p double"), spark.createDataFrame(ranges, "lo double, hi double")
    out = sorted((r["p"], r["lo"], r["hi"]) for r in lookups.in_ranges(df, of, "p", bucket=0.5).collect())
    assert out == sorted((p, a, b) for p in points for a, b in ranges if a <= p <= b)
    assert lookups.in_ranges(df, of.limit(0), "p", bucket=0.5).count() == 0


def test_searches(spark):
    t = table(spark, [["Alpha", "beta"], ["gamma", "ALPHABET"], ["", ""]], ["a", "b"])
    assert ids(search.any_cell(t, "alpha")) == [0, 1] and ids(search.any_cell(t, "a")) == [0, 1, 2]
    assert tuple(search.match_counts(t, "alpha").first()) == (2, 2)
    texts = spark.createDataFrame([(1, "aXAxa"), (2, "")], "id int, t string")
    assert [(r["start"], r["end"]) for r in search.find_all(texts, "ax", id_col="id", text_col="t").orderBy("start").collect()] == [(0, 2), (2, 4)]
    nodes = spark.createDataFrame([(1, 0, 0, "$", "$", "object", None, 0, 20, [0]), (1, 1, 1, "Key", "$.Key", "string", "V", 2, 9, [0, 1]), (1, 2, 1, "z", "$.z", "null", "null", 10, 15, [0, 2])], "doc_id int, node_id int, depth int, key string, path string, kind string, value string, span_start int, span_end int, lineage array<int>")
    assert [r["node_id"] for r in search.tree_search(nodes, " key ").collect()] == [1]
    assert [r["node_id"] for r in search.scoped_search(nodes, "v", "value").collect()] == [1] and search.scoped_search(nodes, "$").count() == 2
    assert sorted(r["node_id"] for r in search.subtree_search(nodes, "z").collect()) == [0, 2]
    assert [search.tightest(nodes, at).first()["node_id"] for at in (3, 12, 18)] == [1, 2, 0]
    e = spark.createDataFrame([("a/", True), ("a/b.txt", False), ("c.md", False)], "path string, is_dir boolean")
    assert sorted(r["path"] for r in search.path_filter(e, "B.TXT").collect()) == ["a/", "a/b.txt"]
    links = spark.createDataFrame([("https://x",), ("javascript:x",), ("x",)], "u string").select(search.safe_link(F.col("u")).alias("s"))
    assert [r["s"] for r in links.collect()] == [True, False, False]
    paths = spark.createDataFrame([("a/b",), ("../a",), ("/a",), ("a/../b",), ("C:x",), ("a..b",)], "p string").select(search.safe_path(F.col("p")).alias("s"))
    assert [r["s"] for r in paths.collect()] == [True, False, False, False, False, True]


def test_lookups(spark):
    refs = spark.createDataFrame([("p.A",), ("B",), ("q.C",), ("Z",)], "ref string")
    types = spark.createDataFrame([("p.A",), ("x.B",), ("C",)], "full_name string")
    assert sorted(r["ref"] for r in lookups.unresolved(refs, types).collect()) == ["Z", "q.C"]
    uses = spark.createDataFrame([("d", 5), ("d", 1), ("e", 1)], "k string, at int")
    defs = spark.createDataFrame([("d", 1, "one"), ("d", 3, "three"), ("d", 5, "five")], "k string, at int, v string")
    assert {(r["k"], r["at"]): r["v"] for r in lookups.as_of(uses, defs, ["k"], "at", "v").collect()} == {("d", 5): "three", ("d", 1): "five", ("e", 1): None}
    square = lambda a, b: ([a, a, b, b], [a, b, b, a])
    rings = spark.createDataFrame([(1, 1, *square(0.0, 10.0)), (1, 2, *square(2.0, 6.0))], "feature int, ring_id int, xs array<double>, ys array<double>")
    holes = spark.createDataFrame([(1, 8, *square(3.0, 4.0)), (1, 9, *square(20.0, 21.0)), (1, 7, *square(7.0, 8.0))], "feature int, ring_id int, xs array<double>, ys array<double>")
    assert {r["ring_id"]: r["owner"] for r in lookups.owners(holes, rings).collect()} == {8: 2, 9: None, 7: 1}
    g = spark.createDataFrame([(0, ["x"], ["a"]), (1, ["a", "w"], ["b"]), (2, ["b", "a"], ["c"])], "node_id long, inputs array<string>, outputs array<string>")
    assert {r["node_id"]: r["depth"] for r in lookups.topological_depth(g).collect()} == {0: 0, 1: 1, 2: 2}
    inputs, inits = spark.createDataFrame([("x",), ("w",), ("u",)], "name string"), spark.createDataFrame([("w",)], "name string")
    assert {(r["name"], r["used"]) for r in lookups.graph_inputs(inputs, inits, g).collect()} == {("x", True), ("u", False)}
    inc = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "path string, target string")
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, bytes long")
    assert [(r["path"], r["depth"]) for r in lookups.includes("a", inc, sizes).collect()] == [("a", 0), ("b", 1), ("c", 1)]
    twice = spark.createDataFrame([(1, 0, "$.a"), (1, 1, "$.a"), (2, 0, "$.a")], "doc_id int, node_id int, path string")
    assert sorted(r["unique_path"] for r in lookups.numbered_paths(twice).collect()) == ["$.a", "$.a", "$.a#2"]


def test_pyramid_is_exact_and_cut_free(spark):
    rng = random.Random(1)
    x = [rng.uniform(-1, 1) for _ in range(5000)]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x)], "frame long, channel int, sample double")
    levels = sequences.pyramid(df, base=16, factor=4, top=8).cache()
    for r in levels.collect():
        size = 16 * 4 ** r["level"]
        part = x[r["bucket"] * size : (r["bucket"] + 1) * size]
        assert (r["min"], r["max"]) == (min(part), max(part))
    assert levels.agg(F.max("level")).first()[0] == 3
    for p in sequences.envelope(levels, 0, 160, 1760, 10, base=16).collect():
        part = x[160 + p["pixel"] * 160 : 320 + p["pixel"] * 160]
        assert p["min"] <= min(part) and p["max"] >= max(part)
    assert sequences.pick_level(4, 70, base=16, factor=4) == 1 and sequences.pick_level(4, 1, base=16, factor=4) == 0
    assert sequences.pyramid(df.limit(0)).count() == 0


def test_spectrogram_finds_a_tone(spark):
    rate = 8000
    df = spark.createDataFrame([(i, 0, math.sin(2 * math.pi * 1000 * i / rate)) for i in range(2048)], "frame long, channel int, sample double")
    r = sequences.spectrogram(df, rate=rate, fft=512, hop=256, bands=32).where("hop_id = 2").first()["levels"]
    band = r.index(max(r))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    assert abs(band - mel(1000) / mel(4000) * 31) <= 1


def test_boxes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 14.0, 1.0, 10.0, 10.0), (1, 60.0, 0.0, 5.0, 10.0), (1, 0.0, 30.0, 5.0, 10.0)], "page long, x double, y double, w double, h double")
    assert sorted((r["x"], r["w"], r["h"]) for r in sequences.merged_boxes(df).collect()) == [(0.0, 5.0, 10.0), (0.0, 24.0, 11.0), (60.0, 5.0, 10.0)]


def test_edits(spark):
    t = table(spark, [["a", "1"], ["b", "2"], ["c", "3"]], ["x", "y"])
    s = edits.Session(t)
    for e in (edits.edit_cell(1, 1, "9"), edits.edit_header(0, "X"), edits.insert_row(0), edits.insert_row(), edits.delete_row(2), edits.insert_column(1), edits.delete_column(2)):
        s = s.dispatch(e)
    out = s.table()
    assert out.headers == ("X", "Column3")
    assert [(r["row_id"], r["cells"]) for r in out.rows.orderBy("ord").collect()] == [(0, ["a", ""]), (3, ["", ""]), (1, ["b", ""]), (4, ["", ""])]
    back = s.undo().undo()
    assert back.table().headers == ("X", "y") and back.redo().table().headers == ("X", "Column3", "y")
    assert s.dirty and not s.mark_saved().dirty and s.mark_saved().undo().dirty and not s.mark_saved().undo().redo().dirty
    assert edits.applied(table(spark, [["a"]], ["x"]), edits.delete_column(0)).headers == ("x",)
    assert [edits.shifted_sort(c, e) for c, e in ((1, edits.insert_column(1)), (1, edits.delete_column(0)), (1, edits.delete_column(1)), (0, edits.insert_column(1)))] == [2, 0, None, 0]
    long = edits.Session(t)
    for i in range(edits.HISTORY + 3):
        long = long.dispatch(edits.edit_header(0, str(i)))
    assert len(long.done) == edits.HISTORY and len(long.base) == 3
    lines = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c")], "doc_id string, line int, raw string")
    assert [r["raw"] for r in edits.moved(lines, 3, True).orderBy("line").collect()] == ["a", "c", "b"]
    assert [r["line"] for r in edits.renumbered(lines.withColumn("ord", -F.col("line"))).orderBy("raw").collect()] == [3, 2, 1]


def test_unions_and_stats(spark):
    e = spark.createDataFrame([(0, "a/b/x", False), (1, "a/y", False), (2, "c/", True), (3, "c/z", False)], "entry_id long, path string, is_dir boolean")
    out = unions.implicit_directories(e).orderBy("ord", "sub").collect()
    assert [(r["entry_id"], r["path"]) for r in out] == [(-1, "a/"), (-2, "a/b/"), (0, "a/b/x"), (1, "a/y"), (2, "c/"), (3, "c/z")]
    p = spark.createDataFrame([("a", "s", 3.0), ("a", "t", -2.0), ("b", "s", 1.0)], "category string, series string, value double")
    assert [tuple(stats.chart_bounds(p, k).first()) for k in ("clustered", "stacked", "percent")] == [(-2.0, 3.0), (-2.0, 3.0), (-100.0, 100.0)]
    c = table(spark, [["", "S1", "S2"], ["A", "1", "x"], ["B", "2", "3"]], ["1", "2", "3"])
    assert sorted(tuple(r) for r in stats.embedded_chart(c).collect()) == [("A", "S1", 1.0), ("A", "S2", 0.0), ("B", "S1", 2.0), ("B", "S2", 3.0)]
    pts = spark.createDataFrame([(1.0, 2.0), (3.0, float("inf"))], "x double, y double")
    assert stats.bounding_box(pts).first()["min_x"] is None
    assert sequences.step_match(3, 2) == 0 and sequences.step_match(3, 0, False) == 2 and sequences.step_match(0, 0) == -1


def test_contracts(spark):
    r = Report("x")
    assert r.status == "ok"
    assert probed(spark.range(20), Limits(max_entries=10), r).count() == 10 and r.status == "partial"
    assert r.frame(spark).first()["code"] == "limit-entries"
    r.note("error", "password-required")
    assert r.status == "failed" and fits_clipboard("x") and not fits_clipboard("x" * (1 << 20) + "y")


def test_numbering_under_adaptive_execution(spark):
    """Wide rows over many partitions, which adaptive execution merges as it likes: each number once, in the order of the key."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
        df = spark.range(1_200_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("g"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        n = cells.numbered(df, "g", F.desc("k"))
        r = n.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("d"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).first()
        assert tuple(r) == (1_200_000, 1_200_000, 0, 1_199_999)
        assert n.select("g", "k", "wide").exceptAll(df.select("g", "k", "wide")).count() == 0
        # neighbours by number are neighbours by key
        pair = n.select("row_id", "g", "k").join(n.select((F.col("row_id") - 1).alias("row_id"), F.col("g").alias("g2"), F.col("k").alias("k2")), "row_id")
        assert pair.where("g2 < g or (g2 = g and k2 > k)").count() == 0
        t = cells.from_frame(spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet"), "l_orderkey", "l_linenumber", "l_partkey")
        assert tuple(t.rows.agg(F.count("*"), F.count_distinct("row_id"), F.max("row_id")).first()) == (600_000, 600_000, 599_999)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
