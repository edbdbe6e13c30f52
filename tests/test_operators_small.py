"""Operators on small tables against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import conflicts, graph, index, logs, paths, records, selection, tables


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [f"t{r.randrange(12)}" for _ in range(r.randint(1, 8))]) for i in range(60)] + [(100, []), (101, ["t1", "t2"]), (102, ["t2", "t1"])]
    want = {}
    for (a, x), (b, y) in combinations(rows, 2):
        if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= 0.6:
            want[a, b] = round(len({*x} & {*y}) / len({*x} | {*y}), 6)
    found = conflicts.similar_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 0.6)
    assert {(p["id_a"], p["id_b"]): p["similarity"] for p in found.collect()} == want


def test_overlapping_spans_equal_brute_force(spark):
    r = random.Random(5)
    spans = lambda n: [(i, r.randrange(3), a, a + r.randrange(30)) for i in range(n) for a in [r.randrange(100)]]
    left, right = spans(40), spans(40)
    found = tables.overlapping(spark.createDataFrame(left, "l long, k long, a long, b long"), spark.createDataFrame(right, "r long, k long, x long, y long"), "k", 7)
    assert sorted((p["l"], p["r"]) for p in found.collect()) == sorted((l[0], m[0]) for l in left for m in right if l[1] == m[1] and l[2] <= m[3] and l[3] >= m[2])


def test_nearest_rank_of_ties(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 1, 9, 2)] + [("b", 3.0), ("b", None)]
    found = {p["g"]: tuple(p)[1:] for p in tables.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.5, 0.95]).collect()}
    assert found == {"a": (6, round(19 / 6, 6), 1.0, 9.0), "b": (1, 3.0, 3.0, 3.0)}


def test_reverse_paths_stop_at_entries_and_cycles(spark):
    edges = [(1, "a", "b"), (2, "b", "c"), (3, "c", "b"), (4, "x", "c"), (5, "e", "x"), (6, "f", "e")]
    df = spark.createDataFrame([(i, s, t, "calls", 0.9, "exact") for i, s, t in edges], "edge_id long, source string, target string, relation string, confidence double, evidence_class string")
    found = paths.reverse_paths(df, spark.createDataFrame([("c",)], "node string"), spark.createDataFrame([("a", 1.0)], "node string, score double"), 3, 10)
    told = {(">".join(p["nodes"]), p["complete"], p["truncated"]) for p in found.collect()}
    assert told == {("a>b>c", True, False), ("f>e>x>c", False, True)}
    assert all(0 <= p["s"] <= 1 for p in found.select(paths.path_score().alias("s")).collect())


def test_unordered_steps(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 6)], "source long, target long")
    assert sorted(r["node"] for r in graph.unordered(df).collect()) == [2, 3, 4]


def test_caps_and_diversity(spark):
    rows = [("q", i, "s" if i < 6 else "t", f"p{i % 2}", [f"w{i // 2}"]) for i in range(10)]
    df = spark.createDataFrame(rows, "q string, i long, s string, p string, w array<string>")
    assert [r["i"] for r in selection.capped(df, "q", [F.col("i")], {"s": {"s": 2, "t": 1}}, 9).orderBy("i").collect()] == [0, 1, 6]
    assert sorted(r["i"] for r in selection.diverse(df, "q", [F.col("i")], "w", "p", per_place=9, most=6).collect()) == [0, 1, 2, 4, 6, 8]
    assert sorted(r["i"] for r in selection.with_reserved(df, "q", [F.col("i")], F.col("s") == "t", 2, 4).collect()) == [0, 1, 6, 7]


def test_index_finds_by_field_and_prefix(spark, tmp_path):
    rows = [(1, "red widget", "blue ring"), (2, "blue widget", "red red ring"), (3, "green", "nothing"), (4, None, None)]
    index.write_index(spark.createDataFrame(rows, "id long, name string, body string"), ["name", "body"], f"{tmp_path}/i")
    found, lengths = spark.read.parquet(f"{tmp_path}/i/postings"), spark.read.parquet(f"{tmp_path}/i/lengths")
    assert {(r["id"], r["field"], r["term"]): r["tf"] for r in found.where("term = 'red'").collect()} == {(1, "name", "red"): 1, (2, "body", "red"): 2}
    assert [r["id"] for r in index.bm25(found, lengths, ["gre"], {"name": 5.0}, 5).collect()] == [3]
    assert [r["id"] for r in index.bm25(found, lengths, ["red", "blue"], {"name": 1.0}, 5, every=True).collect()] == []


@pytest.mark.parametrize(
    "line, want",
    [
        ("01-02 03:04:05.6 com.app:ui E Store: no route=a/b code=7", ("01-02 03:04:05.6", "com.app:ui", "error", "Store", "no route=a/b code=7")),
        ("now pid=1 tid=2 main WARN Net: x: y", ("now", "main", "warning", "Net", "x: y")),
        ("kernel: oops", ("", "", "", "kernel", "oops")),
        ("no colon", ("", "", "", "", "no colon")),
    ],
)
def test_log_lines(spark, line, want):
    row = logs.parsed(spark.createDataFrame([(line,)], "line string")).first()
    assert tuple(row[c] for c in ("timestamp", "process", "level", "logger", "message")) == want


def test_merged_and_rewritten_records(spark):
    df = spark.createDataFrame([(1, "g", "active", "a"), (2, "g", "active", "b"), (3, "g", "stale", "c"), (4, "h", "active", "d")], "id long, k string, status string, body string")
    assert {r["id"]: (r["body"], r["status"], r["merged_into"]) for r in records.merged_records(df, ["k"], "body").collect()} == {1: ("a; b", "active", None), 2: ("b", "merged", 1), 3: ("c", "stale", None), 4: ("d", "active", None)}
    now = spark.createDataFrame([("x", 1, 1), ("y", 2, 4)], "scope string, v long, g long")
    fresh = spark.createDataFrame([("y", 7), ("z", 8)], "scope string, v long")
    assert sorted(map(tuple, records.rewritten_scope(now, fresh, "scope", "g").collect())) == [("x", 1, 1), ("y", 7, 5), ("z", 8, 1)]


def test_negative_clauses_and_order():
    assert T.positive_query("find the widget, not the red one") == (["find", "widget"], ["red", "one"])
