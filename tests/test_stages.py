"""Localisation, focus, references, dispatch, rounds, progress and budgets on small and awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import budget, dispatch, focus, imports, localize, progress, rounds, selection

REQUESTS = "request long, query string, plain boolean"
HITS = "request long, kind string, id long, file_path string, score double, rank int, exact boolean, coverage int"
SYMBOLS = "id long, file_path string, symbol string, symbol_type string, start_line int, end_line int, owner_name string, owner_kind string, business_terms string, business_summary string, summary string, method_evidence string, string_evidence string, mechanisms array<struct<line:int,kind:string,terms:array<string>>>"
EDGES, FLOWS = "source long, target long, relation string, confidence double", "source_path string, target long, relation string, confidence double"


def stages(spark, requests, hits, symbols, edges=(), flows=()):
    made = [spark.createDataFrame(list(rows), schema) for rows, schema in ((requests, REQUESTS), (hits, HITS), (symbols, SYMBOLS), (edges, EDGES), (flows, FLOWS))]
    found = localize.Localization(*made)
    rows = found.stages().collect()
    told = localize.callable_evidence(found.callables, found.ranges, made[0]).collect()
    return {(r["request"], r["stage"], r["place"], r["id"] or r["file_path"]) for r in rows}, {r["request"]: r for r in told}, rows


def symbol(i, path, name, kind="method", start=1, end=9, owner=None, mechanisms=None):
    return (i, path, name, kind, start, end, None, owner, None, None, None, None, None, mechanisms)


def test_localisation_goes_from_files_to_ranges(spark):
    symbols = [
        symbol(1, "src/a.ts", "load_user", start=10, end=40, owner="service", mechanisms=[(20, "state_write", ["load"])]), symbol(2, "src/a.ts", "other", start=50, end=60), symbol(3, "src/b.ts", "caller", start=5, end=6),
        symbol(4, "src/a.ts", "Panel", "component"), symbol(5, "src/c.ts", "build", start=0, end=0), symbol(6, "src/c.ts", "early", start=3, end=4), symbol(7, None, "nowhere"),
    ]
    hits = [(9, "symbol", 1, "src/a.ts", 5.0, 1, True, 0), (9, "file", 7, None, 9.0, 2, True, 0), (9, "symbol", None, "", 9.0, 3, None, None)]
    edges = [(3, 1, "calls", 0.5), (3, 1, "awaits", 0.75), (2, 1, "imports", 1.0), (4, 1, "calls", 1.0), (1, 1, "calls", 0.5)]
    found, told, rows = stages(spark, [(9, "find the service load_user", True), (10, "nothing here", True)], hits, symbols, edges, [("src/c.ts", 4, "renders_component", 0.5)])
    assert {(9, "file", 1, "src/a.ts"), (9, "seed", 1, 1), (9, "seed", 2, 2), (9, "owner", 1, 3), (9, "owner", 1, 5), (9, "callable", 1, 1)} <= found
    assert {x[3] for x in found if x[1] == "callable"} == {1, 2, 3, 5} and {x[3] for x in found if x[1] == "pool"} == {1, 2}  # a seed's own call is deduplicated
    assert {(r["start_line"], r["end_line"]) for r in rows if r["stage"] == "range" and r["id"] == 1} == {(18, 22)}
    assert {x[3] for x in found if x[1] == "range"} == {1, 2, 3}  # 5 has no lines
    assert (told[9]["certainty"], told[9]["primary"], told[10]["certainty"], told[10]["alternatives"]) == ("bounded", 1, "unavailable", [])


def test_localisation_of_nothing(spark):
    found, told, _ = stages(spark, [], [], [])
    assert not found and not told


def test_folders_are_limited_and_refilled(spark):
    hits = [(1, "file", i, f"src/{i}.ts", 10.0 - i, i, False, 0) for i in range(1, 7)] + [(1, "file", 9, "lib/x.ts", 1.0, 9, False, 0)]
    found = localize.file_candidates(spark.createDataFrame(hits, HITS), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([(1, "q", True)], REQUESTS), 4)
    assert [r["file_path"] for r in found.orderBy("file_rank").collect()] == ["src/1.ts", "src/2.ts", "src/3.ts", "lib/x.ts"]


ITEMS = "request long, position int, id long, file_path string, symbol string, summary string, score double, reasons array<string>, lanes array<string>, method_coverage int, behaviour_coverage int"


def item(r, i, score=1.0, reasons=None, path=None, **more):
    return (r, i, i, path or f"src/{i}.ts", more.get("symbol"), more.get("summary"), score, reasons, more.get("lanes"), more.get("methods"), more.get("behaviours"))


def test_focus_rules(spark):
    rows = [
        item(0, 1), item(0, 2, None), item(1, 1, symbol="UserService"), item(1, 2, path="x/PayPage.ts"), item(1, 3),
        item(2, 1, 9.0, ["multi_term_method_evidence"], methods=3), item(2, 2, 7.0, ["multi_term_method_evidence"], methods=4), item(2, 3, 6.0, ["multi_term_method_evidence"], methods=4), item(2, 4, 7.6, ["structural_behavior"]),
        item(3, 1, 9.0, ["multi_term_method_evidence"], methods=3), item(3, 2, 7.7, ["exact_symbol"]),
        item(4, 1, 30.0, ["exact_path_segment"], lanes=["method_body_fts"], methods=2), item(4, 2, 40.0, ["graph_neighbor"]), item(4, 3, 15.0),
        item(5, 1, reasons=["structural_behavior"], summary="guard"), item(5, 2, reasons=["structural_behavior"], summary="guard return state_write"), item(5, 3, reasons=["structural_behavior"], summary="setstate"), item(5, 4, reasons=["structural_behavior"], summary="return"),
        item(6, 1), item(6, 2, reasons=["graph_relation:renders_component"]), item(6, 3, reasons=["graph_relation:passes_property"]), item(6, 4),
    ]
    queries = {0: "plain", 1: "UserService and PayPage", 2: "x", 3: "x", 4: "call openPage", 5: "guard state update", 6: "x"}
    found = focus.focus(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([(k, v, True) for k, v in queries.items()], REQUESTS)).collect()
    told = {}
    for r in found:
        told.setdefault((r["request"], r["rule"]), set()).add(r["position"])
    assert told == {(0, "none"): {1, 2}, (1, "named"): {1, 2}, (2, "method"): {1, 2}, (3, "none"): {1, 2}, (4, "explicit_method"): {1}, (5, "structural"): {2, 3}, (6, "flow"): {1, 2, 3}}


@pytest.mark.parametrize("path, due", [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../x", None), ("a/../../x", None), ("", ""), ("./a/b/..", "a")])
def test_paths_are_normalised(spark, path, due):
    assert spark.createDataFrame([(path,)], "p string").select(imports.normal_path(F.col("p"))).first()[0] == due


def test_references_resolve(spark):
    files = [
        ("src/a.ts", "import x from './b'; import y from './c.js'; import z from './lib'; import('./no'); require('react'); import q from '../../out'"), ("src/b.ts", "import a from './a'"), ("src/b.tsx", ""), ("src/c.js", None), ("src/c.ts", "x"),
        ("src/lib/index.ts", ""), ("p/m.py", "from . import n\nfrom .sub.k import z\nimport p.n, os\n"), ("p/n.py", ""), ("p/sub/k/__init__.py", ""), ("README.md", "[a](src/a.ts#L3) [b](http://x.y) [c](#z) [d](missing.md)"), ("img.png", "import './a'"), (None, "x"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    told = {}
    for r in imports.resolved(df).collect():
        told.setdefault((r["path"], r["spec"], r["status"]), set()).add(r["target"])
    assert told == {
        ("src/a.ts", "./b", "ambiguous"): {"src/b.ts", "src/b.tsx"}, ("src/a.ts", "./c.js", "ambiguous"): {"src/c.js", "src/c.ts"}, ("src/a.ts", "./lib", "resolved"): {"src/lib/index.ts"}, ("src/a.ts", "./no", "dangling"): {None}, ("src/a.ts", "react", "external"): {None},
        ("src/a.ts", "../../out", "external"): {None}, ("src/b.ts", "./a", "resolved"): {"src/a.ts"}, ("p/m.py", ".", "dangling"): {None}, ("p/m.py", "..n", "dangling"): {None}, ("p/m.py", ".sub.k", "resolved"): {"p/sub/k/__init__.py"}, ("p/m.py", ".sub.k.z", "dangling"): {None},
        ("p/m.py", "p.n", "resolved"): {"p/n.py"}, ("README.md", "src/a.ts#L3", "resolved"): {"src/a.ts"}, ("README.md", "http://x.y", "external"): {None}, ("README.md", "missing.md", "dangling"): {None},
    }
    walk = imports.reached(spark.createDataFrame([("src/b.ts",), ("gone.ts",)], "path string"), imports.resolved(df), 5)
    assert {(r["entry"], r["path"], r["depth"]) for r in walk.collect()} == {("src/b.ts", "src/b.ts", 0), ("src/b.ts", "src/a.ts", 1), ("src/b.ts", "src/b.tsx", 2), ("src/b.ts", "src/c.js", 2), ("src/b.ts", "src/c.ts", 2), ("src/b.ts", "src/lib/index.ts", 2), ("gone.ts", "gone.ts", 0)}


@pytest.mark.parametrize("call, due", [("()", 0), ("f( )", 0), ("f(a)", 1), ("f(a, [b, c], {d, e})", 3), ("f('a, b', \"c,\\\"d\")", 2), ("f(a /* , */, // x, y\n b)", 2), ("f(g(1, 2), h)", 2), ("f(a", None), ("none", None), (None, None), ("f(a): Map<x, y>", 1), ("f('')", 1)])
def test_arguments_are_counted(spark, call, due):
    assert spark.createDataFrame([(call,)], "c string").select(T.argument_count(F.col("c"))).first()[0] == due


def test_hierarchies_with_cycles_and_depth(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f")], "child string, parent string")
    found = {(r["child"], r["ancestor"]): r["depth"] for r in dispatch.ancestors(pairs).collect()}
    assert found["a", "a"] == 3 and found["a", "d"] == 3 and found["a", "e"] == 4 and ("a", "f") not in found
    assert dispatch.ancestors(pairs.limit(0)).collect() == []


def test_declared_parents(spark):
    files = [("a.ets", "class A extends B implements C, D<X> {\nstruct S {\nclass E\n  extends F {"), ("b.py", "class A extends B {"), ("c.ts", None)]
    found = dispatch.declared_parents(spark.createDataFrame(files, "path string, text string")).collect()
    assert {(r["path"], r["parent"]) for r in found} == {("a.ets", x) for x in "BCDF"}


def test_rounds_stop_each_on_its_own(spark):
    requests = spark.createDataFrame([(1, "diagnosis", 3, 3, 0.5), (2, "design", 3, 2, 0.5), (3, None, 4, 4, 0.5), (4, "design", 0, 3, 0.5)], "request long, goal string, planned int, max_rounds int, novelty_threshold double")
    rows = [(1, 1, i, s, 1.0) for i, s in enumerate(["code", "log", "edge"])] + [(1, 2, 9, "code", 1.0)] + [(2, 1, 1, "code", 1.0), (2, 2, 1, "code", 5.0), (2, 2, 2, "edge", 1.0), (2, 3, 3, "edge", 1.0)] + [(3, 2, 1, "code", 1.0), (3, 1, 1, "code", 1.0), (3, 2, 1, "code", 2.0)]
    run, kept = rounds.executed(spark.createDataFrame(rows, "request long, round int, evidence_id long, source string, score double"), requests)
    assert {(r["request"], r["round"]): r["reason"] for r in run.collect()} == {(1, 1): "sufficient_cross_lane_coverage", (2, 1): None, (2, 2): "max_rounds", (3, 1): None, (3, 2): "no_new_evidence"}
    assert {(r["request"], r["evidence_id"]): (r["score"], r["round"]) for r in kept.collect()} == {(1, 0): (1.0, 1), (1, 1): (1.0, 1), (1, 2): (1.0, 1), (2, 1): (5.0, 2), (2, 2): (1.0, 2), (3, 1): (2.0, 2)}


def test_waves_of_steps(spark):
    rows = [(1, 1, None), (1, 2, [1]), (1, 3, [1, 2]), (1, 4, []), (2, 1, [2]), (2, 2, [1]), (2, 3, [2]), (2, 4, []), (3, 1, [9])]
    found = progress.waves(spark.createDataFrame(rows, "plan long, step long, depends_on array<long>"))
    assert {(r["plan"], r["step"]): r["wave"] for r in found.collect()} == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 4): 1, (2, 1): None, (2, 2): None, (2, 3): None, (2, 4): 1, (3, 1): None}


def test_budgets_of_empty_and_null_records(spark):
    kinds = {
        "log_anchors": "array<struct<evidence_class:string,log_id:long,message:string>>", "code_anchors": "array<struct<file_path:string,symbol:string,excerpt:string>>", "callable": "struct<certainty:string,file_path:string,symbol:string,reasons:array<string>,alternatives:array<string>>",
        "paths": "array<struct<path_id:string,entry:string,emitter:string,relations:array<string>,nodes:array<string>,expected_logs:array<string>,uncertainty:array<string>,projection:string>>",
    } | {g: "array<struct<id:string,fact:string,detail:string>>" for g in budget.GUARDS}
    schema = ", ".join(f"{c} {kinds.get(c, 'array<string>')}" for c in budget.COLUMNS)
    row = dict.fromkeys(budget.COLUMNS)
    logs = [("inferred", 1, "a"), ("inferred", 2, "b"), ("direct", 2, "c"), ("inferred", None, "d")]
    rows = [row, row | {"log_keywords": ["k" * 50] * 40, "log_anchors": logs, "correction_guards": [("g", "f" * 300, "d")] * 5}]
    found = budget.reduced(spark.createDataFrame([tuple(r[c] for c in budget.COLUMNS) for r in rows], schema), F.lit(200)).collect()
    assert (found[0]["reductions"], found[0]["fits"]) == (0, True)
    assert [len(found[1][c]) for c in ("log_keywords", "correction_guards")] == [6, 1] and len(found[1]["correction_guards"][0]["fact"]) == 100
    assert [x["message"] for x in found[1]["log_anchors"]] == ["c", "b"] and found[1]["reductions"] == 18


def test_caps_over_whole_groups(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.choice(["a", "b", "", None]), rng.choice(["x", "y", "z"])) for g in range(3) for i in range(200)] + [(9, i, "code", "x") for i in range(1200)] + [(9, 2000 + i, "log", "y") for i in range(10)]
    df = spark.createDataFrame(rows, "g long, i long, source string, place string")
    for caps, most in (({"source": 2}, 7), ({"source": {"a": 1, "log": 5, "code": 2}, "place": 3}, 8), ({"place": 1, "source": 2}, 4)):
        due = []
        for g in sorted({r[0] for r in rows}):
            seen, taken = {}, 0
            for r in (r for r in rows if r[0] == g):
                keys = [(c, v) for c, v in (("source", r[2]), ("place", r[3])) if c in caps and v]
                limit = lambda c, v: caps[c].get(v, 3) if isinstance(caps[c], dict) else caps[c]  # noqa: B023, E731
                if taken < most and all(seen.get(k, 0) < limit(*k) for k in keys):
                    due.append((g, r[1]))
                    taken += 1
                    for k in keys:
                        seen[k] = seen.get(k, 0) + 1
        found = selection.capped(df.repartition(5), "g", [F.col("i")], caps, most)
        assert sorted((r["g"], r["i"]) for r in found.collect()) == due
