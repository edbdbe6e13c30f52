"""Results of queries that grew beyond their limits, against brute force, and what keeps them within."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from gleanery import catalog
from gleanery.operators import conflicts, dispatch, progress
from gleanery.streaming import cohort


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ENTITIES = "key long, kind string, name string, owner_name string, qualified_name string, file_path string, signature string"
RELATIONS = "source_key long, relation string, target_key long, target_qualified string, line int, confidence double, arity int"


def hierarchy():
    r = random.Random(3)
    types = [(i, "class", f"T{i}", None, f"T{i}", f"f{i % 3}", None) for i in range(8)]
    methods = [(100 + i, "method", f"m{i % 2}", f"T{r.randrange(8)}", f"M{i}", f"f{r.randrange(3)}", r.choice(["()", "(a)", "broken("])) for i in range(60)]
    up = [(i, "extends", None, f"T{(i - 1) // 2}", 1, 1.0, None) for i in range(1, 8)]
    calls = [(r.choice([100, 101, 102]), r.choice(["calls", "awaits"]), r.choice([None, 100 + r.randrange(60)]), f"T{r.randrange(3)}.m{r.randrange(2)}", r.randrange(5), r.choice([0.2, 0.5, 0.9]), r.choice([None, 0, 1])) for _ in range(150)]
    return types + methods, up + calls


def candidates(entities, relations, most=8):
    """What calls add, told by loops."""
    arity = {"()": 0, "(a)": 1, "broken(": None}
    above = {}
    for i in range(1, 8):
        above[f"T{i}"] = {f"T{(i - 1) // 2}"} | above.get(f"T{(i - 1) // 2}", set())
    known, calls = {}, {}
    for source, relation, target, name, line, confidence, n in (x for x in relations if x[1] in dispatch.CALLS):
        known.setdefault((source, relation), set()).add(target)
        key = (source, relation, *name.split("."), -1 if n is None else n)
        low, high = calls.get(key, (line, confidence))
        calls[key] = min(low, line), max(high, confidence)
    found = {}
    for (source, relation, receiver, method, n), (line, confidence) in calls.items():
        rest = sorted((e[5], e[4], e[6], e[0]) for e in entities if e[1] == "method" and e[2] == method and receiver in above.get(e[3], ()) and n in (-1, arity[e[6]]))
        rest = [x for x in rest if x[3] not in known[source, relation]]
        for _, name, _, key in rest[:most]:
            row = line, -min(confidence, 0.55), len(rest) > most, name
            found[source, relation, key] = min(found.get((source, relation, key), row), row)
    return {(*k, v[0], -v[1], v[2], v[3]) for k, v in found.items()}


@pytest.mark.parametrize("listed", [64, 12])  # with 12, sources that reach many methods meet them row by row
def test_dispatch_candidates_equal_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(dispatch, "LISTED", listed, raising=False)
    entities, relations = hierarchy()
    found = dispatch.dispatch_candidates(spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(relations, RELATIONS))
    rows = found.where("relation <> 'dispatches_via'").select("source_key", "relation", "target_key", "line", "confidence", "truncated", "target_qualified")
    assert {tuple(x) for x in rows.collect()} == candidates(entities, relations)


def test_candidates_stay_with_their_calls(spark):
    """Calls move to their sources once; the candidates, up to eight a call, are never dealt anew."""
    entities, relations = hierarchy()
    found = dispatch.dispatch_candidates(spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(relations[:60], RELATIONS))
    above, generated, _ = plan_of(found).partition("Generate")
    assert generated and "Exchange" not in above


PARTS = "id long, experience_type string, trigger_condition string, scope string, repair_action string"


def procedures(n, seed=6):
    r = random.Random(seed)
    words = lambda pool, k: " ".join(r.choice(pool) for _ in range(k))
    kinds = ["procedure_experience", "correction_experience", "semantic_patch_experience"]
    return [(i, r.choice(kinds), r.choice([None, "", "when a b c d breaks", "when a b c e breaks", "when d breaks"]), r.choice([None, "x y", "y x", "x z w", ""]), r.choice([None, words("pqrs", 3)])) for i in range(n)]


def conflicting(rows):
    sets = lambda t: {*t.split()}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    rows = [x for x in rows if None not in x and x[1] != "semantic_patch_experience"]
    near = lambda x, y: [jac(sets(x[i]), sets(y[i])) for i in (2, 3, 4)]
    met = ((x[0], y[0], near(x, y)) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[4] != y[4])
    return sorted((a, b) for a, b, (t, s, r) in met if t >= 0.6 and s >= 0.3 and r < 0.75)


def test_conflicting_procedures_equal_brute_force(spark):
    rows = procedures(160)
    found = conflicts.conflicting_procedures(spark.createDataFrame(rows, PARTS), 0.6, 0.3)
    assert sorted(map(tuple, found.collect())) == conflicting(rows) != []


def test_records_that_say_the_same_are_compared_once(spark, monkeypatch):
    """Triggers are compared once each, however many records have them."""
    cases = [("procedure_experience", "when a breaks", "x", f"{x} is put right") for x in "abcd"]
    rows = [(60 * i + j, *c) for i, c in enumerate(cases) for j in range(60)] + [(1000, "procedure_experience", "when a breaks", "x", "replace q at once")]
    compared, pairs = [], conflicts.similar_pairs
    monkeypatch.setattr(conflicts, "similar_pairs", lambda df, *a: (compared.append(df.count()), pairs(df, *a))[1])
    found = conflicts.conflicting_procedures(spark.createDataFrame(rows, PARTS))
    assert sorted(map(tuple, found.collect())) == conflicting(rows) != []
    assert compared == [1]


def sent_through_driver(plan: str) -> list[set[str]]:
    """What each broadcast of a plan reads: of tables what their columns begin with."""
    found, depth = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is None and "BroadcastExchange" in line:
            depth = at
            found.append(set())
        elif depth is not None:
            found[-1] |= {*re.findall(r"FileScan parquet \[([a-z]+)_", line)}
    return found


@pytest.mark.parametrize("name", ["rk33_localised", "rk36_code_focus"])
def test_large_tables_do_not_go_through_the_driver(spark, tmp_path, monkeypatch, name):
    """However small the files look, parts and items are not sent, but for the parts that requests (of nations) name."""
    (tmp_path / "data").symlink_to("/root/testdata/sf0.001")
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(plan_of(self._df)), write(self, *a, **k))[1])
    plans.append(plan_of(catalog.queries()[name](spark, str(tmp_path / "data"))))
    sent = [t for p in plans for t in sent_through_driver(p)]
    assert all("n" in t or not {"p", "l"} & t for t in sent) and any("BroadcastHashJoin" in p for p in plans)


def told_plans(spark, seed=11):
    """Steps in chains and circles, with evidence of all kinds; plans without steps, and steps, errors and tests without a plan."""
    r = random.Random(seed)
    steps = [(p, i, r.randrange(4), r.choice(["add", "modify", "review_consumer", "verify"]), r.choice(["symbol:a", "test:1", "observe:2", "b"]), r.choice(["f", "g", "", None]), r.choice([None, [], [r.randrange(8)], [max(0, i - 1), r.randrange(6)], [None]]) if i else []) for p in range(40) for i in range(r.randrange(1, 8))]
    some = lambda k, values: [(p, r.choice(values)) for p in range(42) for _ in range(k) if r.random() < 0.5]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return (
        table([(p, f"r{p % 3}") for p in range(5, 45)], "plan long, revision string"), table(steps, "plan long, step long, position long, operation string, target string, file_path string, depends_on array<long>"),
        table(some(3, range(6)), "plan long, step long"), table(some(1, ["f", "g"]), "plan long, path string"), table(some(1, ["symbol:a", "b"]), "plan long, target string"), table(some(2, ["1", "2"]), "plan long, ref string"),
        table([(*x, r.choice(["complete", "partial"])) for x in some(2, ["f", "g"])], "plan long, path string, state string"), table(some(1, ["e", "d"])[::4], "plan long, code string"),
        table([(p, int(p % 9 == 0), f"r{p % 3 if p % 7 else 9}") for p in range(43)], "plan long, failed int, revision string"),
    )


def test_progress_in_rows_equals_progress_in_rounds(spark, monkeypatch):
    tables, told = told_plans(spark), []
    for large in (32, 3, 0):
        monkeypatch.setattr(progress, "LARGE", large, raising=False)
        told.append([sorted(map(repr, map(tuple, df.collect()))) for df in progress.progress(*tables)])
    assert told[0] == told[1] == told[2] and {r["status"] for r in progress.progress(*tables)[0].collect()} == {*progress.STATUSES}


def test_steps_of_a_plan_move_once(spark, tmp_path, monkeypatch):
    """One table is written, whose plan deals items and orders to their plans and joins the two once."""
    (tmp_path / "data").symlink_to("/root/testdata/sf0.001")
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(plan_of(self._df)), write(self, *a, **k))[1])
    found = catalog.queries()["xo21_step_progress"](spark, str(tmp_path / "data"))
    plans.append(plan_of(found))
    assert found.count() == 6000 and len(plans) == 2 and "Exchange" not in plans[-1]
    assert plans[0].count("FileScan parquet [l_orderkey") == 1


def test_events_of_a_cohort_merge_from_runs_on_disk():
    """Frames in any order, with ties of time, come sorted, and no more than a stretch of each run is held."""
    r = random.Random(9)
    rows = [(r.randrange(300), i, r.choice(["enrol", "complete", None])) for i in range(5000)]
    r.shuffle(rows)
    frames = (pd.DataFrame(rows[i : i + 700], columns=["at", "event_id", "kind"]) for i in range(0, 5000, 700))
    found = list(cohort.ordered(frames, run=1000, step=50))
    assert [(*x[:2], None if pd.isna(x[2]) else x[2]) for f in found for x in f.itertuples(index=False)] == sorted(rows, key=lambda x: x[:2])
    assert max(map(len, found)) <= 6 * 50


@pytest.mark.parametrize("rows", [[], [(5, 1)], [(5, 2), (5, 1)]])
def test_few_events_of_a_cohort(rows):
    frames = [pd.DataFrame(rows, columns=["at", "event_id"])]
    assert [x for f in cohort.ordered(frames) for x in f.itertuples(index=False, name=None)] == sorted(rows)
