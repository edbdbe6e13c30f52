"""Incident recall, cover of mechanisms and cohorts on small and awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import incidents, index, mechanism
from gleanery.streaming import cohort
from gleanery.streaming import events as streams

INCIDENT = "id long, " + ", ".join(f"{f} string" for f in incidents.FIELDS) + ", status string, capture_mode string, confidence double, updated_at long"


def incident(i, symptom=None, chain=None, status="open", mode="agent_structured", confidence=None, at=0):
    row = dict.fromkeys(incidents.FIELDS) | {"symptom": symptom, "causal_chain": chain}
    return (i, *row.values(), status, mode, confidence, at)


def recalled(spark, rows, queries, most=2):
    df = spark.createDataFrame(rows, INCIDENT)
    fields = list(incidents.FIELDS)
    lengths = df.select(index.passage_length(fields).alias("l")).agg(F.count("*").alias("n"), F.avg("l").alias("mean_len"))
    found = incidents.recall(spark.createDataFrame(list(enumerate(queries)), "request long, query string"), df, index.postings(df, fields), lengths, most)
    told = {}
    for r in found.orderBy("request", "place").collect():
        told.setdefault(r["request"], []).append((r["id"], r["score"], r["reasons"]))
    return told


def test_incidents_fall_back_to_substrings(spark):
    rows = [
        incident(1, "Login timeout", confidence=0.5), incident(2, "login works", at=9), incident(3, "Timeout again", status="stale"), incident(4, "timeout", mode="manual"), incident(5, None, "gateway_proxy fell", at=1), incident(6, None, "GATEWAY_PROXY fell", at=2), incident(7, None, "gateway_proxy", at=3, status="ignored"),
    ]
    told = recalled(spark, rows, ["timeout", "teway_pr", "nothing", "", "a", None, "y_proxy f"])
    assert told == {0: [(1, 6.7, ["exact_incident_symptom", "incident_trace"])]} | {i: [(x, s, r) for x, s, r in told.get(i, [])] for i in (1, 6) if i in told}
    assert 2 not in told and 3 not in told and 5 not in told
    held = incidents.holding(spark.createDataFrame([(1, "teway_pr"), (6, "Y_Proxy f"), (7, "zz"), (8, "y"), (9, "")], "request long, query string"), spark.createDataFrame([(r[0], [r[1], r[6]]) for r in rows], "id long, texts array<string>"))
    assert {(r["request"], r["id"]) for r in held.collect()} == {(1, 5), (1, 6), (1, 7), (6, 5), (6, 6), (8, 5), (8, 6), (8, 7)}


def test_incidents_of_nothing(spark):
    assert recalled(spark, [], ["x y"]) == {} and recalled(spark, [incident(1, "a b")], []) == {}


def test_cover_equals_sets_of_lines(spark):
    rng = random.Random(3)
    span = lambda: (rng.randrange(3), rng.choice("fg"), rng.choice(["S", "s ", "", None]), a := rng.randrange(-3, 150), a + rng.randrange(-4, 130))  # noqa: E731, F841
    asserted = [(c, i, f, s, a, b) for i, (c, f, s, a, b) in enumerate(span() for _ in range(40))]
    shown = [span() for _ in range(60)]
    found = mechanism.covered(spark.createDataFrame(asserted, "case long, assertion long, file_path string, symbol string, a int, b int"), spark.createDataFrame(shown, "case long, file_path string, symbol string, x int, y int"), 16)
    plain = lambda s: (s or "").strip().lower()
    for r in found.collect():
        c, i, f, s, a, b = asserted[r["assertion"]]
        lines = set()
        if a > 0 and b >= a:
            for c2, f2, s2, x, y in shown:
                if (c2, f2) == (c, f) and (not plain(s) or plain(s) == plain(s2)) and x > 0 and y >= x:
                    lines |= set(range(max(a, x), min(b, y) + 1))
        assert (r["matched"], r["covered"], r["lines"]) == (bool(lines), len(lines), max(0, b - a + 1))


@pytest.mark.parametrize("observed, expected, due", [("verified", "supported", True), ("association", "Supported", False), ("rejected", "association", False), ("rejected", "rejected", True), ("guess", "guess", True), (None, None, True), (None, "supported", False), ("verified", "rejected", False), ("x", "", True)])
def test_causal_levels(spark, observed, expected, due):
    assert spark.createDataFrame([(observed, expected)], "a string, b string").select(mechanism.level_reached(F.col("a"), F.col("b"))).first()[0] is due


EVENTS = "cohort long, event_id long, at long, kind string, task_id string, eligibility string, evidence_at long, outcome string"


def test_a_stream_of_cohorts_equals_its_replay(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i % 3, i, i // 2, rng.choice(["enrol", "enrol", "complete"]), rng.choice(["a", "b", "c", "d", None]), rng.choice(["eligible", "excluded"]), i // 2 + rng.choice([-1, 0, 1]), "ok") for i in range(120)]
    df = spark.createDataFrame(rows, EVENTS)
    for part in range(4):  # files in the order of time, one a micro-batch
        df.where(f"event_id >= {part * 30} and event_id < {part * 30 + 30}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.read_events(spark, f"{tmp_path}/in", df.schema, 1)
    found = streams.run_once(cohort.enrolled(stream, 3), f"file://{tmp_path}/out")
    due = cohort.replayed(df, 3)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, due.collect()), key=repr)
    assert {r["reason"] for r in found.select("reason").distinct().collect()} >= {"taken", "open_task", "not_open", "known_task", "evidence_after_cutoff", "finished"}
    assert {(r["entries"] <= 3, r["broken"]) for r in cohort.chain_valid(found).collect()} == {(True, 0)}
    broken = due.withColumn("digest", F.when((F.col("sequence") == 1) & (F.col("kind") == "enrol"), "forged").otherwise(F.col("digest")))
    assert sum(r["broken"] for r in cohort.chain_valid(broken).collect()) > 0
