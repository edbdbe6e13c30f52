from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from gleanery import catalog
from gleanery.functions import text as T
from gleanery.operators import graph, ranking, tables
from gleanery.plans import views
from gleanery.sources import records
from gleanery.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_keep_accents_and_split_cjk(spark):
    assert one(spark, T.tokens(F.lit("Été foo_1, 日志分析!"))) == ["été", "foo_1", "日志分析", "日志", "志分", "分析"]


def test_identifiers(spark):
    assert one(spark, T.identifier_parts(F.lit("parseHTTPRequest_v2"))) == ["parse", "http", "request", "v2"]
    assert one(spark, T.identifier_parts(F.lit("plain"))) == []


def test_singular(spark):
    found = [one(spark, T.singular(F.lit(w))) for w in ("queries", "files", "class", "status", "ies", "is")]
    assert found == ["query", "file", "class", "status", "ies", "is"]


def test_lists_keys_and_presence(spark):
    assert one(spark, T.unique_list(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("b ")))) == ["a", "b"]
    assert len(one(spark, T.event_key(F.lit("a"), F.lit(1)))) == 32
    assert [one(spark, T.present(F.lit(v))) for v in ("x", " ", "[]", "{}", None)] == [True, False, False, False, False]
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_insert_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a"), (2, None)], "id long, k string")
    new = spark.createDataFrame([(3, "a"), (4, "b"), (5, "b"), (6, None)], "id long, k string")
    once = tables.insert_new(now, new, "k", [F.col("id")])
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 4, 6]


def test_chain_breaks_finds_altered_missing_and_reordered_entries(spark):
    rows = [("ok", 1, "a", None), ("ok", 2, "b", "a"), ("altered", 1, "a", None), ("altered", 2, "b", "x"), ("missing", 1, "a", None), ("missing", 3, "c", "b"), ("reordered", 1, "b", "a"), ("reordered", 2, "a", None)]
    found = tables.chain_breaks(spark.createDataFrame(rows, "g string, n long, digest string, previous string"), "g", "n", "digest", "previous")
    assert {r["g"]: tuple(r)[1:] for r in found.collect()} == {"ok": (2, 0, 0), "altered": (2, 1, 0), "missing": (2, 1, 1), "reordered": (2, 2, 0)}


def test_reachable_follows_deep_chains_and_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 3), (30, 31)], "source long, target long")
    found = graph.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    assert sorted(r["node"] for r in found.collect()) == list(range(1, 21))


def test_gr14_goes_beyond_two_steps(spark, monkeypatch):
    chain = spark.createDataFrame([(f"region:{i}", f"region:{i + 1}") for i in range(5)], "source string, target string")
    monkeypatch.setattr(views, "places", lambda s, d: chain)
    assert sorted(r["node"] for r in catalog.queries()["gr14_reachable"](spark, "").collect()) == [f"region:{i}" for i in range(1, 6)]


def test_similar_sets(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c"]), (3, ["x"])], "id long, t array<string>")
    assert [tuple(r) for r in ranking.similar_sets(df, "id", "t", 0.55).collect()] == [(1, 2, 0.75)]


def test_files_and_notes(spark, tmp_path):
    (tmp_path / "src" / "build").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.bin").write_text("no")
    (tmp_path / "src" / "build" / "c.py").write_text("no")
    found = records.project_files(spark, str(tmp_path / "src"), [".py"], ["build"]).collect()
    assert [r["text"] for r in found] == ["x = 1\n"]
    records.write_notes(spark.createDataFrame([("t", "b", "fact")], "title string, body string, kind string"), str(tmp_path / "out"), "title", "body", "kind")
    assert any("# t" in p.read_text() for p in (tmp_path / "out" / "kind=fact").glob("*.txt"))


def test_history_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"op": "a", "ms": 1}\nnot json\n{"op": "b", "ms": 2}\n')
    assert records.history(spark, str(tmp_path / "h.jsonl"), "op string, ms long").count() == 2


def test_stream_counts_each_event_once(spark, tmp_path):
    schema = StructType([StructField("event_key", StringType()), StructField("user_id", LongType()), StructField("ts", TimestampType())])
    rows = [("a", 1, datetime(2024, 1, 1, 0, 0)), ("a", 1, datetime(2024, 1, 1, 0, 1)), ("b", 1, datetime(2024, 1, 1, 0, 2))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.once_each(events.read_events(spark, str(tmp_path / "in"), schema), "event_key", "ts")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["event_key"] for r in spark.table("once").collect()) == ["a", "b"]
