"""An index that follows its table equals one that is built anew, whatever the order of changes."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import index, upkeep

FIELDS = ["title", "body"]
SCHEMA = "id long, title string, body string"


def built(spark, rows, path):
    return upkeep.rebuild(spark.createDataFrame(rows, SCHEMA), FIELDS, path, "r")


def content(found):
    return sorted(map(tuple, found.postings.select("id", "field", "term", "tf", "doc_len").collect())), sorted(map(tuple, found.lengths.select("id", "doc_len").collect()))


def due(spark, state):
    df = spark.createDataFrame([(i, *t) for i, t in state.items()], SCHEMA)
    lengths = df.select("id", index.passage_length(FIELDS).cast("long").alias("doc_len"))
    return sorted(map(tuple, index.postings(df, FIELDS).select("id", "field", "term", "tf", "doc_len").collect())), sorted(map(tuple, lengths.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_a_full_build(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(upkeep, "MANY", 4)
    rng, path = random.Random(seed), f"file://{tmp_path}/i"
    word = lambda: " ".join(rng.choice(["red", "Blue", "键盘输入", "gear", ""]) for _ in range(rng.randint(0, 5))) or None
    state = {i: (word(), word()) for i in range(12)}
    built(spark, [(i, *t) for i, t in state.items()], path)
    for turn in range(5):
        changes = []
        for sequence in range(8):
            i, op = rng.randrange(16), rng.choice(["insert", "update", "delete"])
            text = (word(), word())
            changes.append((i, op, sequence, *text))
            if op == "delete":
                state.pop(i, None)
            else:
                state[i] = text
        df = spark.createDataFrame(changes, "id long, op string, sequence long, title string, body string")
        found = upkeep.apply(df, path, str(turn))
        assert content(upkeep.opened(spark, path)) == due(spark, state)
        if turn == 2:  # a batch may come twice
            upkeep.apply(df, path)
            assert content(upkeep.opened(spark, path)) == due(spark, state)
        assert len(found.segments) < 4
    upkeep.merge(spark, path)
    assert content(upkeep.opened(spark, path)) == due(spark, state) and len(upkeep.current(spark, path).segments) == 1


def test_a_reader_keeps_its_generation(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    built(spark, [(1, "red gear", None), (2, "blue", "red")], path)
    before = upkeep.opened(spark, path)
    change = spark.createDataFrame([(1, "delete", 1, None, None), (3, "insert", 1, "red", "red"), (None, "insert", 1, "x", "y"), (9, "delete", 1, None, None)], "id long, op string, sequence long, title string, body string")
    found = upkeep.apply(change, path, "later")
    assert (found.generation, found.indexed, found.retired, found.source_revision) == (2, 2, 1, "later")
    assert [r["id"] for r in before.lengths.orderBy("id").collect()] == [1, 2]
    now = upkeep.opened(spark, path)
    assert [r["id"] for r in now.lengths.orderBy("id").collect()] == [2, 3]
    hits = index.bm25(now.postings, now.statistics(), ["red"], {"title": 2.0, "body": 1.0}, 10).collect()
    assert {r["id"] for r in hits} == {2, 3}


def test_two_writers_of_one_generation(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    built(spark, [(1, "red", None)], path)
    old = upkeep.current(spark, path)
    upkeep.merge(spark, path)
    monkeypatch.setattr(upkeep, "current", lambda *_: old)
    with pytest.raises(RuntimeError, match="another writer"):
        upkeep.merge(spark, path)


def test_vacuum_keeps_what_the_last_generations_list(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    with pytest.raises(RuntimeError, match="no index"):
        upkeep.opened(spark, path)
    built(spark, [(1, "red", None)], path)
    for i in range(3):
        built(spark, [(i, "blue", "x"), (i + 1, None, None)], path)
    assert upkeep.vacuum(spark, path, 2) == 2
    assert upkeep.current(spark, path).generation == 4 and upkeep.opened(spark, path).lengths.count() == 2


def test_an_empty_index(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    built(spark, [], path)
    assert upkeep.opened(spark, path).postings.count() == 0
    upkeep.apply(spark.createDataFrame([], "id long, op string, sequence long, title string, body string"), path)
    assert upkeep.opened(spark, path).lengths.count() == 0


def test_token_counts_without_tokens(spark):
    from gleanery.functions import text as T

    rows = [("",), (None,), ("a bc",), ("键盘 输 入ab c",), ("x键y-键",), ("Straße 漢字仮名",)]
    found = spark.createDataFrame(rows, "t string").select(F.size(T.tokens(F.coalesce("t", F.lit("")))).alias("a"), T.token_count(F.coalesce("t", F.lit(""))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in found)
