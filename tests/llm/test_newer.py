"""Infill, class-based language model and vector codes against brute force, on awkward rows too."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from gleanery.llm import infill, vectors

TEXTS = ["", None, " ", "one", " one two\n", "a  b\tc\n\nd ", "x" * 5000, "é ü 日本 😀 ", "has <P> mark", "ends with <S", "\x0b\x0c mixed\r\n", " " * 70_000, "word " * 30_000, "nbsp joins words"]
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(120)] + [(None, "a b c d"), (3, "again and again"), (3, "again and again")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'f' AS form", "'o' AS output", "'k' AS key")


# --- 11 -------------------------------------------------------------------------------------------------------------


def naive_infill(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_agrees_with_lists_of_units(awkward):
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    found = Counter(tuple(r) for r in infill.digests(infill.transform(awkward)).collect())
    due = Counter()
    for r in awkward.select("doc_id", "text").collect():
        *counts, output = naive_infill(r["doc_id"], r["text"])
        due[(r["doc_id"], *counts, sha(output), sha(r["text"]))] += 1
    assert found == due
    assert {f for _, _, f, *_ in found} == {"plain", "psm", "spm"}


def test_infill_restores_texts_whose_parts_end_like_marks(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["<", "P", "S", ">", " ", "<S", "M>", "\n"]) for _ in range(30))) for i in range(400)]
    found = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), rate=100)
    back = found.select("doc_id", infill.restored(found["output"], found["form"]).alias("text"), "form").collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(rows)
    assert sum(r["form"] != "plain" for r in back) > 100


def test_infill_stops_at_the_second_rank():
    text = "a b c " + "d " * 10
    assert infill.places(text, 0, 0) == (0, 0) and infill.places(text, 1, 3) == (1, 5) and infill.places(text, 2, 2) == (3, 3)
    assert infill.rearranged(text, (3, 1, 0, 99), 50, 80) == (14, "psm", 1, 4, "<P>a<S>" + text[5:] + "<M> b c")


def test_infill_of_nothing(spark):
    assert infill.digests(infill.transform(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


# --- 13 -------------------------------------------------------------------------------------------------------------


def naive_codes(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, in Python integers."""
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    if not good:
        return [], []
    first = min(good, key=order)
    good = [r for r in good if len(r[1]) == len(first[1])]
    w = len(first[1]) // parts
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(parts)]
    good = [(i, cut(v), label) for i, v, label in sorted(good, key=order)]
    books = [[r[1][p] for r in good[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for r in good:
                groups.setdefault(near(r[1][p], book)[1], []).append(r[1][p])
            for k, members in groups.items():
                book[k] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
    out = []
    for i, v, label in good:
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    errors = Counter()
    for _, label, _, e in out:
        errors[label] += e
    return [(i, code, e, errors[label]) for i, label, code, e in out], books


def sha_of(books):
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


@pytest.mark.parametrize("seed, n, width", [(1, 150, 2), (2, 40, 1), (3, 90, 4)])
def test_codes_agree_with_measuring_every_entry(spark, seed, n, width):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0, rng.uniform(-1, 1)]) for _ in range(16 * width)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(500, None, 1), (501, [float("nan")] * 16 * width, 1), (502, [float("inf")] + [0.0] * (16 * width - 1), 1), (503, [None] * 16 * width, 1), (504, [1.0] * 8, 1), (-1, rows[0][1], 9), (-1, rows[1][1], 9), (None, rows[2][1], None), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS part", "'c' AS code", "2 AS error", "3 AS `of`").repartition(3)
    due, books = naive_codes(rows)
    found = vectors.codes(df).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found) == Counter(due)
    assert {r["codebooks_sha256"] for r in found} == {sha_of(books)}


def test_codes_of_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.codes(spark.createDataFrame([], schema)).collect() == []
    assert vectors.codes(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    same = [(i, [0.5] * 32, None) for i in range(70)]
    rows = vectors.codes(spark.createDataFrame(same, schema)).collect()
    assert len(rows) == 70 and {(r["code"], r["error"], r["label_error"]) for r in rows} == {("00" * 16, 0, 0)}
    with pytest.raises(ValueError, match="equal parts"):
        vectors.codes(spark.createDataFrame([(1, [0.5] * 5, 1)], schema))


def test_the_annulus_loses_no_entry():
    import numpy as np

    rng = np.random.default_rng(5)
    for scale in (1, 30, 10**6, vectors.bound(4)):
        entries, parts = rng.integers(-scale, scale + 1, (64, 4)), rng.integers(-scale, scale + 1, (500, 4))
        entries[9] = entries[3]
        index, error = vectors.Codebook(entries).nearest(parts)
        all_of_them = ((parts[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert error.tolist() == all_of_them.min(1).tolist()
        assert index.tolist() == [int(np.flatnonzero(d == d.min())[0]) for d in all_of_them]


def test_label_errors_by_either_join(spark, monkeypatch):
    coded = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3 if i < 90 else i, "00", i) for i in range(120)], "vec_id long, label long, code string, error long")
    small = sorted(map(tuple, vectors.with_label_error(coded).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(vectors, "LARGE", 12)
    assert sorted(map(tuple, vectors.with_label_error(coded).select("vec_id", "label", "code", "error", "label_error").collect()), key=str) == sorted(small, key=str)


# --- 12 -------------------------------------------------------------------------------------------------------------


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def corpus(n=160, seed=3):
    """Two invented languages, each with nouns that follow articles."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        if i % 2:
            words = [w for _ in range(rng.randint(0, 60)) for w in (rng.choice(["the", "A", "an"]), rng.choice(["cat", "dog", "Ox", f"beast{rng.randint(0, 99)}"]))]
        else:
            words = [w for _ in range(rng.randint(0, 60)) for w in (rng.choice(["der", "die", "das"]), rng.choice(["Hund", "Katze", f"Tier{rng.randint(0, 99)}", "Ochse"]))]
        rows.append((i, " ".join(words)))
    return rows


def naive_scores(rows, group, classes_n):
    """Scores by plain dictionaries, given the class of each word."""
    import zlib

    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    train = [tokens_of(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    size, words = Counter(), Counter()
    for w, c in count.items():
        size[group[w]] += c
        words[group[w]] += 1
    pairs = Counter((group[a], group[b]) for t in train for a, b in zip(["", *t[:-1]], t, strict=True))
    before, after, total = Counter(), Counter(), sum(pairs.values())
    for (a, b), c in pairs.items():
        before[a] += c
        after[b] += c
    share = lambda c: (after[c] + 1) / (total + classes_n)
    move = lambda p, c: share(c) if p is None else (pairs[p, c] + classes_n * share(c)) / (before[p] + classes_n)
    mass = lambda c: size[c] + 0.1 * (words[c] + 1)
    out = []
    for i, text in rows:
        tokens, last, score = tokens_of(text), group.get("") if count[""] else None, 0.0
        for w in tokens:
            c = group[w] if count[w] else None
            p = sum(move(last, k) * 0.1 / mass(k) for k in range(classes_n)) if c is None else move(last, c) * (count[w] + 0.1) / mass(c)
            score, last = score + math.log10(p), c
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, held(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6), round(score, 6)))
    return out


def learnt(spark, rows, **how):
    """The class of each word that the operator learns from rows."""
    import numpy as np

    from gleanery.llm import classes
    from gleanery.llm.common import words_of

    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = classes.learn(*classes.chunked(df, classes.held_out(df["doc_id"])), **how)
    found = dict(zip(model.frequent.value.words.tolist(), model.classes.value.tolist(), strict=False))
    rarer = {r["word"] % (1 << 64): r["class"] for r in model.rarer.collect()}
    assert not found.keys() & rarer.keys()
    group = {"": 0}
    for w in {w for _, t in rows for w in tokens_of(t) if w}:
        h = int(np.maximum(words_of([w.encode()], lower=True)[0], 1)[0])
        group[w] = (found | rarer).get(h)
    return group, len(found), len(rarer)


@pytest.mark.parametrize("share", [1 << 18, 60])
def test_scores_agree_with_dictionaries(spark, share):
    from gleanery.llm import classes

    rows = [*corpus(), (None, "the cat"), (7, "twice"), (7, "twice"), (900, None), (901, ""), (902, " \t\n"), (903, "unseen words only"), (904, "the cat sat " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS word", "3 AS held", "4 AS chunk")
    group, often, seldom = learnt(spark, rows, classes=8, share=share)
    assert (seldom == 0) == (share == 1 << 18) and often > 8
    found = sorted(map(tuple, classes.score(df.repartition(3), classes=8, share=share).collect()), key=repr)
    due = sorted(naive_scores(rows, group, 8), key=repr)
    assert [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in found] == due


def test_classes_raise_the_likelihood_of_held_out_texts(spark):
    from gleanery.llm import classes

    rows = corpus(600)
    group, *_ = learnt(spark, rows, classes=14)
    english, german = (Counter(group[f"{w}{i}"] for i in range(100)) for w in ("beast", "tier"))
    assert (english & german).total() <= 5  # nouns of the two languages hardly share a class
    assert not {group[a] for a in ("the", "a", "an", "der", "die", "das")} & (english.keys() | german.keys())
    held = classes.score(spark.createDataFrame(rows, "doc_id long, text string"), classes=14).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert 10 ** ((held["s"] - held["b"]) / held["n"]) > 2  # perplexity is less than half of that of single words


def test_best_classes_are_those_of_the_likelihood_from_scratch():
    import numpy as np

    from gleanery.llm import classes

    rng = np.random.default_rng(2)
    words, size = 14, 6
    own = np.concatenate([[0], rng.integers(1, size - 1, words - 2), [size - 1]])  # the end, words, the rarer words
    pairs = rng.integers(0, 6, (words, words)) * (rng.random((words, words)) < 0.5)
    cells = lambda g: sum(pairs[a, b] * np.outer(np.eye(size)[g[a]], np.eye(size)[g[b]]) for a in range(words) for b in range(words))
    apart = pairs * (1 - np.eye(words, dtype=np.int64))
    ones = np.eye(size, dtype=np.int64)[own]
    left, right = apart.T @ ones, apart @ ones
    n = np.maximum(pairs.sum(0), pairs.sum(1))
    np.fill_diagonal(pairs, 0)
    who = np.arange(1, words - 1)
    # The marginals of both sides move by n each; make them agree by counting only what stands on both sides.
    for w in who:
        gains = []
        for c in range(1, size - 1):
            moved = own.copy()
            moved[w] = c
            matrix = cells(moved)
            gains.append((classes.phi(matrix).sum(), c, matrix))
        best, _ = classes.best_classes(own[[w]], np.array([0]), left[[w]], right[[w]], cells(own))
        inner = [round(g, 6) for g, *_ in gains]
        assert round(gains[int(best[0]) - 1][0], 6) == max(inner), w
    assert n.min() >= 0


def test_scores_without_anything_to_learn_from(spark):
    from gleanery.llm import classes

    assert classes.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only_held = [(i, "some words") for i in range(300)]
    df = spark.createDataFrame(only_held, "doc_id long, text string")
    rows = classes.score(df.where(classes.held_out(df["doc_id"]))).collect()
    assert rows and {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows} == {(0, 0, 0.0, 0.0)}
    nulls = classes.score(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")).collect()
    assert {r["n_tokens"] for r in nulls} == {1}


def test_a_hash_of_two_words_is_seen(spark):
    from gleanery.llm import classes

    df = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string").coalesce(1)
    chunks = classes.chunked(df, classes.held_out(df["doc_id"]))[0]
    row = chunks.first()
    same = spark.createDataFrame([row.asDict() | {"words": row["words"], "checks": bytes(len(row["checks"])), "chunk": 9}, row.asDict()], chunks.schema)
    assert classes._vocabulary_of(same)[1] and not classes._vocabulary_of(chunks)[1]
    other = chunks.sparkSession.createDataFrame(df.collect(), df.schema).selectExpr("doc_id", "false AS held", "text").mapInArrow(classes._chunks(1 << 20, 1), classes.CHUNKS)
    assert {r["n"] for r in classes._vocabulary_of(other)[0].where("word <> 0").collect()} == {1}


def test_sums_are_given_out_in_bounds(monkeypatch):
    import numpy as np

    from gleanery.llm import classes

    monkeypatch.setattr(classes, "HELD", 100)
    sums, total = classes._Sums(), Counter()
    rng = np.random.default_rng(0)
    for _ in range(50):
        codes = rng.integers(0, 500, 40)
        if sums.add(codes, np.ones(40)):
            total.update(dict(zip(*(x.tolist() for x in sums.taken()), strict=True)))
        assert sums.rows <= 140
    total.update(dict(zip(*(x.tolist() for x in sums.taken()), strict=True)))
    assert sum(total.values()) == 2000


# --- 7: text that markup must not take away, and pages that must not take long ------------------------------------------

ARTICLE = "<html><body><article><h1>T</h1>{}<p>Other text that is long enough to be read as an article, with words and words.</p></article></body></html>"


@pytest.mark.parametrize(
    "markup, text",
    [
        ('<p title="the hidden treasure">Found it.</p>', "Found it."), ('<p data-hidden="false">Kept one.</p>', "Kept one."), ('<div data-id="sidebar"><p>Kept two.</p></div>', "Kept two."), ('<p class="comment">Kept three.</p>', "Kept three."),
        ('<p>Press <span class="menu">File</span> then <b class="alert">stop</b> now.</p>', "Press File then stop now."), ("<p alt='hidden' class=x>Kept four.</p>", "Kept four."), ("<p hidden>gone</p>", None), ('<p aria-hidden="true">gone</p>', None),
        ('<div class="comments"><p>gone</p></div>', None), ('<p STYLE="display: none">gone</p>', None), ('<div class="x" class="ad"><p>Kept five.</p></div>', "Kept five."),
    ],
)
def test_article_text_stays(markup, text):
    from gleanery.llm import pages

    lines = pages.main_text(ARTICLE.format(markup)).split("\n")
    assert lines == ["T", *([text] if text else []), "Other text that is long enough to be read as an article, with words and words."]


def test_deep_and_stray_tags_take_time_in_proportion():
    import time

    from gleanery.llm import pages

    for page in (lambda n: "<div>" * n + "text " * 50 + "</b>" * n, lambda n: "<div>" * n + "text" + "</div>" * n, lambda n: "<nav>" * n + "x" + "</nav></i>" * n + "<p>some text here</p>"):
        took = []
        for n in (4000, 32_000):
            began = time.process_time()
            pages.main_text(page(n))
            took.append(time.process_time() - began)
        assert took[1] < 30 * took[0] + 0.2
