"""Awkward tables and texts, brute-force versions of learnt models, and the registered queries themselves."""

import hashlib
import html as references
import re
import time
from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gleanery.llm import agenda, language, near, packing, pages, pii, quality, queries, token_counts
from gleanery.llm.vocabularies import vocabulary

from .test_operators import SMALL, base_spans, brute_components

T = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
U = T.translate(str.maketrans("ab", "ba"))


# --- 1 --------------------------------------------------------------------------------------------------------------


def test_pii_takes_linear_time():
    for text in ("strasse" * 150_000, "IBAN-" * 200_000, "a://" * 250_000, " Street" * 150_000, "1." * 500_000, "@a" * 500_000, "A.B" * 300_000 + "://"):
        began = time.time()
        pii.spans_of(text)
        assert time.time() - began < 20


def test_pii_parsers_without_caps():
    part = lambda t, kind: [t[a:b] for a, b in pii.spans_of(t)[kind]]
    assert part("x" * 60 + "://host/a.", "url") == ["x" * 60 + "://host/a"]
    assert part("at 12 " + "A" + "b" * 500 + " Street.", "address") == ["12 A" + "b" * 500 + " Street"]
    assert part("12 One Two Three Four Street", "address") == []
    assert part("Langestrasse 5 und Hauptstrasse 7", "address") == ["Langestrasse 5", "Hauptstrasse 7"]


def test_pii_fuzz():
    import random

    r = random.Random(3)
    for _ in range(5000):
        t = "".join(r.choice(["a", "@", ".", "1", "23", "4111 1111 1111 1111", "+1 ", "-", " ", "x@y.z", "(", "10.0.0.1", "strasse", "://", "é"]) for _ in range(r.randint(1, 14)))
        got = pii.spans_of(t)
        assert [f"{k}:{a}:{b}" for k in pii.BASE for a, b in got[k]] == base_spans(t)


# --- 2 --------------------------------------------------------------------------------------------------------------


def components(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()}


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a b c d e f")],
        [(1, "a b c d e f"), (2, "q w e r t y")],
        [(1, "a b c d e f"), (2, "a b c d e f")],
        [(1, "one two three four " + T), (2, "one two three four " + U)],
        [(i, " ".join([*(f"w{k}" for k in range(60)), f"own{i}"])) for i in range(80)],
    ],
    ids=["one", "distinct", "copies", "thue-morse", "own words"],
)
def test_near_duplicates_of_awkward_tables(spark, rows):
    assert components(spark, rows) == brute_components(rows)


def test_near_duplicates_in_small_blocks_and_two_steps(spark, monkeypatch):
    import random

    r = random.Random(1)
    rows = []
    for g in range(8):
        base = [f"g{g % 4}_{i}" for i in range(30)] + [f"h{g}_{i}" for i in range(14)]
        for _ in range(18):
            x = list(base)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = f"z{r.randrange(60)}"
            rows.append((len(rows), " ".join(x)))
    for name, value in (("BLOCK_DOCS", 8), ("HOP", 0), ("RANGE", 64), ("HOT_LEAST", 20), ("HOT_IN_FLUSH", 2)):
        monkeypatch.setattr(near, name, value)
    assert components(spark, rows) == brute_components(rows)


def test_near_copies_meet_in_proportion(spark, monkeypatch):
    met = []
    compared = near._compared
    monkeypatch.setattr(near, "_compared", lambda m, *rest: (met.append(m.count()), compared(m, *rest))[1])
    rows = [(i, " ".join(f"w{k}" if k != i % 200 else f"o{i}" for k in range(200))) for i in range(1200)]
    assert set(components(spark, rows).values()) == {0}
    assert sum(met) < 1.2 * len(rows)


def test_near_copies_of_the_least_size(spark):
    rows = []
    for k, n in enumerate((5, 8, 9, 12, 40, 41, 100, 101, 333)):
        words = [f"t{k}_{i}" for i in range(n)]
        sets = n - 4
        least = -(-3 * sets // 4)  # of a part of the text, exactly enough shingles, and one too few
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[n - least - 4 :])), (10 * k + 2, " ".join(words[: least + 3]))]
    assert components(spark, rows) == brute_components(rows)


def test_documents_without_a_partner_send_their_prefixes_only(spark):
    import random

    r = random.Random(2)
    notice = " ".join(f"n{i}" for i in range(24))
    rows = [(7 * i, " ".join([*(f"w{r.randrange(10**6)}" for _ in range(200)), notice])) for i in range(120)]
    rows += [(10_000, rows[5][1] + " and some more words"), (10_001, "other words first " + rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
    kept = near.partnered(df, 220 * len(rows), none).collect()
    assert sorted(x["doc_id"] for x in kept) == [35, 63, 10_000, 10_001]
    assert {x["n"] for x in kept} == {220, 224, 223}
    assert components(spark, rows) == brute_components(rows)


def test_dealt_bytes_do_not_grow_with_ranges(spark):
    rows = [(i, " ".join(f"d{i}_{k}" for k in range(154))) for i in range(2000)]
    batch = pa.record_batch({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.uint8)))

    def sent(dealt) -> float:
        columns = [x for b in dealt(iter([batch])) for row in b.to_pylist() for x in row.values() if isinstance(x, bytes)]
        return len(pa.compress(b"".join(columns), "lz4", asbytes=True)) / (150 * len(rows))

    assert sent(near._prefixes(5, 75, 2, none)) < 1.8
    assert sent(near._prefixes(5, 75, 10, none)) < 2.8
    assert sent(near._dealt(5, 10, none)) < 1.4 * sent(near._dealt(5, 2, none))


@pytest.mark.parametrize("ids", [[], [3], [-(2**63), -5, 0, 7, 2**63 - 1], list(range(100, 5000, 3))])
def test_planes_read_back(ids):
    x = np.array(ids, np.int64)
    assert near.ids_from(near.id_planes(x)).tolist() == ids
    assert near.from_planes(near.planes(x & 0xFFFF, "<u4"), "<u4").tolist() == (x & 0xFFFF).tolist()


def test_only_documents_that_share_tokens_meet_across_blocks(spark, monkeypatch):
    met = []
    compared = near._compared
    monkeypatch.setattr(near, "_compared", lambda m, *rest: (met.append(m.count()), compared(m, *rest))[1])
    # Six groups of documents around a text each; of each group, one document has a few words of one of the next group.
    rows = []
    for g in range(6):
        base = [f"g{g}_{k}" for k in range(120)]
        for i in range(20):
            other = [f"x{min(g, h)}_{max(g, h)}_{k}" for h in [(g + 1 + i) % 6] if i < 5 for k in range(8)]
            rows.append((len(rows), " ".join([*base, *other, *(f"own{i}_{g}_{k}" for k in range(5))])))
    assert components(spark, rows) == brute_components(rows)
    assert met[0] == len(rows)
    assert sum(met[1:]) <= 60

# --- 4 --------------------------------------------------------------------------------------------------------------


def test_packing_is_reproducible_and_bucketed(spark, tmp_path):
    rows = [(None, "same text"), (None, "same text"), (None, "other"), (1, "again and again " * 40), (1, "again and again " * 40), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = vocabulary("byte_bpe_50k.json")
    one, other = (packing.pack(x, path) for x in (df.repartition(1), df.repartition(5)))
    told = lambda p: sorted(map(str, packing.digests(p, "ids").collect()))
    assert told(one) == told(other)
    assert len({r["sequence_id"] for r in one.collect()}) == one.count()
    packing.write_buckets(one, f"{tmp_path}/b")
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "b").glob("length=*")} == {r["length"] for r in one.select("length").distinct().collect()}


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_chat_query_on_the_whole_table(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"] if r["turn"] is not None else -1, r["role"] or "", r["text"] or ""))
    said = r"\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = {r["conv_id"]: r for r in queries.op5_chat_format(spark, SMALL).collect()}
    assert found.keys() == turns.keys()
    for key, rows in turns.items():
        rows.sort()
        learned = "".join(t for _, role, t in rows if role == "assistant")
        got = found[key]
        assert (got["n_turns"], got["turns_sha256"]) == (len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)))
        assert (got["loss_chars"], got["loss_sha256"]) == (len(learned), sha(learned))


# --- 6, 8 -----------------------------------------------------------------------------------------------------------


def test_words_that_weak_hashes_confuse():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    counts = token_counts.transducer(vocabulary("word_bpe_49k.json")).counts
    pieces = agenda.vocabulary_of(vocabulary("piece_bpe_32k.model"))
    long = "".join("ex"[bin(i).count("1") & 1] for i in range(4096))
    texts = [f"q {T} {U}", f"{long} {long.translate(str.maketrans('ex', 'xe'))}", "İ\U00013b89", "Ᲊ ꟋB \U00010d50'", "abcdeéstingx'" * 700, "antidisestablishment" * 60]
    assert counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    flat, edge, mended = pieces.encode(texts)
    assert [flat[edge[i] : edge[i + 1]].tolist() for i in range(len(texts))] == [pieces.library.encode(t) for t in texts] and not any(mended)


# --- 7 --------------------------------------------------------------------------------------------------------------


def articles(spark):
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        body = r["html"].split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        body = re.sub(r"<[a-z/][^>]*$", "", re.sub(r"</?(b|i|em|a|span)( [^>]*)?>", "", body.replace("<br>", " ")))
        yield r["html"], "\n".join(x for x in (" ".join(references.unescape(p).split()) for p in re.split(r"<[^>]+>", body)) if x)


def test_density_finds_articles_without_telling_names(spark, monkeypatch):
    neutral = lambda page: re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page)
    monkeypatch.setattr(pages, "OUT_NAMES", re.compile("(?!)"))
    known = list(articles(spark))
    right = sum(pages.main_text(neutral(page)) == text for page, text in known)
    assert right >= 0.9 * len(known)
    measure = pages.measure

    def flat(root):
        nodes = measure(root)
        for n in nodes:
            n.density = n.gathered = float(n.chars > 0)
        return nodes

    monkeypatch.setattr(pages, "measure", flat)
    assert sum(pages.main_text(neutral(page)) == text for page, text in known) < 0.1 * len(known)


def test_density_in_neutral_boxes(monkeypatch):
    monkeypatch.setattr(pages, "OUT_NAMES", re.compile("(?!)"))
    long = "word " * 60
    menu = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(20))
    page = f"<body><div class=k1><ul>{menu}</ul></div><div class=k2>Buy now</div><div class=k3><h1>Title</h1><p>{long}</p><p>Short.</p><ul><li>{long}</li></ul><p>{long}</p><p>{long}</p></div><div class=k4><p>{long}</p></div><div class=k5>(c) 2024</div></body>"
    want = "\n".join(["Title", long.strip(), "Short.", long.strip(), long.strip(), long.strip()])
    assert pages.main_text(page) == want
    parts = "".join(f"<section class=s><h2>Part {i}</h2><p>{long}</p><p>{long}</p></section>" for i in range(3))
    page = f"<body><div class=k1><ul>{menu}</ul></div><div class=k3>{parts}</div><div class=k4><p>{long}</p></div></body>"
    assert pages.main_text(page) == "\n".join(x for i in range(3) for x in (f"Part {i}", long.strip(), long.strip()))


def test_pages_with_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{'word ' * 9}</p>", "a", 1)] * 2, "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in pages.extract(df).collect()] == [(1, "u", ("word " * 9).strip(), 44)] * 2
    assert pages.main_text("<div><p>" + "many words here " * 100_000 + "</p></div>").count("many") == 100_000


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_language_equals_a_naive_kernel_machine(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(df, ~language.held_out(), per_language=12, landmarks=5)
    grams = lambda t: {int(g) for step in language.gram_steps(language._symbols([t])[0]) for g in step}
    told = df.where(~language.held_out() & df["lang"].isNotNull() & df["text"].rlike(r"\p{L}")).selectExpr("*", "xxhash64(doc_id) AS h").collect()
    sample = []
    for lang in sorted({r["lang"] for r in told}):
        own = sorted((r for r in told if r["lang"] == lang), key=lambda r: (r["h"], r["doc_id"]))[:12]
        sets = sorted(tuple(sorted(grams(r["text"]))) for r in own)
        sample += [(lang, set(x), i < 5) for i, x in enumerate(sets)]
    known = set().union(*(x for _, x, z in sample if z))
    kernel = lambda a, b: len(a & b & known) / ((len(a & known) * len(b & known)) ** 0.5 or 1)
    marks = [x for _, x, z in sample if z]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    features = np.array([[kernel(x, z) for z in marks] for _, x, _ in sample]) @ root
    names = sorted({lang for lang, _, _ in sample})
    weight = np.array([sum(1 / sum(o == n for o, _, _ in sample) for n in names if n == lang) for lang, _, _ in sample])
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang, _, _ in sample])
    solved = np.linalg.solve(features.T @ (features * weight[:, None]) + language.RIDGE * np.eye(features.shape[1]), features.T @ (y * weight[:, None]))
    texts = [r["text"] or "" for r in df.orderBy("doc_id").limit(60).collect()]
    best, score = language.score_texts(model, texts)
    for t, b, s in zip(texts, best, score, strict=True):
        if b >= 0:
            out = np.array([kernel(grams(t), z) for z in marks]) @ root @ solved
            assert abs(min(1, max(0, (out[b] + 1) / 2)) - s) < 1e-3 and out[b] > out.max() - 2e-3


def test_language_filters_by_row(spark):
    known = "The people were in the house and they saw it. " * 4
    rows = [(i, f"{known} {i}", "en") for i in range(1, 9)] + [(1, None, "en"), (None, None, "en"), (None, known, "en"), (5, "123", None)]
    kept = language.filter_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([*range(1, 9), None]) and all("people" in r["text"] for r in kept)


# --- 10 -------------------------------------------------------------------------------------------------------------


def naive_perplexities(rows):
    """Modified Kneser-Ney by dictionaries: {doc_id: perplexity}."""
    n = quality.ORDER
    white = set(b"\0\t\n\v\f\r ")

    def grams(text):
        for i, byte in enumerate(text):
            at = i - 1
            while at >= 0 and text[at] not in white:
                at -= 1
            whole = text[max(0, at if at >= 0 else 0) : i + 1]
            yield (b"\0" * n + whole)[-n:]

    out = {}
    for lang in {r[2] for r in rows}:
        own = [(i, (t or "").encode()) for i, t, x in rows if x == lang]
        for fold in (0, 1):
            levels = {n: Counter(g for _, t in own if quality.fold_of(t) != fold for g in grams(t))}
            for k in range(n - 1, 0, -1):
                levels[k] = Counter(g[1:] for g in levels[k + 1])
            d = {k: quality.discounts(np.array([sum(c == j for c in x.values()) for j in (1, 2, 3, 4)])) for k, x in levels.items()}
            total, off = {k: Counter() for k in levels}, {k: Counter() for k in levels}
            for k, x in levels.items():
                for g, c in x.items():
                    total[k][g[:-1]] += c
                    off[k][g[:-1]] += d[k][min(3, c)]

            def p(g):
                if not g:
                    return 1 / 256
                k, low = len(g), p(g[1:])
                c, t = levels[k][g], total[k][g[:-1]]
                return (c - d[k][min(3, c)] + off[k][g[:-1]] * low) / t if t else low

            for i, t in own:
                words = len(re.findall(rb"[^\x20\x09-\x0D]+", t))
                if quality.fold_of(t) == fold and words:
                    out[i] = exp(-sum(log(p(g)) for g in grams(t)) / words)
    return out


def test_quality_equals_naive_kneser_ney(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 5 = 0 and length(text) < 3000").limit(40)
    rows = [(r["doc_id"], r["text"], r["lang"] or "") for r in df.collect()] + [(-1, None, "xx"), (-2, "é a\n\nb", "xx"), (-3, "c d", "xx")]
    found = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = naive_perplexities(rows)
    assert found.keys() == {i for i, _, _ in rows} and found[-1] is None
    assert all(abs(log(found[i] / want[i])) < 1e-4 for i in want)


def test_quality_does_not_depend_on_partitions_or_groups(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = lambda df: {r["doc_id"]: (r["kept"], round(r["perplexity"] or 0, 4), r["lower"]) for r in quality.assess(df).collect()}
    want = told(docs)
    monkeypatch.setattr(quality, "GROUP", 3)
    monkeypatch.setattr(quality, "BATCH", 1 << 12)
    assert told(docs.repartition(5)) == want


def test_quality_model_grows_with_the_corpus(spark):
    distinct = []
    for sf in ("sf0.001", "sf0.01"):
        texts = [(r["text"] or "").encode() for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]
        distinct.append(len(np.unique(quality.grams_of(texts)[0])))
    assert distinct[1] > 2 * distinct[0]


# --- pipeline and queries -------------------------------------------------------------------------------------------

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, part string, component string, `__id` long"
LONG = "the house and the people that were in it with all of them "


def piped(spark, tmp_path, rows):
    spark.createDataFrame([(*r, len(r[1] or ""), 1, "p", "c", 2) for r in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_pipeline_of_awkward_rows(spark, tmp_path):
    rows = [(i, f"{LONG * 2} number {i} {'x' * i} tail {i * 7} end", "en", "s") for i in range(1, 12)]
    rows += [(20, None, "en", "s"), (None, None, None, None), (21, "", "en", "s"), (22, "12 34", None, None), (1, None, "en", "s"), (23, rows[0][1], "en", "s"), (24, rows[1][1] + " more", "en", "s"), (25, LONG * 9 + " write to a.b@c.example.org", "en", None)]
    found = piped(spark, tmp_path, rows)
    ids = {r["doc_id"] for r in found}
    assert 1 in ids and 25 in ids and not ids & {20, 21, 22, 23, None}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    told = b"".join(r["ids"] for r in sorted((r for r in found if r["doc_id"] == 25), key=lambda r: r["start"]))
    assert library.decode(np.frombuffer(told, "<u4")[:-1].tolist()) == LONG * 9 + " write to <EMAIL>"


@pytest.mark.parametrize("rows", [[], [(1, LONG, "en", "s")], [(1, None, None, None)]], ids=["empty", "one row", "one null"])
def test_pipeline_of_tiny_tables(spark, tmp_path, rows):
    found = piped(spark, tmp_path, rows)
    assert {r["doc_id"] for r in found} <= {1}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_give_whole_tables(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    key, source = {"op5_chat_format": ("conv_id", "conversations"), "op7_main_text": ("page_id", "pages"), "op13_vector_codes": ("vec_id", "embeddings")}.get(name, ("doc_id", "documents"))
    want = {r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select(key).collect()} | ({-7} if key == "conv_id" else set())
    assert {r[0] for r in found.select(key).collect()} == want
