"""The ten operators against brute force, libraries, round trips and held-out accuracy, on awkward rows too."""

import hashlib
import html as references
import re
import struct
import zlib
from collections import Counter

import pytest

from gleanery.llm import agenda, chat, exact_dedup, language, near, packing, pages, pii, quality, queries, token_counts
from gleanery.llm.components import components
from gleanery.llm.vocabularies import vocabulary

SMALL = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
BASE = " ".join(WORDS * 2)
AWKWARD = [
    (1, BASE, "en", "s"),
    (2, BASE + " extra", "en", "s"),
    (3, BASE.upper(), None, None),
    (4, None, "en", "s"),
    (5, "", "en", "s"),
    (6, " \t\n ", "en", "s"),
    (7, "one two", "en", "s"),
    (8, "ONE  two", "en", "s"),
    (9, BASE, "en", "s"),
    (9, BASE, "en", "s"),
    (None, BASE, "en", "s"),
    (10, "héllo wörld 日本語 😀 ▁x <s> <|endoftext|> 'll don't !!'s", "de", "s"),
    (11, "x" * 70_000, "en", "s"),
    (12, "lorem ipsum " * 20_000, "en", "s"),
    (13, "mail a.b@c.example.org, +1 (555) 123-4567, 10.0.0.255, 999.1.1.1, 4111 1111 1111 1111.", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names could clash."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.selectExpr("*", "1 AS n", "'x' AS kind", "2 AS part", "3 AS component", "4 AS keep_id", "5 AS __id", "6 AS recipe")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- 1 --------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    def luhn(s):
        return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0

    digits = lambda s: re.sub(r"[^0-9]", "", s)
    checks = {"email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))), "card": (CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), "phone": (PHONE, lambda s: 9 <= len(digits(s)) <= 15)}
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in checks.items() for m in p.finditer(text) if ok(m[0])]


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_pii_finds_the_base_spans(which, request):
    df = request.getfixturevalue(which)
    found = Counter((r["doc_id"], r["base_sha256"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in pii.digests(pii.find_pii(df)).collect())
    want = Counter((i, hashlib.sha256(",".join(s).encode()).hexdigest(), len(s)) for i, t in texts(df) for s in [base_spans(t)])
    assert found == want


def test_pii_odd_anchors():
    for t in ("a@b.c@d.e.f", "@x.y", "1.2.3.4.5.6.7.8", "01.002.3.4", "++12345678901", "+1 2+3456789012", "4111-1111-1111-1111 4111", "a@b-.c.", "12@3.4"):
        got = pii.spans_of(t)
        assert [f"{k}:{a}:{b}" for k in pii.BASE for a, b in got[k]] == base_spans(t)


def test_pii_redacts_and_keeps_rows(awkward):
    out = pii.redact(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    text = next(r["text"] for r in out.collect() if r["doc_id"] == 13)
    assert "<EMAIL>" in text and "<PHONE>" in text and "<CARD>" in text and "<IP>" in text and "example" not in text
    found = pii.spans_of("Pay to IBAN DE89370400440532013000 at 12 Oak Street, see https://x.example/a.")
    assert found["account"] and found["address"] and found["url"]


# --- 2 --------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = sorted((top(sets[a][0]), top(sets[b][0])))
                parent[q] = p
    return {i: top(i) for i in parent}


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_near_duplicates(which, request):
    df = request.getfixturevalue(which)
    rows = texts(df)
    found = near.near_duplicates(df).collect()
    want = brute_components(rows)
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    assert Counter((r["doc_id"], r["n_shingles"]) for r in found) == Counter((i, len(shingle_set(t))) for i, t in rows)


def test_near_duplicates_at_the_threshold(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 40 - (i % 3)))) for i in range(0, 30)] + [(100 + i, " ".join([f"v{i}", *WORDS, f"u{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()} == brute_components(rows)
    assert sorted(r["doc_id"] for r in near.deduplicate(df).collect()) == sorted({*brute_components(rows).values()})


def test_components_of_a_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 92), (92, 90)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 90: 90, 91: 90, 92: 90}


# --- 3 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_exact_dedup(which, request):
    df = request.getfixturevalue(which)
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in texts(df)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, least[t], len(groups[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(df).collect()) == want


def test_exact_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a b"), (1, "other"), (2, "a  b"), (3, "other"), (None, "a b"), (None, "alone"), (3, "third")]
    kept = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r[0], r[1]) for r in kept.collect()) == Counter([(1, "a b"), (1, "other"), (None, "alone"), (3, "third")])


def test_exact_dedup_by_digests_when_identifiers_clash(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x y"), (2, "x  y"), (3, "x z")], "doc_id long, text string")
    want = sorted(map(tuple, exact_dedup.exact_groups(df).collect()))
    monkeypatch.setattr(exact_dedup, "verified", lambda listed: listed.select("doc_id", "text_sha256", listed["digests"].alias("recipe")))
    assert sorted(map(tuple, exact_dedup.exact_groups(df).collect())) == want


def test_exact_dedup_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE_LEAST", 3)
    df = spark.createDataFrame([(i, f"text {i % 4 if i < 40 else i}") for i in range(60)], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(df).collect()}
    assert found == {i: (i % 4, 10) if i < 40 else (i, 1) for i in range(60)}


def test_exact_dedup_keeps_one_row_of_each(awkward):
    kept = exact_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8, 10, 11, 12, 13]


# --- 4 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_packing(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = packing.digests(packing.pack(df.where("doc_id is not null and doc_id <> 9"), path)).collect()
    assert len({r["sequence_id"] for r in found}) == len(found)
    for i, t in texts(df):
        if i in (None, 9):
            continue
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        pieces = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["offset"] == 0
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_chats(spark):
    rows = [(1, 1, "assistant", "yes\\ ### </turn>"), (1, 0, "user", "a: b"), (2, 0, None, None), (2, None, "user", "é😀"), (None, 0, "assistant", "x"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    turns = chat.with_planted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert chat.read_back(formatted[1]["formatted"]) == [("user", "a: b"), ("assistant", "yes\\ ### </turn>")]
    assert chat.read_back(formatted[2]["formatted"]) == [("user", "é😀"), ("", "")]
    told = {r["conv_id"]: r for r in chat.digests(chat.format_chats(turns)).collect()}
    said = "\\### Assistant: </turn> ok"
    assert told[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert told[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and told[-7]["loss_chars"] == len(said)
    assert told[3]["n_turns"] == 2 and told[None]["loss_chars"] == 1


def test_chats_of_long_conversations_come_in_parts(spark):
    said = [(c, i, ("user", "assistant")[i % 2], f"### {i} é " * 9) for c in (None, 1) for i in range(400)] + [(2, 0, "assistant", "short")]
    chats = chat.format_chats(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3), most=4000)
    rows = sorted(chats.collect(), key=lambda r: r["part"])
    told = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    for c in (None, 1, 2):
        turns = [(role, text) for i, _, role, text in said if i == c]
        parts = [r for r in rows if r["conv_id"] == c]
        whole = "".join(r["formatted"] for r in parts)
        assert chat.read_back(whole) == turns and len(parts) == parts[0]["n_parts"] and (len(parts) > 4) == (c != 2)
        assert max(r["n_turns"] for r in parts) < 200
        learned = [whole[r["begins"] + x["start"] : r["begins"] + x["end"]] for r in parts for x in r["loss"]]
        assert [chat.unescape(x) for x in learned] == [text for role, text in turns if role == "assistant"]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (c, len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), sum(len(chat.unescape(x)) for x in learned), sha("".join(map(chat.unescape, learned))), len(whole))
        assert tuple(told[c]) == want
    assert len(told) == 3


# --- 6, 8 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_token_counts(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter((i, len(t.encode()), n, n > 2048) for i, t in texts(df) for n in [len(library.encode(t, add_special_tokens=False).ids)])
    assert Counter(tuple(r) for r in token_counts.count_tokens(df, path).collect()) == want


def test_words_of_the_first_transducer():
    import regex

    for t in ("'s''s 's's'x", "don't!!'s 'l'll 'r're'rest'", "a1b22 ②x", "'", "''", " '\n", "x" * 600 + "'s " + "!" * 300):
        start, stop = token_counts.words(token_counts.code_points([t])[0])
        assert [t[a:b] for a, b in zip(start, stop, strict=True)] == regex.findall(token_counts.PATTERN, t)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_sentencepiece(which, request):
    import sentencepiece

    df = request.getfixturevalue(which)
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t in texts(df):
        ids = library.encode(t, add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), 0] += 1
    assert Counter(tuple(r) for r in agenda.encode_digests(df, path).collect()) == want
    assert {r["doc_id"]: r["decoded"] for r in agenda.encode(df, path).collect()} == {i: t.replace("▁", " ") for i, t in texts(df)}


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_pages_give_the_article(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {}
    for r in df.collect():
        body = r["html"].split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        body = re.sub(r"</?(b|i|em|a|span)( [^>]*)?>", "", body.replace("<br>", " "))
        body = re.sub(r"<[a-z/][^>]*$", "", body)
        want[r["page_id"]] = "\n".join(x for x in (" ".join(references.unescape(p).split()) for p in re.split(r"<[^>]+>", body)) if x)
    assert {r["page_id"]: r["text"] for r in pages.extract(df).collect()} == want


def test_pages_without_article_element():
    long = "word " * 60
    page = f"<html><body><div class=menu><a href=/>x</a></div><div class='side-bar sidebar'><p>{long}</p></div><div><h1>T</h1><p>{long}</p><p>{long}&amp; end</p><form><p>{long}</p></form></div><div id=comments><p>{long * 9}</p></div><footer>{long}</footer></body></html>"
    assert pages.main_text(page) == f"T\n{long.strip()}\n{long}& end"


def test_pages_keep_links_and_headings_of_the_article():
    kept = [
        '<div class="entry-header"><h1>Title</h1></div>',
        '<h2 id="social-impact">Impact</h2><p class="side-effects">Effects</p>',
        '<section id="related-work"><h2 id="legal">Law</h2><ul><li><a href="/a">First source</a></li><li><a href="/b">Second source</a></li></ul></section>',
        '<table><tr><td><a href="/c">Linked cell</a></td></tr></table>',
    ]
    gone = ['<div class="share-buttons">Gone</div>', '<ul class="related_posts"><li>Gone</li></ul>', '<div id="comments">Gone</div>', '<ul role="navigation"><li>Gone</li></ul>', '<nav>Gone</nav>']
    page = f"<body><ul><li><a href=/>Gone</a></li></ul><article>{''.join(kept + gone)}<p>{'word ' * 60}</p></article></body>"
    assert pages.main_text(page) == "\n".join(["Title", "Impact", "Effects", "Law", "First source", "Second source", "Linked cell", ("word " * 60).strip()])


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "plain"), (4, "u", "<p>a<b"), (5, "u", "<div>" * 3000 + "deep"), (None, "u", "<!-- x")], "page_id long, url string, html string")
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(df).collect()} == {1: ("", 0), 2: ("", 0), 3: ("plain", 5), 4: ("a", 1), 5: ("deep", 4), None: ("", 0)}


# --- 9, 10 ----------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_language_of_awkward_rows(awkward, empty):
    found = {r["doc_id"]: r for r in language.identify(awkward).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (4, 5, 6))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert {r["lang_pred"] for r in language.identify(awkward.withColumn("lang", awkward["lang"].substr(9, 1)).where("lang is null")).collect()} == {"und"}
    assert {4, 5, 6}.isdisjoint(r["doc_id"] for r in language.filter_known(awkward).collect())


def test_quality_base_rules(awkward, documents):
    for df in (awkward, documents):
        want = Counter()
        for i, t in texts(df):
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            again = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
            seen, lines = set(), 0
            for line in t.split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", line):
                    lines += line in seen
                    seen.add(line)
            want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)] += 1
        found = quality.assess(df).collect()
        assert Counter(tuple(r[:7]) for r in found) == want
        assert not any(r["base_failed"] and r["kept"] for r in found)


def test_quality_bands_keep_clean_documents(spark):
    d = "/root/testdata/sf0.1"
    found = quality.assess(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = [r["kept"] for r in found if r["quality"] == 1], [r["kept"] for r in found if r["quality"] == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.6 * len(junk)


# --- all ------------------------------------------------------------------------------------------------------------


def test_empty_tables(empty, spark):
    assert pii.digests(pii.find_pii(empty)).count() == 0
    assert near.near_duplicates(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert token_counts.count_tokens(empty, vocabulary("word_bpe_49k.json")).count() == 0
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert agenda.encode(empty, vocabulary("piece_bpe_32k.model")).count() == 0
    assert language.identify(empty).count() == 0
    assert quality.assess(empty).count() == 0


def test_registered_queries_cover_the_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
