"""The pipeline against the same stages by brute force."""

from tokenizers import Tokenizer

import corpus_pipeline
from gleanery.llm import language
from gleanery.llm.vocabularies import vocabulary

from .test_operators import SMALL, brute_components, shingle_set, texts

import re


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = {r["doc_id"] for r in language.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.TRUSTED}
    rows, seen = [], set()
    for i, t in sorted(texts(docs)):
        normal = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if i in known and normal not in seen:
            seen.add(normal)
            rows.append((i, t))
    near = brute_components(rows)
    left = {i for i, t in rows if near[i] == i}
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in found} == left
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    from gleanery.llm import pii

    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs.where(docs["doc_id"].isin(*left))).collect()}
    for i in left:
        assert {r["doc_tokens"] for r in found if r["doc_id"] == i} == {len(library.encode(clean[i], add_special_tokens=False).ids) + 1}
    assert all(shingle_set(t) for i, t in rows if i in left)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
