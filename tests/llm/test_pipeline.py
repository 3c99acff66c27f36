import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from foliometry.llm import decontamination, quality_classifier, secrets
from foliometry.llm.tokenizing import place

from test_sets import brute_components, brute_spans

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def test_pipeline_equals_brute_force(spark, tmp_path):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality_classifier.quality_classifier(documents, labels).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect() if r["doc_id"] in kept]
    groups = brute_components([t for _, t in rows], 5, 8, 10)
    rows = [rows[k] for k in sorted({c for _, c in groups.values()})]
    left = spark.createDataFrame(rows, "doc_id bigint, text string")
    leaked = {r["doc_id"] for r in decontamination.leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    tokenizer = Tokenizer.from_file(place("word_bpe_49k.json"))
    expected = {}
    for doc, text in rows:
        if doc in leaked:
            continue
        out, at = "", 0
        for start, _, _, end in brute_spans(text):
            out += text[at:start] + secrets.MARK if start >= at else ""
            at = max(at, end)
        expected[doc] = [*tokenizer.encode(out + text[at:], add_special_tokens=False).ids, 1]
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(expected)
    for doc, ids in expected.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_stages_on_odd_rows(spark, documents, no_documents, tmp_path):
    """Every stage takes nulls, blanks, copies, long texts and empty tables, and all but the last keep the columns."""
    for name, table in (("odd", documents), ("none", no_documents)):
        docs = table.selectExpr("doc_id", "text", "'en' lang", "cast(null as string) source", "cast(1 as bigint) n_chars")
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{name}-{k}")
            stage(spark, docs, SF).write.parquet(out)
            columns, docs = docs.columns, spark.read.parquet(out)
            assert k == 4 or docs.columns == columns


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_leaks_against_a_plain_search(spark):
    """Stage 3 drops what a search of ten words in a row, without case, finds, and planted copies; so it is not compared with its own output."""
    documents, benchmark = (spark.read.parquet(f"{SF}/{name}.parquet").select(key, "text").collect() for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    items = [text for _, text in benchmark]
    first = "a small farm with seven hands ships 1,250 boxes of fruit on each working morning here"
    planted = [form(text) for text in items[:20] for form in (str.upper, str.lower, lambda t: " ".join(["Edited", *t.split()[1:]]))]
    planted += [first.replace("1,250", value) for value in ("80", "2,400", "-3.5")]
    runs = {tuple(w[i : i + 10]) for text in [*items, first] for w in [plain_words(text)] for i in range(len(w) - 9)}
    rows = [*((doc, text) for doc, text in documents), *((10**9 + k, f"lead {text} tail") for k, text in enumerate(planted))]
    expected = {doc for doc, text in rows for w in [plain_words(text)] if any(tuple(w[i : i + 10]) in runs for i in range(len(w) - 9))}
    expected |= set(range(10**9 + 60, 10**9 + len(planted)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = spark.createDataFrame([*((k, text) for k, text in benchmark), (10**9, first)], "item_id bigint, text string")
    kept = {r["doc_id"] for r in decontamination.without_leaks(frame, wanted).collect()}
    assert expected >= set(range(10**9, 10**9 + len(planted)))
    assert not kept & expected


def test_quality_against_held_out_labels(spark):
    """Stage 1, fitted on the labels of even doc_ids, grades the odd ones as their labels say."""
    documents, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    graded = quality_classifier.quality_classifier(documents, labels.where("doc_id % 2 = 0")).select("doc_id", "kept")
    rows = graded.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in rows)
    assert rows and right >= 0.8 * len(rows)
