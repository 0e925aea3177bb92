import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import language
from beatloom.llm.pages import guessed_order, read_pages

SCHEMA = "doc_id long, text string, lang string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:double>>, segment string"
EN = "the harbour board had forgotten the yearly accounts because the widow of the baker opened the upper meadow towards the end of the month without any warning".split()
DE = "die Hafenbehörde vergaß die jährlichen Rechnungen weil die Witwe des Bäckers die obere Wiese gegen Ende des Monats ohne jede Warnung eröffnete und die Fischer lobten das Rathaus".split()


def text(rng, *parts):
    out = ["HEAD. No. 1"]
    for words, n in parts:
        w = [rng.choice(words) for _ in range(n)]
        out += [" ".join(w[i : i + 5]) for i in range(0, n, 5)]
    return "\n".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = [(i, text(rng, (EN if i % 2 else DE, 60)), "en" if i % 2 else "de", None, "x") for i in range(60)]
    rows[3] = (3, rows[3][1], "de", None, "x")  # a wrong label in the training data
    rows += [(100, text(rng, (EN, 60), (DE, 40)), "en", None, "x"), (101, text(rng, (EN, 60)), None, None, "x"), (102, text(rng, (DE, 60)), " GER ", None, "x"), (103, text(rng, (EN, 60)), "en-GB", None, "x"), (104, text(rng, (EN, 60), (DE, 10), (EN, 30)), "English", None, "x"), (105, None, "en", None, "x"), (106, " ", "en", None, "x"), (107, "", None, None, "x"), (108, text(rng, (DE, 40), (EN, 10), (DE, 40)), "de", None, "x")]
    return rows


def cases(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(df, "doc_id", "text", "lang")
    seg = language.language_segments(df, ["doc_id"], "text", "line_boxes", model)
    pages = language.page_languages(seg, ["doc_id"])
    return seg, pages, {(r["doc_id"], r["lang"]) for r in language.label_cases(pages, df, ["doc_id"], "lang").collect()}


def test_cases(spark, corpus):
    seg, pages, got = cases(spark, corpus)
    assert got == {(3, "en"), (100, "en"), (100, "de"), (101, "en")}
    assert {r["lang"] for r in seg.where("doc_id = 104").collect()} == {"en", "de"}
    assert all(0 < r["confidence"] <= 1 for r in pages.collect())


def test_empty(spark):
    assert cases(spark, [])[2] == set()
    assert cases(spark, [(1, None, "en", None, "x")])[2] == set()


def test_draw_at_every_size(spark):
    """The bound on the hash never lets nothing through, and the same rows come out however they are spread."""
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    few = {r[0] for r in language.draw(df, "doc_id", 50, 20_000).collect()}
    assert len(few) == 50
    assert few == {r[0] for r in language.draw(df.repartition(7), "doc_id", 50, 20_000).collect()}
    assert few == {r[0] for r in df.orderBy(F.xxhash64("doc_id")).limit(50).collect()}
    for total in (4 * 10**9, 8 * 10**9, 10**11, 10**13):
        share = 1.5 * 4_000 / total
        bound = -(2**63) + int((share + 1e-18) * 2**64)
        assert (bound + 2**63) * total / 2**64 > 5_900  # rows let through
    assert language.draw(df, "doc_id", 50, 0).count() == 50


def test_no_labels(spark, corpus):
    rows = [(r[0], r[1], None, None, "x") for r in corpus]
    seg, pages, got = cases(spark, rows)
    assert got == set() and seg.count() == 0


def test_held_out_accuracy(spark, folder):
    """Passages of the evaluation set, whose language is known, are never trained on."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs, "doc_id", "text", "lang")
    items = spark.read.parquet(f"{folder}/eval_items.parquet").select("passage", "lang").toPandas()
    items = items[items["lang"].isin(language.LANGS)]
    scores, _ = language.line_scores(items["passage"].tolist(), model)
    seen = {language.LANGS[i] for i in np.argmax(scores, axis=1)}
    right = np.array(language.LANGS)[np.argmax(scores, axis=1)] == items["lang"].to_numpy()
    assert right.mean() >= 0.9 and len(seen) >= 5


def test_labels(spark):
    labels = ["EN", " eng ", "en-GB", "English", "pt_BR", "dut", "xx", "", None, "German"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(language.named_language(F.col("l"))).collect()] == ["en", "en", "en", "en", "pt", "nl", None, None, None, "de"]


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(9)
    row = np.repeat([0, 1, 2], [4, 1, 5])
    s = rng.normal(0, 10, (10, 3))
    got = language.viterbi(s, row, 8.0)
    for r in range(3):
        at = np.flatnonzero(row == r)
        best = max(itertools.product(range(3), repeat=len(at)), key=lambda p: sum(s[i, k] for i, k in zip(at, p)) - 8.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[at]) == best


def test_order_of_mixed_lines():
    a = ["the coun-", "cil of the", "town opened the wa-", "ter works and the", "old mill."]
    b = ["Fishermen from the nor-", "thern shore sold her-", "ring and three bar-", "rels of tar to the", "widow."]
    assert guessed_order([x for p in zip(a, b) for x in p]) == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    assert guessed_order(a + b) == list(range(10)) and guessed_order([]) == []


def test_reading_order_without_lines():
    import pyarrow as pa

    t = pa.list_(pa.struct([(n, pa.int32()) for n in ("x0", "y0", "x1", "y1")] + [("conf", pa.float64())]))
    b = pa.RecordBatch.from_arrays([pa.array([None, "", "one line"]), pa.array([None, [], None], t)], names=["text", "boxes"])
    pages = read_pages(b, "text", "boxes")
    assert pages.lines == ["one line"] and pages.row.tolist() == [2] and pages.number.tolist() == [0]
