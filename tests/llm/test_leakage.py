import random
from dataclasses import replace

import numpy as np
import pytest

from beatloom.llm import leakage
from beatloom.llm.pages import Reading

PASSAGE = "The lighthouse keeper rejected the yearly accounts at the expense of the house of Eskelink, while the harbour board condemned the town clock near 46 sacks of barley in the lower town, because Mrs Worervelsen sold the winter stores"
DOCS = "doc_id long, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:double>>, item_id string, n_words long"
ITEMS = "item_id long, passage string, doc_id long"
FILLER = "A travelling surveyor measured the northern road after a long debate and the brewers had forgotten three barrels of herring beside the mill until doctor Tamelhalane praised the ferry company for its patience in spring".split()


def lines(words, width=30, broken=False):
    out, now = [], ""
    for w in words:
        if len(now) + len(w) + 1 > width:
            if broken and len(w) > 5:
                out.append(now + " " + w[:3] + "-")
                now = w[3:]
                continue
            out.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return [*out, now]


def found(spark, docs, items=((7, PASSAGE),), search=leakage.USUAL):
    d = spark.createDataFrame([(i, t, b, "x", 1) for i, t, b in docs], DOCS)
    q = spark.createDataFrame([(i, p, 0) for i, p in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): r["n_words"] for r in leakage.leaked_items(d, "doc_id", "text", "line_boxes", q, "item_id", "passage", search=search).collect()}


def page(words, broken=False, head="HEAD. No. 1. Page 2"):
    return "\n".join([head, *lines(words, broken=broken)])


def test_whole_part_and_too_short(spark):
    w = PASSAGE.split()
    docs = [(1, page(FILLER + w + FILLER, True), None), (2, page(FILLER + w[5:23] + FILLER), None), (3, page(FILLER + w[5:17] + FILLER), None), (4, page(FILLER * 3), None), (5, None, None), (6, "  \n ", None), (7, page(w), None), (7, page(w), None)]
    got = found(spark, docs)
    assert set(got) == {(1, 7), (2, 7), (7, 7)} and got[(1, 7)] == len(w) and 18 <= got[(2, 7)] <= 19


def test_what_scanning_does(spark):
    text = page(FILLER + PASSAGE.split() + FILLER, True)
    for a, b in (("rn", "m"), ("h", "b"), ("d", "cl"), ("s", "ſ"), ("u", "n"), ("e", "c"), ("keeper", "kee per"), ("town clock", "townclock"), ("o", "0")):
        text = text.replace(a, b)
    advert = text.split("\n")
    advert[10:10] = ["Norarstiold's Cough Drops.", "Of all good grocers."]
    assert set(found(spark, [(1, "\n".join(advert), None)])) == {(1, 7)}


def test_mixed_columns_by_boxes(spark):
    a, b = lines(FILLER * 2, broken=True), lines(PASSAGE.split(), broken=True)
    n = min(len(a), len(b))
    text, boxes = ["HEAD. No. 1"], [(90, 60, 2300, 110, 0.9)]
    for i in range(n):
        text += [a[i], b[i]]
        boxes += [(1000, 180 + 40 * i, 91, 210 + 40 * i, 0.9), (1213, 181 + 40 * i, 2000, 211 + 40 * i, None)]
    assert set(found(spark, [(1, "\n".join(text), boxes)])) == {(1, 7)}


def test_another_number_is_another_text(spark):
    w = PASSAGE.replace("46", "6").split()
    at = w.index("6")
    assert found(spark, [(1, page(FILLER + w[at - 12 : at + 12] + FILLER), None)]) == {}


def test_empty_tables(spark):
    doc = (1, page(PASSAGE.split()), None)
    assert found(spark, []) == {}
    assert found(spark, [doc], items=[(1, None), (2, " "), (3, "short")]) == {}


def reading(text_lines):
    n = np.arange(len(text_lines))
    return Reading(text_lines, n * 0, n * 0, n, n * 0, ["\n".join(text_lines)])


def test_long_page_is_cut_with_overlap(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghikmnopqrstuvwxyz") for _ in range(7)) for _ in range(5000)]
    w = PASSAGE.split()
    (whole,) = leakage.fold_pages(reading(lines(words + w + words)))
    monkeypatch.setattr(leakage, "SHARD", 40_000)
    pieces = list(leakage._cut(whole))
    assert len(pieces) > 1 and sum(len(p.symbols) for p in pieces) >= len(whole.symbols)
    passages = leakage.fold_passages([(7, PASSAGE)])
    hits = [x for s in leakage.shards(iter(pieces)) for x in leakage.leaks(s, passages)]
    assert hits and all(h[2] == len(w) for h in hits)
    for h in hits:
        assert " ".join(" ".join(whole.text[a:b] for a, b in h[3]).split()) == PASSAGE


@pytest.mark.parametrize("between", [10, 60, 200])
def test_advert_of_many_lines(spark, between):
    """12 words, an advert of any number of lines, 12 words; and 9 words, a short advert, 7 words."""
    w = PASSAGE.split()
    rng = random.Random(between)
    other = [" ".join(rng.choice(FILLER) for _ in range(5)) for _ in range(between)]
    far = ["HEAD", *lines(FILLER), *lines(w[:12]), *other, *lines(w[12:24]), *lines(FILLER)]
    short = ["HEAD", *lines(FILLER), *lines(w[:9]), *other[:10], *lines(w[9:16]), *lines(FILLER)]
    got = found(spark, [(1, "\n".join(far), None), (2, "\n".join(short), None)])
    assert got == {(1, 7): 24, (2, 7): 16}


def test_a_passage_that_stands_on_a_page_many_times(spark):
    w = PASSAGE.split()
    text = ["HEAD"]
    for n in range(40):  # parts of it, then all of it in two columns' worth of lines
        text += lines(w[n % 8 : n % 8 + 6])
    text += [*lines(w[:14]), "Norarstiold's Cough Drops.", *lines(w[14:])]
    assert found(spark, [(1, "\n".join(text), None)]) == {(1, 7): len(w)}


def test_ligatures_and_other_scripts(spark):
    flat = "The office staff found difficult figures of fifty different fluffy flowers in the final offer and refused the first flimsy effort with affable efficiency before five"
    typeset = flat.replace("ffi", "\ufb03").replace("ffl", "\ufb04").replace("ff", "\ufb00").replace("fi", "\ufb01").replace("fl", "\ufb02")
    russian = "смотритель маяка отверг годовые счета за счёт дома на берегу пока совет гавани осудил городские часы возле сорока мешков ячменя в нижнем городе"
    assert np.array_equal(leakage.fold(typeset), leakage.fold(flat))
    got = found(spark, [(1, page(FILLER + typeset.split() + FILLER), None), (2, page(FILLER + russian.split() + FILLER), None)], [(1, flat), (2, russian)])
    assert got == {(1, 1): len(flat.split()), (2, 2): len(russian.split())}
    assert len(leakage.fold("\U0001d400\U00020000 \U0001f600\ud800")) == 2
    for line in (typeset, "ab\ufb03c, \U0001d400x", "", "--"):
        assert len(leakage.places(line)) == len(leakage.fold(line))


def test_removal_spans(spark):
    """What the spans name is the passage, whatever stands between its lines; those of two items that overlap are one."""
    w = PASSAGE.split()
    text = "\n".join(["HEAD", *lines(FILLER), *lines(w[:20], broken=True), "Norarstiold's Cough Drops.", *lines(w[20:], broken=True), *lines(FILLER)])
    d = spark.createDataFrame([(1, text, None, "x", 1), (2, page(FILLER), None, "x", 1)], DOCS)
    q = spark.createDataFrame([(7, PASSAGE, 0), (8, " ".join(w[:22]), 0)], ITEMS)
    spans = leakage.removal_spans(leakage.leaked_items(d, "doc_id", "text", "line_boxes", q, "item_id", "passage"), "doc_id").orderBy("start").collect()
    taken = [text[r["start"] : r["stop"]] for r in spans]
    assert {r["doc_id"] for r in spans} == {1} and len(spans) == 2
    assert "".join(taken).replace("-\n", "").split() == "".join([" ".join(w[:20]), " ".join(w[20:])]).split()
    assert "Cough" not in "".join(taken)


def test_page_without_boxes_is_read_as_scanned_too(spark):
    a, b = lines(FILLER * 2, width=18, broken=True), lines(PASSAGE.split() + FILLER, width=18, broken=True)
    n = min(len(a), len(b))
    mixed = ["HEAD", *[x for pair in zip(a[:n], b[:n]) for x in pair]]
    plain = ["HEAD", *a[:n], *b[:n]]
    assert set(found(spark, [(1, "\n".join(mixed), None), (2, "\n".join(plain), None)])) == {(1, 7), (2, 7)}


def test_exact_setting_finds_no_more(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/eval_items.parquet")
    pairs = lambda search: {(r[0], r[1]) for r in leakage.leaked_items(docs, "doc_id", "text", "line_boxes", items, "item_id", "passage", search=search).collect()}
    assert pairs(leakage.USUAL) == pairs(replace(leakage.EXACT, seed=16, most=16, gather=16, near=1_200))


def test_too_many_passages_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_SYMBOLS", 100)
    with pytest.raises(ValueError, match="too many"):
        found(spark, [(1, page(FILLER), None)])
