import random
from collections import Counter, defaultdict

import pytest

from beatloom.llm import packing, tokens

ITEMS = "doc long, n long, pack_id string, container long"
KINDS = "kind int, cap int, n long"


def run(spark, lengths, caps):
    items = spark.createDataFrame([(i, n, "x", 5) for i, n in enumerate(lengths)], ITEMS)
    kinds = spark.createDataFrame([(i, c, 0) for i, c in enumerate(caps)], KINDS)
    return packing.pack(items, ["doc"], "n", kinds, "kind", "cap").collect()


def check(rows, lengths, caps):
    filled, covered, parts = defaultdict(int), defaultdict(int), Counter()
    for r in rows:
        filled[(r["kind"], r["container"])] += r["size"]
        covered[(r["kind"], r["doc"])] += r["size"]
        parts[(r["kind"], r["doc"])] += 1
    for (kind, _), n in filled.items():
        assert 0 < n <= caps[kind]
    for kind, cap in enumerate(caps):
        for i, n in enumerate(lengths):
            assert covered[(kind, i)] == (n or 0)
            assert parts[(kind, i)] == -(-(n or 0) // cap)
        used = len([1 for k, _ in filled if k == kind])
        assert {c for k, c in filled if k == kind} == set(range(used))
        total = sum(n or 0 for n in lengths)
        if cap > 10 * max(min(n or 0, cap) for n in lengths[:1500]):
            assert used <= 1.02 * total / cap + 1


def test_every_item_has_its_place(spark):
    rng = random.Random(5)
    lengths = [rng.randint(1, 90) for _ in range(1500)] + [50] * 700 + [1000, 64, 128, 129]
    check(run(spark, lengths, [64, 128, 1000]), lengths, [64, 128, 1000])


def test_nothing_null_and_repeated(spark):
    assert run(spark, [], [8]) == []
    lengths = [None, 0, 8, 8, 8, 3, 5]
    check(run(spark, lengths, [8]), lengths, [8])


def test_every_item_takes_one_place_of_a_ragged_plan(spark):
    """Long-tailed lengths, of which short ones have places of a few ranks beside places of many."""
    rng = random.Random(8)
    lengths = [max(1, min(700, int(rng.lognormvariate(3.5, 1.2)))) for _ in range(3000)] + [5] * 1500
    check(run(spark, lengths, [256, 512]), lengths, [256, 512])


def test_too_many_kinds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_KINDS", 1)
    with pytest.raises(ValueError, match="kinds"):
        run(spark, [1], [8, 9])


def test_plan_is_small_and_whole():
    counts = {n: 1_000_000 + n for n in range(1, 513)}
    slots = packing.plan_counts(512, counts)
    assert len(slots) < 20 * 512
    placed = Counter()
    for length, first, last, _ in slots:
        assert first == placed[length]
        placed[length] = last + 1
    assert dict(placed) == counts


def test_token_counts(spark):
    texts = ["", None, "hello world", "Żółć <|endoftext|> \n\n  ſt", "a" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(df, ["id"], "text").collect()}
    assert got[0] == 0 and got[1] == 0 and got[2] == 2 and got[3] > 3 and got[4] > 1000
