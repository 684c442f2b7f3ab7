"""Packing: round trips, capacity, tightness and tokens."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.llm import packing, tokens


def packed(spark, items, capacity, parts=4, **options):
    df = spark.createDataFrame(items, "doc_id long, n long").repartition(parts)
    df = df.withColumns({c: F.lit(1) for c in ("bin", "fill", "piece", "root", "container")})
    return [tuple(r) for r in packing.pack(df, "n", ["doc_id"], capacity, **options).select("doc_id", "piece", "n", "container").collect()]


def check(rows, items, capacity):
    """Every piece once, none too large, no container over its capacity."""
    want = Counter()
    for d, n in items:
        if n is not None:
            n = max(n, 0)
            for piece in range(max(1, -(-n // capacity))):
                want[(d, piece, min(capacity, n - piece * capacity))] += 1
    assert Counter(r[:3] for r in rows) == want
    load = Counter()
    for _, _, n, c in rows:
        load[c] += n
    assert all(v <= capacity for v in load.values())
    return load


@pytest.mark.parametrize("seed,parts,fan_in,carry", [(1, 4, 16, 256), (2, 40, 3, 256), (3, 40, 4, 2), (4, 1, 16, 256)])
def test_all_pieces_are_placed_tightly(spark, seed, parts, fan_in, carry):
    r = random.Random(seed)
    items = [(i, r.choice([None, 0, -3, 1, 7, 60, 100, 101, 350, r.randrange(1, 40), r.randrange(1, 40)])) for i in range(1500)] + [(5, 7), (5, 7)]
    load = check(packed(spark, items, 100, parts, fan_in=fan_in, carry=carry), items, 100)
    total = sum(max(n or 0, 0) for _, n in items)
    assert len(load) <= -(-total // 100) * 1.05 + 3


def test_underfull_containers_of_many_partitions_are_merged(spark):
    items = [(i, 10) for i in range(32)]
    rows = packed(spark, items, 100, parts=32, fan_in=4)
    assert len(check(rows, items, 100)) <= 5


def test_items_over_half_the_capacity(spark):
    items = [(i, 51 + i % 9) for i in range(200)]
    assert len(check(packed(spark, items, 100, parts=8, fan_in=2, carry=3), items, 100)) == 200


def test_nothing_and_bad_capacity(spark):
    assert packed(spark, [], 10) == []
    assert packed(spark, [(1, None)], 10) == []
    for capacity in (0, None, -1):
        with pytest.raises(ValueError):
            packed(spark, [(1, 1)], capacity)


def test_best_fit_takes_the_tightest_room():
    assert packing.best_fit(np.array([6, 7, 3, 4]), 10).tolist() == [1, 0, 0, 1]
    assert packing.best_fit(np.array([0, 0, -1]), 10).tolist() == [0, 0, 0]
    assert len(packing.best_fit(np.array([], np.int64), 10)) == 0
    many = np.random.default_rng(1).integers(1, 4000, 20_000)
    assert many.sum() / ((packing.best_fit(many, 4096).max() + 1) * 4096) > 0.99


def test_token_sizes(spark):
    texts = [None, "", "hello world", "naïve 東京 🙂 <|endoftext|>", "x" * 300_000, " \n" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    out = {r["doc_id"]: r["tokens"] for r in tokens.token_sizes(df, "text", ["doc_id"]).collect()}
    enc = tokens.encoding(tokens.VOCABULARY)
    assert out == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert out[1] == 0 and out[2] == 2


def test_split_items_come_from_the_containers(spark, tmp_path):
    items = [(1, 100), (2, 101), (3, 250), (4, None), (5, 0), (6, 7), (6, 7), (6, 90)]
    df = spark.createDataFrame(items, "doc_id long, n long").repartition(6)
    packed = packing.pack(df, "n", ["doc_id"], 100, fan_in=2)
    found = packing.split_items(packed, ["doc_id"])
    assert {r[0] for r in found.collect()} == {2, 3}
    # The containers the pieces were moved to take part: the join is in the plan.
    assert "Join" in found._jdf.queryExecution().optimizedPlan().toString()
