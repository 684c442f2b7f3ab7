"""Mixing: shares, caps, whole copies and the law of the sample."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltmark.llm import mixing, queries

TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, weight=None, **options):
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, w double").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("copies", "d", "s", "goal", "plan")})
    used, report = mixing.mix(df, spark.createDataFrame(targets, TARGETS).withColumn("tokens", F.lit(1)), weight=weight, **options)
    return [tuple(r) for r in used.select("doc_id", "source", "tokens", "copies").collect()], {r["source"]: r for r in report.collect()}


def corpus(n, seed):
    r = random.Random(seed)
    return [(i, r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, 0, r.randrange(1, 200), r.randrange(1, 200)]), None) for i in range(n)]


@pytest.mark.parametrize("buckets", [50_000, 3])
def test_shares_and_caps(spark, buckets, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", buckets)
    docs = corpus(3000, 1)
    targets = [("a", 0.4, 2), ("b", 0.35, 3), ("c", 0.2, 1), ("none", 0.05, 9)]
    used, report = mixed(spark, docs, targets)
    total = sum(t or 0 for *_, t, _ in docs)
    caps = {s: m for s, _, m in targets}
    taken = defaultdict(int)
    assert len({d for d, *_ in used}) == len(used)
    for d, s, t, n in used:
        assert 1 <= n <= caps[s] and docs[d][1] == s and (docs[d][2] or 0) == t
        taken[s] += t * n
    for s, share, most in targets:
        has = sum(t or 0 for _, x, t, _ in docs if x == s)
        goal = share * total
        assert report[s]["reachable"] == (has * most >= goal)
        assert report[s]["tokens_taken"] == taken[s] and report[s]["tokens_available"] == has
        if report[s]["reachable"]:
            assert goal - 200 <= taken[s] <= goal + 1  # within one document
        else:
            assert taken[s] == has * most
        assert report[s]["reached_share"] == pytest.approx(taken[s] / sum(taken.values()))


def test_the_draw_is_the_same_every_time_and_follows_the_seed(spark):
    docs = [(i, "a", 10, None) for i in range(400)] + [(i, "b", 10, None) for i in range(400, 500)]
    first, _ = mixed(spark, docs, [("a", 0.3, 1)])
    again, _ = mixed(spark, docs, [("a", 0.3, 1)])
    other, _ = mixed(spark, docs, [("a", 0.3, 1)], seed=8)
    assert sorted(first) == sorted(again) and sorted(first) != sorted(other)
    assert len(first) == len(other) == 150


def test_pareto_order_of_ranks(spark):
    """The documents drawn are those of least rank, by brute force."""
    docs = [(i, "a", 1 + i % 3, None) for i in range(300)] + [(i, "b", 50, None) for i in range(300, 310)]
    used, _ = mixed(spark, docs, [("a", 0.4, 5)])
    has, total = sum(d[2] for d in docs[:300]), sum(d[2] for d in docs)
    goal = 0.4 * total
    whole, part = divmod(goal / has, 1)
    hashes = {r["d"]: r["h"] for r in spark.createDataFrame([(d[0],) for d in docs], "d long").select("d", F.xxhash64(F.lit(7), "d").alias("h")).collect()}
    rank = lambda d: (lambda u: u / (1 - u))((((hashes[d] % 2**64) >> 11) + 0.5) / 2**53)
    extra, size = set(), 0
    for d, _, t, _ in sorted(docs[:300], key=lambda x: rank(x[0])):
        size += t
        if size > part * has:
            break
        extra.add(d)
    assert {(d, n) for d, _, _, n in used} == {(d[0], int(whole) + (d[0] in extra)) for d in docs[:300] if whole or d[0] in extra}


def test_weights_make_inclusion_unequal(spark):
    docs = [(i, "a", 1, 3.0 if i % 2 else 1.0) for i in range(4000)]
    used, _ = mixed(spark, docs, [("a", 0.4, 1)], weight="w")
    heavy = sum(n for d, _, _, n in used if d % 2)
    assert abs(sum(n for *_, n in used) - 1600) <= 1 and 1130 <= heavy <= 1270  # 0.6 and 0.2 of 2000 each


def brute_factor(docs, goal, most):
    """The factor by bisection."""
    size = lambda f: sum(t * min(w * f, most) for t, w in docs)
    low, high = 0.0, 1.0
    while size(high) < goal:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if size(mid) < goal else (low, mid)
    return high


@pytest.mark.parametrize("share,most", [(0.02, 1), (0.5, 1), (0.85, 1), (0.9, 3)])
def test_continuous_weights(spark, share, most):
    r = random.Random(5)
    docs = [(i, "a", r.randrange(1, 100), r.choice([r.lognormvariate(0, 2), None, 0.0, -1.0, float("nan"), 1e6])) for i in range(1500)] + [(2000, "b", 500, 1.0)]
    used, report = mixed(spark, docs, [("a", share, most)], weight="w")
    weight = lambda w: 1.0 if w is None else 0.0 if w != w or w < 0 else w
    own = [(t, weight(w)) for _, s, t, w in docs if s == "a"]
    goal, usable = share * sum(d[2] for d in docs), sum(t for t, w in own if w > 0)
    copies = {d: n for d, _, _, n in used}
    if usable * most <= goal:
        assert not report["a"]["reachable"] and report["a"]["tokens_taken"] == usable * most
        return
    factor = brute_factor(own, goal, most)
    for d, s, t, w in docs[:1500]:
        m = min(weight(w) * factor, most)
        assert int(m + 1e-6) <= copies.get(d, 0) + 1e-9 and copies.get(d, 0) <= m + 1
    assert goal - 100 <= report["a"]["tokens_taken"] <= goal + 1 and report["a"]["reachable"]


@pytest.mark.parametrize("most_broadcast", [100_000, 0])
def test_exact_shares_of_those_that_can_reach_them(spark, most_broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", most_broadcast)  # joined in salted parts if 0
    docs = [(i, "aaab"[i % 4], 1, None) for i in range(4000)] + [(i, "c", 1, None) for i in range(4000, 4100)]
    targets = [("a", 0.5, 1), ("b", 0.2, 1), ("c", 0.3, 2), ("none", 0.0, 1), ("empty", 0.1, 4)]
    targets = [(s, share / 1.1, most) for s, share, most in targets]
    _, every = mixed(spark, docs, targets)
    assert not every["c"]["reachable"] and every["a"]["share_of_base"] == pytest.approx(0.5 / 1.1, abs=1e-3) and every["a"]["error"] == pytest.approx(0, abs=1e-3)
    assert every["a"]["reached_share"] > 0.6  # of what the mix holds
    used, exact = mixed(spark, docs, targets, base="exact")
    assert sum(n for *_, n in used) == pytest.approx(200 / 0.3, abs=3)
    for s, share, _ in targets[:4]:
        assert exact[s]["reached_share"] == pytest.approx(share * 1.1, abs=5e-3) and exact[s]["error"] == pytest.approx(0, abs=5e-3)
    assert exact["empty"]["tokens_taken"] == 0 and not exact["empty"]["reachable"] and exact["empty"]["error"] == pytest.approx(-0.1 / 1.1)
    with pytest.raises(ValueError):
        mixed(spark, docs, targets, base="none")


def test_sources_found_are_used_up(spark, tmp_path, monkeypatch):
    """They come from the drawn documents: without these, all fall short."""
    text = "word " * 50
    spark.createDataFrame([(i, text, "ab"[i % 2], 1) for i in range(40)] + [(99, text, "c", None)], "doc_id long, text string, source string, votes long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 1), ("c", 0.2, 2), ("d", 0.1, 5)], TARGETS).write.parquet(f"{tmp_path}/mix_targets.parquet")
    assert {r[0] for r in queries.p9_found(spark, str(tmp_path)).collect()} == {"c", "d"}
    cut, labels = mixing.cut, []
    monkeypatch.setattr(mixing, "cut", lambda df, label: labels.append(label) or (df.limit(0) if label == "mix" else cut(df, label)))
    assert queries.p9_found(spark, str(tmp_path)).count() == 1 and "mix" in labels  # only d, which holds nothing, has all of it taken


def test_nulls_empty_and_repeated_targets(spark):
    docs = corpus(50, 2)
    used, report = mixed(spark, docs, [(None, 0.5, 1), ("a", None, 2), ("b", 0.01, None), ("b", 0.01, None)])
    assert set(report) == {"a", "b"} and {s for _, s, _, _ in used} <= {"b"}
    assert report["b"]["target_share"] == pytest.approx(0.02) and report["b"]["max_repeats"] == 1
    assert mixed(spark, docs, []) == ([], {})
    used, report = mixed(spark, [], [("a", 0.5, 1)])
    assert used == [] and report["a"]["tokens_taken"] == 0 and report["a"]["reachable"]


def test_many_rows_of_few_target_sources(spark):
    docs = [(i, "ab"[i % 2], 10, None) for i in range(100)]
    targets = [("a", 0.0625, 1)] * 4 + [("b", 0.125, 1), ("b", 0.25, 2), (None, 0.5, 1)]
    _, report = mixed(spark, docs, targets)
    assert {s: (r["target_share"], r["max_repeats"]) for s, r in report.items()} == {"a": (0.25, 1), "b": (0.375, 2)}


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 10)
    docs = [(i, f"s{i % 300}", 10, None) for i in range(6000)]
    used, report = mixed(spark, docs, [(f"s{k}", 1 / 300, 1) for k in range(300)])
    assert len(report) == 300 and len(used) >= 5700 and all(r["tokens_taken"] >= 190 for r in report.values())
