"""Mixing sources to target weights, with whole copies and Pareto sampling.

The goal of a source is its target share of the size of all documents (or of
another size, see ``base``). Of a document of weight w as many copies are needed
as w times a factor of its source, at most the source's cap; the factor is the
one with which the copies add up to the goal. The whole part of that number is
allocated for certain, the fractional part is the probability of one copy more.
That copy is drawn by Pareto order sampling: documents are ranked by the odds of
a random number divided by the odds of their inclusion, u/(1-u) / (p/(1-p)), and
the first of them are taken until the goal is reached, so the sample's size is
fixed and inclusion unequal where weights are. The random number is a hash of
the document's id and a seed, so every run and every retry draws the same.

Weights are any numbers. The factor starts at goal / sum(size * w); documents
that reach the cap are set aside and the rest is divided again, until no more
reach it (Newton's method on a concave sum of as many pieces as weights): each
round one sum per source. The rank at which to stop is found by sums per bucket
of ranks, then exactly within one bucket whose size does not grow with the input.

``base`` is the size that shares are of: ``all`` documents, of whatever source;
or ``exact``, the largest size up to that of which every source that holds
anything can reach its share, so that the sources are in the mix in exactly the
proportion of their targets.

Defined results: null sizes and sizes below 0 count 0; null weights are 1, those
below 0 (and NaN) 0, and documents of weight 0 are never drawn; documents of no
target source (or none at all) count in the total and are never drawn; repeated
documents are documents of their own; a source without documents reaches 0; null
or repeated targets: a null share is 0, null repeats are 1, rows of one source
are added up (their largest repeats hold); without documents or targets there
are no rows drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators.skew import hot_keys, skew_join
from siltmark.session import cut

#: Sources up to which their plan, some 60 bytes each, is broadcast; more are joined in salted parts.
MAX_BROADCAST = 100_000
BUCKET_ROWS = 1_000_000


def _to_sources(docs: DataFrame, plan: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    return docs.join(F.broadcast(plan), "s", how) if hot is None else skew_join(docs, plan, ["s"], how, hot)


def _goals(docs: DataFrame, targets: DataFrame, base: str) -> tuple[DataFrame, float]:
    """A written row per target source: s, share, most, tokens, usable, mass,
    top, goal; and the size that shares are of."""
    share, most = F.coalesce("target_share", F.lit(0.0)), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    wanted = targets.filter("source is not null").groupBy(F.col("source").alias("s")).agg(F.sum(share).alias("share"), F.max(most).cast("long").alias("most"))
    held = docs.groupBy("s").agg(F.sum("t").alias("tokens"), F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("t"))), F.lit(0)).alias("usable"),
                                 F.sum(F.col("t") * F.col("w")).alias("mass"), F.max("w").alias("top"))
    held = cut(held, "held")
    plan = wanted.join(held, "s", "left").fillna({"tokens": 0, "usable": 0, "mass": 0.0, "top": 0.0})
    size = float(held.agg(F.sum("tokens")).first()[0] or 0)
    if base == "exact":
        room = F.col("usable") * F.col("most") / F.col("share")
        least = plan.filter("usable > 0 and most > 0 and share > 0").agg(F.min(room)).first()[0]
        size = size if least is None else min(size, least)
    elif base != "all":
        raise ValueError(f"base {base!r} is neither 'all' nor 'exact'")
    return cut(plan.withColumn("goal", F.col("share") * F.lit(size)), "goals"), size


def _factors(docs: DataFrame, plan: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Adds ``factor`` to the plan, null where every document gets all copies."""
    full = F.col("usable") * F.col("most") <= F.col("goal")
    plan = plan.withColumn("factor", F.when(~full, F.col("goal") / F.col("mass"))).withColumn("n_capped", F.lit(0).cast("long"))
    open_ = F.col("top") * F.col("factor") > F.col("most")
    while not plan.filter(open_).isEmpty():
        seen = _to_sources(docs, plan.filter(open_).select("s", "factor", "most"), hot)
        capped = F.col("w") * F.col("factor") > F.col("most")
        sums = seen.groupBy("s").agg(F.count(F.when(capped, 1)).alias("now"), F.coalesce(F.sum(F.when(capped, F.col("t"))), F.lit(0)).alias("above"),
                                     F.sum(F.when(~capped, F.col("t") * F.col("w"))).alias("below"))
        step = cut(plan.join(sums, "s", "left"), "factors")
        if step.filter("now > n_capped").isEmpty():
            break
        more = F.col("now") > F.col("n_capped")
        again = (F.col("goal") - F.col("most") * F.col("above")) / F.col("below")
        plan = step.withColumn("factor", F.when(more, again).otherwise(F.col("factor"))).withColumn("n_capped", F.when(more, F.col("now")).otherwise(F.col("n_capped")))
        plan = plan.drop("now", "above", "below")
    return plan


def mix(sized: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", size: str = "tokens",
        weight: str | None = None, seed: int = 7, base: str = "all") -> tuple[DataFrame, DataFrame]:
    """``sized`` has a row per document, best from a written table as it is read
    several times. Returns (doc, source, size, copies) of the documents used,
    and the report, made from these: (source, target_share, max_repeats,
    tokens_available, tokens_taken, reached_share of the mix, share_of_base,
    error of that, reachable)."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    w = F.when(F.isnan(w) | (w < 0), 0.0).otherwise(w)
    docs = sized.select(F.col(doc).alias("d"), F.col(source).alias("s"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("t"), w.alias("w"))
    plan, total = _goals(docs, targets, base)
    hot = None if plan.count() <= MAX_BROADCAST else hot_keys(docs.selectExpr("xxhash64(s) AS k"))
    plan = cut(_factors(docs, plan, hot), "plan")

    copies = F.least(F.col("w") * F.coalesce("factor", F.lit(float("inf"))), F.col("most").cast("double"))
    used = _to_sources(docs.filter("w > 0"), plan.select("s", "most", "factor"), hot).withColumn("m", copies)
    used = used.withColumn("whole", F.floor("m").cast("int")).withColumn("part", F.col("m") - F.floor("m"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "d"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    used = used.withColumn("q", F.when(F.col("part") > 0, odds))
    goals = cut(used.filter("part > 0").groupBy("s").agg(F.sum(F.col("part") * F.col("t")).alias("goal"), F.count(F.lit(1)).alias("n")), "parts")
    buckets = max(64, (goals.agg(F.max("n")).first()[0] or 0) // BUCKET_ROWS * 4 + 1)
    used = used.withColumn("b", F.least(F.floor(F.col("q") / (1 + F.col("q")) * buckets), F.lit(buckets - 1)).cast("long"))
    sums = used.filter("part > 0").groupBy("s", "b").agg(F.sum("t").alias("t"))
    after = F.sum("t").over(Window.partitionBy("s").orderBy("b"))  # a row per bucket
    edges = sums.withColumn("after", after).join(goals.select("s", "goal"), "s").withColumn("before", F.col("after") - F.col("t"))
    edges = cut(edges.filter("after > goal and before <= goal").groupBy("s").agg(F.min(F.struct("b", "before", "goal")).alias("e")), "edges")
    placed = _to_sources(used.select("d", "s", "t", "whole", "part", "q", "b"), edges, hot, "left")
    close = F.coalesce(F.col("b") == F.col("e.b"), F.lit(False))
    drawn = (F.col("part") > 0) & F.coalesce(F.col("b") < F.col("e.b"), F.lit(True))
    clear = placed.filter(~close).select("d", "s", "t", (F.col("whole") + drawn.cast("int")).alias("copies"))
    so_far = F.sum("t").over(Window.partitionBy("s").orderBy("q", "d", "t").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.filter(close).withColumn("r", so_far + F.col("e.before"))
    edge = edge.select("d", "s", "t", (F.col("whole") + (F.col("r") <= F.col("e.goal")).cast("int")).alias("copies"))
    taken = cut(clear.unionByName(edge).filter("copies > 0"), "mix")

    got = taken.groupBy("s").agg(F.sum(F.col("t") * F.col("copies")).alias("got"))
    everything = int(taken.agg(F.sum(F.col("t") * F.col("copies"))).first()[0] or 0)
    lines = plan.join(got, "s", "left").fillna({"got": 0})
    # Used up: every document as often as allowed, and the goal not reached.
    used_up = (F.col("got") == F.col("usable") * F.col("most")) & (F.col("got") < F.col("goal"))
    of = lambda n: F.col("got") / F.lit(float(n)) if n else F.lit(0.0)
    report = lines.select(F.col("s").alias(source), F.col("share").alias("target_share"), F.col("most").cast("int").alias("max_repeats"),
                          F.col("tokens").alias("tokens_available"), F.col("got").alias("tokens_taken"), of(everything).alias("reached_share"),
                          of(total).alias("share_of_base"), (of(total) - F.col("share")).alias("error"), (~used_up).alias("reachable"))
    return taken.select(F.col("d").alias(doc), F.col("s").alias(source), F.col("t").alias(size), "copies"), report
