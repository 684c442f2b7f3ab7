"""Repetition inside documents, with verdicts on the hosts they come from.

Per document, over its whole text: the share of words that lie in a run of
``run`` words seen before in the document, and the shares of lines, paragraphs
and sentences that repeat an earlier one. Each share has a rule (a threshold).
Rule failures are added up by host; a host's rate is shrunk towards the rate of
all hosts by a beta prior fitted to the hosts' rates (method of moments), so a
host of few documents isn't judged by chance; verdicts on hosts are joined back
to the documents. Hot hosts (see ``skew``) are spread over salts in that join.

Runs of words are compared exactly: words become numbers, and ranks of pairs,
pairs of pairs and so on become numbers again, for many documents at a time.

Defined results: a null text counts as empty; a text of fewer than ``run`` words
repeats no words; a text without words has share 0; a null host is a host of
its own; documents repeated in the table are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.operators.skew import skew_join

RUN = 8
SLICE_CHARS = 4_000_000
#: Largest shares that pass, per rule.
LIMITS = {"words": 0.30, "lines": 0.30, "paragraphs": 0.30, "sentences": 0.30}

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def _ranks(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1]


def repeated_words(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Words, and repeated words, of each text."""
    words = [_WORD.findall(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    if not total:
        return counts, np.zeros(len(texts), np.int64)
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    del words
    lower, _ = pd.factorize(np.array([w.lower() for w in distinct], dtype=object))
    codes = lower[codes].astype(np.int64)
    # rank[i] stands for the words i .. i+have-1; each round joins two of them.
    rank, have = codes, 1
    while have < run:
        step = min(have, run - have)
        later = np.concatenate([rank[step:], np.zeros(min(step, total), np.int64)])[:total]
        rank = _ranks(rank * (int(rank.max()) + 1) + later)
        have += step
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(total) - starts[doc]
    at = np.flatnonzero(place + run <= counts[doc])
    if not len(at):
        return counts, np.zeros(len(texts), np.int64)
    _, first = np.unique(doc[at] * (int(rank.max()) + 1) + rank[at], return_index=True)
    again = np.ones(len(at), bool)
    again[first] = False
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + run, -1)
    marked = np.cumsum(cover[:total]) > 0
    return counts, np.bincount(doc, weights=marked, minlength=len(texts)).astype(np.int64)


def repeated_share(parts: list[str]) -> float:
    """Share of characters in parts that repeat an earlier part."""
    seen: set[str] = set()
    size = again = 0
    for p in parts:
        p = p.strip()
        size += len(p)
        if p in seen:
            again += len(p)
        else:
            seen.add(p)
    return again / size if size else 0.0


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > SLICE_CHARS:
            yield begin, i
            begin, chars = i, 0
        chars += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def measures(docs: DataFrame, doc: str, text: str, host: str, run: int = RUN) -> DataFrame:
    """(doc, host, n_words, repeated_words, line_share, paragraph_share,
    sentence_share) of every document."""
    kind = docs.schema[doc].dataType.simpleString()
    schema = f"doc {kind}, host string, n_words bigint, repeated_words bigint, line_share double, paragraph_share double, sentence_share double"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in _slices(texts):
                own = texts[lo:hi]
                n, again = repeated_words(own, run)
                shares = [pa.array([repeated_share(cut_up(t)) for t in own], pa.float64())
                          for cut_up in (lambda t: t.split("\n"), _PARAGRAPH.split, _SENTENCE.split)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(again), *shares],
                                                 names=["doc", "host", "n_words", "repeated_words", "line_share", "paragraph_share", "sentence_share"])

    return docs.select(F.col(doc).alias("doc"), F.col(host).cast("string").alias("host"), text).mapInArrow(measure, schema)


def with_rules(measured: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Adds a boolean per rule; the rule on words in whole hundredths, exactly."""
    words = F.col("repeated_words") * 100 > F.col("n_words") * round(limits["words"] * 100)
    return (measured.withColumn("words_fail", words).withColumn("lines_fail", F.col("line_share") > limits["lines"])
            .withColumn("paragraphs_fail", F.col("paragraph_share") > limits["paragraphs"])
            .withColumn("sentences_fail", F.col("sentence_share") > limits["sentences"]))


def host_verdicts(judged: DataFrame, bad_rate: float = 0.2) -> DataFrame:
    """(host, docs, failures, rate, host_bad): rates shrunk by the beta prior.

    The prior's two parameters are one row of sums over the hosts."""
    fails = F.greatest(*[F.col(c).cast("int") for c in ("words_fail", "lines_fail", "paragraphs_fail", "sentences_fail")])
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(fails).alias("failures"))
    raw = F.col("failures") / F.col("docs")
    n, all_docs, all_fails, var, size = hosts.agg(
        F.count(F.lit(1)), F.sum("docs"), F.sum("failures"), F.var_pop(raw), F.avg("docs")).first()
    mean = (all_fails or 0) / all_docs if all_docs else 0.0
    spread = mean * (1 - mean)
    # Of the spread of rates, what isn't chance in hosts of the usual size.
    between = max((var or 0.0) - spread / max(size or 1.0, 1.0), 0.0)
    strength = min(max(spread / between - 1, 1.0), 1e6) if between > 0 else (1e6 if n and n > 1 else 1.0)
    alpha, beta = mean * strength, (1 - mean) * strength
    rate = (F.col("failures") + F.lit(alpha)) / (F.col("docs") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("host_bad", F.col("rate") > bad_rate)


def judge(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", limits: dict[str, float] = LIMITS,
          run: int = RUN, bad_rate: float = 0.2, written=lambda df: df) -> DataFrame:
    """Every document with its measures, rules, and its host's rate and verdict.
    ``written`` keeps the measures, which are read twice."""
    judged = written(with_rules(measures(docs, doc, text, host, run), limits))
    verdicts = host_verdicts(judged, bad_rate).select("host", "rate", "host_bad")
    # Every document has a host with a verdict, if only the null one.
    out = skew_join(judged, verdicts, ["host"], "inner")
    return out.withColumnRenamed("doc", doc).withColumnRenamed("host", host)
