"""Repetition measures against brute force, and host verdicts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltmark.llm import queries, repetition


def brute_words(text, run=8):
    words, w = [], ""
    for c in (text or "") + " ":
        if c.isalnum():
            w += c
        elif w:
            words.append(w.lower())
            w = ""
    seen, marked = set(), set()
    for i in range(len(words) - run + 1):
        gram = tuple(words[i:i + run])
        if gram in seen:
            marked.update(range(i, i + run))
        seen.add(gram)
    return len(words), len(marked)


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "b", "ça", "x1", "_", "日本", "Straße"]
    out = []
    for _ in range(n):
        phrase = " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 14)))
        out.append(" ".join(r.choice([phrase, r.choice(vocabulary), phrase.upper()]) for _ in range(r.randrange(0, 12))))
    return out + ["", None, "one", "a " * 7, "a " * 8, "a " * 9, "a," * 5000, "..."]


@pytest.mark.parametrize("run", [1, 3, 8])
def test_repeated_words(run):
    ts = texts(120, run)
    n, again = repetition.repeated_words([t or "" for t in ts], run)
    assert list(zip(n.tolist(), again.tolist())) == [brute_words(t, run) for t in ts]
    assert [x.tolist() for x in repetition.repeated_words([])] == [[], []]


def test_documents_are_judged_whole(spark, monkeypatch):
    monkeypatch.setattr(repetition, "SLICE_CHARS", 50)  # many slices of a batch
    ts = texts(60, 9)
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(ts)], "doc_id long, text string, source string").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("doc", "host", "n_words", "rate", "words_fail")})
    out = {r["doc_id"]: (r["n_words"], r["repeated_words"]) for r in repetition.judge(df).collect()}
    assert out == {i: brute_words(t) for i, t in enumerate(ts)}


def test_shares_of_lines_paragraphs_sentences(spark):
    text = "one two.\none two.\n\nthree four! three four! five"
    row = repetition.judge(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")).first()
    assert row["line_share"] == pytest.approx(8 / 44)
    assert row["paragraph_share"] == 0
    assert row["sentence_share"] == pytest.approx((8 + 11) / (8 + 8 + 11 + 11 + 4))


@pytest.mark.parametrize("is_hot", [False, True])
def test_hosts_are_shrunk_and_joined_back(spark, is_hot, request):
    if is_hot:
        request.getfixturevalue("hot")
    bad, good = "spam spam " * 30, "each of these words is here only once or so it seems to me"
    rows = [(i, bad if i % 10 < 8 else good, "spammy") for i in range(100)] + [(i, good if i % 50 else bad, "clean") for i in range(100, 400)]
    rows += [(400, bad, "single"), (401, good, None), (402, good, None), (402, good, None)]
    out = repetition.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), bad_rate=0.5).collect()
    assert len(out) == len(rows)
    rate = {r["source"]: r["rate"] for r in out}
    fails = Counter(r["source"] for r in out if r["words_fail"])
    assert 0.7 < rate["spammy"] <= 0.8 and 0.02 <= rate["clean"] < 0.1
    assert rate["single"] < 1 and rate[None] > 0  # one document is no proof
    assert {r["source"] for r in out if r["host_bad"]} == {s for s in rate if rate[s] > 0.5}
    assert fails["spammy"] == 80


def test_found_documents_come_from_the_joined_verdicts(spark, tmp_path, monkeypatch):
    rows = [(1, "spam " * 30, "a"), (2, "spam " * 30, None), (3, "once only", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[0] for r in queries.p10_found(spark, str(tmp_path)).collect()} == {1, 2}
    verdicts = repetition.host_verdicts

    def broken(judged, bad_rate):
        return verdicts(judged, bad_rate).withColumn("host_bad", F.raise_error(F.lit("host judged")).cast("boolean"))

    assert "Join" in queries.p10_found(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(repetition, "host_verdicts", broken)
    with pytest.raises(Exception, match="host judged"):
        queries.p10_found(spark, str(tmp_path)).collect()


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert repetition.judge(empty).count() == 0


def test_threshold_is_exact(spark):
    rows = [(10, 3), (10, 4), (1000, 300), (1000, 301), (0, 0)]
    df = spark.createDataFrame([(*r, 0.3, 0.3, 0.31) for r in rows], "n_words long, repeated_words long, line_share double, paragraph_share double, sentence_share double")
    out = {(r["n_words"], r["repeated_words"]): r for r in repetition.with_rules(df).collect()}
    assert [out[r]["words_fail"] for r in rows] == [False, True, False, True, False]
    assert not out[(0, 0)]["lines_fail"] and out[(0, 0)]["sentences_fail"]
