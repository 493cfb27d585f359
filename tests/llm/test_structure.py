"""Repeated passages of words, periodic runs and the Merkle manifest against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planlake.llm import debruijn, merkle, runs
from tests.llm import brute


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_repeated_passages(request, which):
    df = request.getfixturevalue(which)
    assert rows_of(debruijn.op11_debruijn_paths(df)) == Counter(brute.repeated_passages(pairs(df)))


def branching_texts(words):
    """Shared passages that meet, part, nest, overlap and loop, so that nodes branch at every turn."""
    rng = random.Random(3)
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    a, b, c = prose(120), prose(60), prose(35)
    texts = [a + b, a + c, prose(9) + b + c, a[:70] + prose(5) + a[70:], a[20:60], c, c[:-1], prose(40) + c + prose(3) + c, ["x"] * 90, ["x", "y"] * 50, ["x", "y", "z"] * 12, a[60:] + a[:60]]
    texts += [prose(20) + a[i : i + 50] + prose(7) for i in range(0, 60, 7)] + [b[i:] + b[:i] for i in range(0, 60, 11)]
    few = words[:3]
    texts += [[rng.choice(few) for _ in range(200)] for _ in range(12)]
    return [" ".join(t) for t in texts] + ["\n ".join(a), "\t".join(["é", *a, ""])]


@pytest.mark.parametrize("chunk", [(1 << 20, 1 << 18), (300, 64)])
def test_repeated_passages_that_branch(spark, words, monkeypatch, chunk):
    rows = list(enumerate(branching_texts(words)))
    monkeypatch.setattr(debruijn, "CHUNK", chunk[0])
    monkeypatch.setattr(debruijn, "PIECE", chunk[1])
    df = spark.createDataFrame([*rows, rows[0], rows[0], (None, rows[2][1]), (None, None)], "doc_id long, text string")
    if chunk[0] == 300:  # the workers have the module's own sizes, so pieces are tried here
        for _, text in rows:
            data = debruijn.np.frombuffer(text.encode(), debruijn.np.uint8)
            want = debruijn.word_digests(data, debruijn.np.array([0, len(data)]))[0]
            assert (debruijn._long_digests(data) == want).all() and len(want) == len(brute.words(text))
        return
    assert rows_of(debruijn.op11_debruijn_paths(df)) == Counter(brute.repeated_passages(pairs(df)))


def test_paths_are_compacted(spark, words):
    """Copies of one long text are walks over a single path, and a text of its own is none."""
    rng = random.Random(8)
    long = " ".join(rng.choice(words) for _ in range(900))
    other = " ".join(rng.choice(words) for _ in range(300))
    df = spark.createDataFrame([(1, long, 1), (2, "lead " + long, 2), (3, long + " tail", 3), (4, other, 4)], "did long, text string, th long")
    found = sorted((r.did, r.enter, r.edges) for r in debruijn.compacted(debruijn.repeated_paths(df.select("did", "th", "text"))).collect())
    assert found == [(1, 0, 866), (2, 1, 866), (3, 0, 866)]
    kept = {r.doc_id: (r.kept, [tuple(c) for c in r.cuts]) for r in debruijn.remove_repeated_passages(df.withColumnRenamed("did", "doc_id")).collect()}
    assert kept == {1: ("", [(0, 900)]), 2: ("lead", [(1, 901)]), 3: ("tail", [(0, 900)]), 4: (other, [])}


def test_runs_equal_plain_runs():
    rng = random.Random(1)
    for _ in range(3000):
        letters, n = rng.choice([1, 2, 2, 3, 4]), rng.randint(0, 60)
        s = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 6)
            s = [s[i] if i < a else s[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert runs.runs_of(s) == brute.runs(s), s


def test_runs_are_linear():
    """The longest texts of few letters, where matches are as long as the text, are no slower by the word than short ones."""
    import time

    fib = [[0], [0, 1]]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    for s in ([0] * 100_000, [0, 1] * 50_000, fib[-1], ([0, 1, 1] * 50 + [2]) * 700, [bin(i).count("1") % 2 for i in range(100_000)]):
        began = time.thread_time()
        runs.runs_of(s)
        assert time.thread_time() - began < 20


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_periodic_runs(request, which):
    df = request.getfixturevalue(which)
    assert rows_of(runs.op12_lyndon_runs(df)) == Counter(brute.periodic(*r) for r in pairs(df))


def test_periodic_texts(spark):
    rng = random.Random(4)
    texts = ["a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "a b c " * 4 + "a b", "x " + "a a b " * 9 + "c " + "a a b " * 4, " ".join(["p q r s"] * 30), "a a a a b " * 6]
    texts += [" ".join(rng.choice("ab") for _ in range(300)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string")
    assert rows_of(runs.op12_lyndon_runs(df)) == Counter(brute.periodic(*r) for r in pairs(df))


def test_runs_of_any_words(spark):
    df = spark.createDataFrame([(1, ["b", "a"] * 4 + ["c"], "r"), (2, [], "r"), (3, None, "r")], "id int, words array<string>, found string")
    got = {r.id: (r.runs, r.collapsed, r.found) for r in runs.with_runs(df, "words").collect()}
    assert got == {1: ([(0, 8, 2)], "b a c", "r"), 2: ([], "", "r"), 3: (None, None, "r")}


def full(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_manifest(request, which):
    df = request.getfixturevalue(which)
    assert rows_of(merkle.op13_merkle_manifest(df)) == Counter(brute.merkle(full(df)))


@pytest.mark.parametrize("n", [1, 2, 3, 33, 70, 1100])
def test_manifest_of_uneven_groups(spark, n, monkeypatch):
    """A hot group over several supersteps beside groups of one, two and three rows, ordered in many tasks."""
    monkeypatch.setattr(merkle, "ROWS", 50)
    rows = [(i, f"t{i}", "hot", "s", i) for i in range(n)] + [(None, "x", None, None, None)] + [(5000 + i, "y", "é" * (1 + i // 2), "s", 1) for i in range(5)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars int")
    assert rows_of(merkle.op13_merkle_manifest(df)) == Counter(brute.merkle(full(df)))


def test_manifest_finds_what_was_changed(documents):
    got = merkle.op13_merkle_manifest(documents).collect()
    changed = {r.doc_id for r in documents.where("crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 0 AND n_chars IS NOT NULL").select("doc_id").collect()}
    assert {r.doc_id for r in got if not r.verified} == changed and changed and len(changed) < len(got)


@pytest.mark.parametrize("query", [debruijn.op11_debruijn_paths, runs.op12_lyndon_runs, merkle.op13_merkle_manifest])
def test_empty_and_clashing(spark, empty, query):
    assert query(empty).count() == 0
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame([(1, "a " * 50, "en", "s", 1), (2, "a " * 50, "en", None, None), (3, None, None, "s", 0)], columns)
    clashing = plain
    for name in ("key", "cls", "did", "th", "runs", "words", "g", "i", "n", "leaf", "grp", "tie", "path", "spans", "kept"):
        clashing = clashing.withColumn(name, F.lit("x"))
    assert rows_of(query(clashing)) == rows_of(query(plain))
