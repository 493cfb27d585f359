"""Nearest neighbours, toxicity, decontamination, preference rows, components and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planlake.llm import ann, components, decontam, preference, toxicity
from planlake.llm.common import table
from tests.llm import brute


def nearest(ids, vectors, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in [i for i, v in enumerate(ids) if v % 50 == 0]:
        score = unit @ unit[q]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-score[j], ids[j]))[:k]
        out[ids[q]] = [(ids[j], score[j]) for j in order]
    return out


def test_neighbours_small_table(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    want = nearest([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    got = {}
    for r in ann.op2_additive_quantisation(table(spark, sf, "embeddings")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    exact = {(r.vec_id): np.array(r.embedding, float) for r in rows}
    for q, found in got.items():
        for i, s in found:
            a, b = exact[q], exact[i]
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_neighbours_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [-1.0, 0.0])]
    bad = [(100, None), (150, [0.0, 0.0]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad + good[:1]], "vec_id long, embedding array<float>, label int, v string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.op2_additive_quantisation(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (50, 1, 1), (50, 2, 2), (50, 3, 0), (50, 4, 3)]
    assert ann.op2_additive_quantisation(df.where("vec_id < 0")).count() == 0


def test_neighbours_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    vectors = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    for name, value in (("CODE_ROWS", 500), ("QUERY_ROWS", 20)):
        monkeypatch.setattr(ann, name, value)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want, got = nearest(list(range(3000)), vectors), {}
    for r in ann.op2_additive_quantisation(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len({i for i, _ in want[q]} & got[q]) for q in want) >= 0.95 * 5 * len(want)


def test_copies_of_a_vector_come_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(1000 + i, [1.0, float(i), -1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.op2_additive_quantisation(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == got[650] == [0, 1, 2, 3, 4]


def test_neighbours_stay_found_as_the_table_grows():
    """40,000 vectors without clusters, where the nearest stand out least: recall of the candidates before reranking."""
    rng = np.random.default_rng(3)
    x = ann._units(rng.normal(size=(40_000, 64)))
    books = ann.fit(x[: ann.SAMPLE_ROWS])
    codes, norms = (np.concatenate(c) for c in zip(*[ann.encode(x[i : i + 1024], books) for i in range(0, len(x), 1024)], strict=True))
    hits = 0
    for q in range(0, 40_000, 400):
        exact, table = x @ x[q], books @ x[q]
        estimate = sum(table[j][codes[:, j]] for j in range(len(books))) / norms
        exact[q] = estimate[q] = -np.inf
        hits += len(set(np.argsort(-exact)[:5].tolist()) & set(np.argsort(-estimate)[: ann.RERANK].tolist()))
    assert hits >= 0.95 * 5 * 100


def test_copies_do_not_crowd_out_neighbours(spark):
    """Thousands of scaled and plain copies of vectors near a query, and a nearer one whose estimate may come behind theirs."""
    rng = np.random.default_rng(4)
    q, far = rng.normal(size=(2, 16))
    near = [q + 0.02 * rng.normal(size=16) for _ in range(5)]
    crowd = q + 0.3 * rng.normal(size=16)
    vectors = [q, *near, *[crowd * (2.0 ** (i % 12)) for i in range(3000)], *rng.normal(size=(1000, 16))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = ann.usable(df.where("vec_id = 0"))
    got = ann.search(queries, ann.usable(df), rerank=10).orderBy("rank").collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4, 5}
    assert ann.search(queries, ann.usable(df.where("vec_id = 0 OR vec_id > 5")), rerank=10).orderBy("rank").first().vec_id <= 17


def test_beam_search_beats_greedy_encoding():
    rng = np.random.default_rng(2)
    x = ann._units(rng.normal(size=(800, 16)))
    books = ann.fit(x, m=4, k=16)
    error = lambda beam: float(((x - sum(books[j][ann.encode(x, books, beam)[0][:, j]] for j in range(4))) ** 2).sum())
    assert error(8) < error(1)


def test_codebooks_are_refitted_in_little_memory():
    """The sweeps near the least squares of all codewords at once, and 768 dimensions stay far below what their normal equations would take, 19 GB."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = ann._units(rng.normal(size=(1500, 12)))
    books = ann.fit(x, m=3, k=8)
    codes = ann.encode(x, books)[0]
    error = lambda b: float(((x - sum(b[j][codes[:, j]] for j in range(3))) ** 2).sum())
    design = np.zeros((1500, 24))
    for j in range(3):
        design[np.arange(1500), 8 * j + codes[:, j]] = 1
    best = np.linalg.lstsq(design, x, rcond=None)[0].reshape(3, 8, 12)
    assert error(ann.refit(x, books, codes, 30)) <= error(best) * 1.001
    wide = ann._units(rng.normal(size=(2000, 768)))
    codes = rng.integers(0, 256, (2000, ann.books_for(768)))
    books = (0.01 * rng.normal(size=(ann.books_for(768), 256, 768))).astype(np.float32)
    tracemalloc.start()
    ann.refit(wide, books, codes, 1)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_estimates_ranked_grow_with_the_table():
    rng = np.random.default_rng(6)
    x = ann._units(rng.normal(size=(2000, 16)))
    books = ann.fit(x, m=2, k=16)
    few, more, most = (ann.rerank_for(x, books, n) for n in (2000, 200_000, 20_000_000))
    assert few == ann.RERANK <= more < most and most >= 8 * more


def test_copies_are_few_when_they_move(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, v array<double>")
    place = F.row_number().over(ann._by("v", "vec_id"))
    plan = df.withColumn("nth", place).where(F.col("nth") <= 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan  # before and after the shuffle


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["scum", "vile", "rot"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(1500, 4)
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t, _ in rows] + [(9001, None, None, 0), (9002, "", "", 0), (None, "scum", "", 0), (0, rows[0][1], "x", 9)], "doc_id long, text string, toxicity string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(1, None), (None, 1), (77_777, 1)], "doc_id long, toxic int")
    got = toxicity.op6_toxicity_ftrl(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: y for i, _, y in rows}
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in got if not r.predicted} == {r.doc_id for r in kept.collect()}


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    rows = toxic_rows(400, 8)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - y if flip else y) for i, _, y in rows], "doc_id long, toxic int")
        kept = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
        both = labels.where(toxicity.held_out(labels.doc_id)).union(kept.where(~toxicity.held_out(kept.doc_id)))
        scores.append({r.doc_id: r.score for r in toxicity.op6_toxicity_ftrl(docs, both).collect()})
    assert scores[0] == scores[1]


def test_toxicity_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.op6_toxicity_ftrl(docs, none).first().score == 0.0
    assert toxicity.op6_toxicity_ftrl(docs.where("false"), none).count() == 0


def plain_alignment(item, words):
    best, rows = 0.0, [[0.0] * (len(words) + 1)]
    for a in item:
        row = [0.0]
        for j, b in enumerate(words, 1):
            row.append(max(0.0, rows[-1][j - 1] + (1.0 if a == b else -0.5), rows[-1][j] - 0.5, row[-1] - 0.5))
            best = max(best, row[-1])
        rows.append(row)
    return best / len(item)


def test_alignment_equals_the_plain_one():
    rng = np.random.default_rng(6)
    for _ in range(60):
        item, words = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64)
        score, first, end = decontam.align(item, words)
        assert score == pytest.approx(plain_alignment(item.tolist(), words.tolist()))
        assert score == 0 or plain_alignment(item.tolist(), words[first:end].tolist()) == pytest.approx(score)


def test_leaks(spark, words):
    rng = random.Random(12)
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [prose(rng.randint(12, 40)) for _ in range(12)] + [["only", "two"]]
    edited = list(items[3])
    edited[5], edited[-3] = "otherword", "anotherword"
    del edited[8]
    docs = [(1, prose(50) + items[0] + prose(50)), (2, prose(30) + edited), (3, prose(2000)), (4, items[5][: len(items[5]) // 3] + prose(40)), (5, ["X"] + items[12] + ["Y"]), (6, items[7] + items[8])]
    rows = [(i, " ".join(w).upper() if i == 6 else ", ".join(w)) for i, w in docs] + [(7, None), (8, ""), (None, " ".join(items[0])), (1, ", ".join(docs[0][1]))]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, item_id string, score int")
    bench = spark.createDataFrame([(i, " ".join(w), "b") for i, w in enumerate(items)] + [(98, None, ""), (99, "", "")], "item_id long, text string, doc_id string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.op10_rare_seed_alignment(df, bench).collect())
    assert got == {(1, 0): 2, (2, 3): 1, (5, 12): 1, (6, 7): 1, (6, 8): 1, (None, 0): 1}
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 7, 8]


def test_leaks_with_one_seed_left(spark, words):
    """Insertions that leave an item one trigram, far from the copy's other end."""
    short, long = words[:10], words[20:40]
    copies = [[*short[:2], "x", *short[2:4], "x", *short[4:7], "x", *short[7:9], "x", short[9]]]
    copies.append([w for k, a in enumerate(long) for w in ([a] if k in (0, 2, 19) or k % 2 else [a, "x"])])
    copies.append([w for k, a in enumerate(long) for w in ([a, "x"] if k % 2 == 1 and k < 18 else [a])])
    df = spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(copies)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(short)), (1, " ".join(long))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_seeds, r.score) for r in decontam.op10_rare_seed_alignment(df, bench).collect()}
    assert got[0, 0][0] >= 1 and got[0, 0][1] == 0.8
    items = {0: short, 1: long}
    for i, c in enumerate(copies):
        for k, item in items.items():
            held = {tuple(c[j : j + 3]) for j in range(len(c) - 2)} | {(c[j], c[j + m], c[j + 3]) for j in range(len(c) - 3) for m in (1, 2)}
            shared = {tuple(item[j : j + 3]) for j in range(len(item) - 2)} & held
            score = plain_alignment(item, c)
            assert ((i, k) in got) == bool(shared and score >= 0.6)
            assert (i, k) not in got or got[i, k][1] == pytest.approx(score)


def test_leaks_with_a_word_put_in_after_every_second(spark, words):
    """No three words of the item stand together, yet it is found, where its start falls on either word."""
    item = words[50:74]
    copies = [[w for k, a in enumerate(item) for w in ([a, f"x{k}"] if k % 2 == odd else [a])] for odd in (0, 1)]
    df = spark.createDataFrame([(i, " ".join(words[:9] + c + words[9:20])) for i, c in enumerate(copies)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.op10_rare_seed_alignment(df, bench).collect()}
    assert got == {i: pytest.approx(plain_alignment(item, c)) for i, c in enumerate(copies)} and all(0.7 < x < 0.8 for x in got.values())


def test_leaks_are_judged_by_row(spark, words):
    rng = random.Random(13)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(20)
    rows = [(1, prose(30) + " " + item), (1, "clean " + prose(30)), (None, item), (None, "fresh " + prose(30)), (None, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = [rows[1], rows[3], rows[4]]
    assert Counter(map(tuple, decontam.without_leaks(df, bench, keep_unnamed=False).collect())) == Counter(clean)
    assert Counter(map(tuple, decontam.without_leaks(df, bench).collect())) == Counter([*clean, rows[2]])


def test_leaks_in_blocks(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.leaks(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    assert Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.leaks(docs, bench).collect()) == whole
    assert decontam.leaks(docs.where("false"), bench).count() == decontam.leaks(docs, bench.where("false")).count() == 0


def test_leaks_equal_whole_alignments(spark, sf):
    """The whole query against every item aligned with every whole text that holds one of its rare grams."""
    docs = table(spark, sf, "documents").where("length(text) < 2500").select("doc_id", "text")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    known = [r.text for r in items.collect()]
    rng = random.Random(6)
    edited = []
    for k, t in enumerate(known[:12]):
        words = t.split(" ")
        for _ in range(len(words) // (3 + k % 5)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], ["inserted", words[i]], ["changed"]])
        edited.append((10_000 + k, "before " * k + " ".join(words) + " after" * k))
    docs = docs.union(spark.createDataFrame([*edited, (None, known[0]), (20_000, None), (20_001, "")], "doc_id long, text string"))
    items = items.union(spark.createDataFrame([(900, known[3]), (901, "two words"), (902, None), (903, "")], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.op10_rare_seed_alignment(docs, items).collect()}
    pairs = lambda df: [tuple(r) for r in df.collect()]
    want = brute.leaked(pairs(docs), pairs(items), decontam.GRAM, decontam.RARE_FACTOR, decontam.THRESHOLD, (decontam.MATCH, decontam.MISMATCH, decontam.GAP))
    assert got == pytest.approx(want) and len(want) > 12 and (None, 0) in {(d, 0) for d, _ in want}


def test_leaks_of_repeated_items_over_blocks(spark, monkeypatch):
    """A benchmark that repeats its texts is counted and aligned once a text, whatever the blocks."""
    texts = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcdef"]
    items = spark.createDataFrame([(i, texts[i % 6]) for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x y {t} z") for i, t in enumerate(texts)], "doc_id long, text string")
    for words in (10**6, 24):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect())
        assert got == [(d, i) for d in range(6) for i in range(d, 60, 6)]


def test_toxicity_equals_plain_ftrl(spark, sf):
    """Weights and scores against learning with dictionaries, row by row."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    features, weights = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    order = [r.doc_id for r in labels.where(~toxicity.held_out(labels["doc_id"])).selectExpr("doc_id", "xxhash64(doc_id) AS place").orderBy("place").collect()]
    rows = [(sorted(brute.features(texts[i])), known[i]) for i in order if i in texts and i in known] * toxicity.EPOCHS
    want = brute.ftrl(rows, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    assert dict(zip(features.tolist(), weights.tolist(), strict=True)) == pytest.approx(want, abs=1e-9) and len(want) > 5
    got = {r.doc_id: r.score for r in toxicity.op6_toxicity_ftrl(docs, labels).collect()}
    assert got == pytest.approx({i: 1 / (1 + np.exp(-sum(want.get(f, 0.0) for f in brute.features(t)))) for i, t in texts.items()}, abs=1e-9)


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_with_coarse_cells(spark, monkeypatch, clusters):
    """With many cells, recall stays; clustered vectors need few of them, unit vectors without structure most."""
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    monkeypatch.setattr(ann, "LEAST_ROWS", 256)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 24)) + (3 * rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 3000)] if clusters else 0)
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    want, got = nearest(ids, vectors), {}
    for r in ann.op2_additive_quantisation(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 60 and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 5 for q in want]) > 0.95
    units = ann._units(vectors)
    cells = ann.coarse_cells(units, 8)
    probed = ann.probes_for(units, cells).shape[1]
    assert probed <= 5 if clusters else probed >= 5


def test_names_of_other_columns_are_kept(spark, sf):
    from planlake.llm import mixing

    docs = table(spark, sf, "documents").limit(60)
    for c in ("toxicity", "__tag", "of_text", "of_doc", "got", "times", "copy", "leaked", "a.b"):
        docs = docs.withColumn(c, docs["lang"])
    scored = toxicity.score_documents(docs, table(spark, sf, "labels"))
    assert scored.columns == [*docs.columns, "_toxicity"] and scored.where("toxicity <> lang").count() == 0
    assert mixing.mixed(docs).where("times <> lang OR `a.b` <> lang").count() == 0 and mixing.mixed(docs).columns == docs.columns
    assert decontam.without_leaks(docs, table(spark, sf, "benchmark")).columns == docs.columns


def test_preferences(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (1, 5, "user", "w"), (2, 0, "user", "only"), (3, 0, "assistant", "alone"), (4, 0, "user", "same"), (4, 1, "assistant", "same"), (None, 0, "user", "x"), (5, None, "user", "x"), (6, 0, None, None), (6, 1, "assistant", "b"), (1, 1, "user", "u")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, part string")
    got = sorted(tuple(r)[:7] for r in preference.rendered_turns(preference.stale_reply_sides(df)).collect())
    head = lambda role: f"<|{role}|>\n"
    want = [(1, p, t, r, head(r), f"{x}<|end|>\n", p != "prompt" and r == "assistant") for p, t, r, x in [("prompt", 0, "system", "s"), ("prompt", 1, "user", "u"), ("prompt", 2, "assistant", "a"), ("prompt", 3, "user", "v"), ("chosen", 4, "assistant", "b"), ("rejected", 4, "assistant", "a")]]
    want += [(6, "prompt", 0, "", head(""), "<|end|>\n", False), (6, "chosen", 1, "assistant", head("assistant"), "b<|end|>\n", True), (6, "rejected", 1, "assistant", head("assistant"), "<|end|>\n", True)]
    assert got == sorted(want)
    assert sorted(tuple(r)[:7] for r in preference.format_preferences(*preference.stale_reply_pairs(df)).collect()) == sorted(want)
    records = {r.conv_id: r for r in preference.op7_preference_format(df).collect()}
    text = lambda pair, part: "".join(h + b for p, x, _, _, h, b, _ in sorted(want) if (p, x) == (pair, part))
    assert sorted(records) == [1, 6]
    for pair, r in records.items():
        assert (r.block, r.prompt, r.chosen, r.rejected) == (0, text(pair, "prompt"), text(pair, "chosen"), text(pair, "rejected"))
        for side, spans in ((r.chosen, r.chosen_learnt), (r.rejected, r.rejected_learnt)):
            a, b = map(int, spans.split(":"))
            assert side[:a] == head("assistant") and side[a:b] == side[a:] and side.endswith("<|end|>\n")
    assert preference.op7_preference_format(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [256, 50, 1])
def test_preferences_of_very_long_conversations(spark, monkeypatch, block):
    """Rows put together are the whole, and spans count from the start of the completion, in blocks of any length."""
    monkeypatch.setattr(preference, "BLOCK_TURNS", block)
    n, rng = 700, random.Random(4)
    said = [(1, t, "assistant" if t % 3 else "user", "w" * rng.randint(0, 30)) for t in range(n)]
    other = [(p, t, r, x if t < 300 else x + "!") for p, t, r, x in said if t < 650]
    schema = "pair long, turn long, role string, text string"
    got = preference.preference_records(preference.sides_of(spark.createDataFrame(said, schema), spark.createDataFrame(other, schema)))
    parts = sorted(got.collect(), key=lambda r: r.block)
    assert len(parts) == -(-n // block)
    whole = {c: "".join(r[c] for r in parts) for c in ("prompt", "chosen", "rejected")}
    text = lambda turns: "".join(f"<|{r}|>\n{x}<|end|>\n" for _, _, r, x in turns)
    assert whole == {"prompt": text(said[:300]), "chosen": text(said[300:]), "rejected": text(other[300:])}
    for side, turns in (("chosen", said), ("rejected", other)):
        spans = [tuple(map(int, x.split(":"))) for x in ",".join(r[f"{side}_learnt"] for r in parts if r[f"{side}_learnt"]).split(",")]
        assert [whole[side][a:b] for a, b in spans] == [f"{x}<|end|>\n" for _, t, r, x in turns if t >= 300 and r == "assistant"]


def test_stale_replies_from_another_block(spark, monkeypatch):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "old"), (1, 5, "user", "again"), (1, 6, "user", "and"), (1, 9, "assistant", "new"), (2, 0, "user", "only"), (2, 9, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = []
    for block in (256, 3):
        monkeypatch.setattr(preference, "BLOCK_TURNS", block)
        got.append(sorted((r.pair, r.part, r.turn, r.body) for r in preference.rendered_turns(preference.stale_reply_sides(df)).collect()))
    assert got[0] == got[1] and (1, "rejected", 9, "old<|end|>\n") in got[0] and (2, "rejected", 9, "only<|end|>\n") in got[0]


def test_preferences_of_two_tables(spark):
    a = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "x"), (1, 2, "user", "more"), (2, 0, "user", "q")], "pair_id long, turn long, role string, text string")
    b = spark.createDataFrame([(1, 0, "user", "q"), (2, 0, "user", "other"), (3, 0, "user", "q")], "pair_id long, turn long, role string, text string")
    got = sorted((r.pair, r.part, r.turn) for r in preference.format_preferences(preference.turns(a), preference.turns(b)).collect())
    assert got == [(1, "chosen", 1), (1, "chosen", 2), (1, "prompt", 0), (2, "chosen", 0), (2, "rejected", 0)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        assert 0 < after.count() and set(r.doc_id for r in after.collect()) <= set(r.doc_id for r in docs.collect())
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r.doc_id for r in last)


def test_pipeline_equals_plain_stages(spark, sf):
    """run() against the plain versions of all five stages, one after the other."""
    from tokenizers import Tokenizer

    from planlake.llm import tokens

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    order = [r.doc_id for r in labels.where(~toxicity.held_out(labels["doc_id"])).selectExpr("doc_id", "xxhash64(doc_id) AS place").orderBy("place").collect()]
    model = brute.ftrl([(sorted(brute.features(texts[i][0])), known[i]) for i in order if i in texts and i in known] * toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    left = [i for i, (t, _) in texts.items() if 1 / (1 + np.exp(-sum(model.get(f, 0.0) for f in brute.features(t)))) < toxicity.THRESHOLD]
    left.sort()
    words = [(texts[i][0] or "").lower().split() for i in left]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    roots = brute.classes(len(left), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    left = [left[k] for k in sorted(set(roots))]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    found = brute.leaked([(i, texts[i][0]) for i in left], items, decontam.GRAM, decontam.RARE_FACTOR, decontam.THRESHOLD, (decontam.MATCH, decontam.MISMATCH, decontam.GAP))
    left = [i for i in left if i not in {d for d, _ in found}]
    taken = brute.mixture([(i, *texts[i]) for i in left])
    t = Tokenizer.from_file(tokens.vocabulary_path())
    want = brute.token_digests([(i, texts[i][0]) for i in sorted(taken.elements())], lambda x: t.encode(x, add_special_tokens=False).ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted(want) and len(got) > 20


def test_pipeline_stages_on_odd_rows(spark, sf, odd, empty):
    """Nulls in every column, repeated rows, very long texts, clashing names and empty tables, through each stage and all of them."""
    named = odd.withColumnRenamed("bucket", "of_text").withColumnRenamed("size", "got").withColumn("toxicity", odd["lang"]).withColumn("n_taken", odd["doc_id"])
    for docs in (named, empty):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, sf)
            assert after.columns == docs.columns, name
            texts = {(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()}
            assert {(r.doc_id, r.text) for r in after.select("doc_id", "text").collect()} <= texts, name
            now = spark.createDataFrame([tuple(r) for r in after.collect()], docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert last.count() == now.count()


def test_scratch_tables_go_and_kept_ones_stay(spark):
    import os

    from planlake.llm.common import joinable, materialize, scratch

    place = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    with scratch(spark):
        with scratch(spark):
            gone, kept = materialize(spark.range(5), "gone"), materialize(spark.range(6), "kept", keep=True)
            paths = [place(gone), place(kept)]
            assert joinable(gone, "again").count() == 5 and all(map(os.path.exists, paths))
        assert [os.path.exists(p) for p in paths] == [False, True] and kept.count() == 6
    assert not os.path.exists(paths[1])
    outside = materialize(spark.range(7), "outside")
    assert outside.count() == 7 and os.path.exists(place(outside))


def share_found(spark, vectors):
    want, got = nearest(list(range(len(vectors))), vectors), {}
    for r in ann.op2_additive_quantisation(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(got[q] & {i for i, _ in want[q]}) / 5 for q in want])


def test_neighbours_in_tight_clusters(spark):
    """Cosines within a cluster differ by less than a float tells, and a cluster has more rows than are reranked at least."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(4, 32))[np.arange(4000) % 4] + 1e-4 * rng.normal(size=(4000, 32))
    assert share_found(spark, vectors) >= 0.95


def test_neighbours_of_queries_unlike_the_rows(spark, monkeypatch):
    """Rows in clusters, which a sample of rows says lie in one cell or two, and queries anywhere."""
    monkeypatch.setattr(ann, "QUERY_ROWS", 10)
    rng = np.random.default_rng(12)
    vectors = 4 * rng.normal(size=(16, 24))[rng.integers(0, 16, 5000)] + rng.normal(size=(5000, 24))
    vectors[::50] = rng.normal(size=(100, 24))
    assert share_found(spark, vectors) >= 0.95
