"""Leaks against all runs of words; no fingerprint within the radius may be lost."""
import random
from collections import Counter

import numpy as np

from tessella.llm import leakage as L


def brute(docs, items, n=12):
    runs = {}
    for i, t in items:
        w = L.words_of(t)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [L.words_of(t)] for k in range(len(w) - n + 1) for i in runs.get(tuple(w[k : k + n]), ())}


def test_against_brute_force(spark):
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(rnd.randint(5, 60)))) for i in range(20)] + [(50, None), (51, "")]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rnd.randint(0, 200))]
        if d % 3 == 0:
            w = items[rnd.randrange(20)][1].split()
            a = rnd.randrange(max(1, len(w) - 11))
            text[5:5] = w[a : a + rnd.choice([11, 12, 20])]
        docs.append((d, rnd.choice([" ", "_", "-\n"]).join(text).upper() if d % 2 else " ".join(text)))
    docs += [(200, None), (201, ""), (202, items[0][1] * 30), (202, items[0][1] * 30), (203, "x" * 100_000)]
    shape = "doc_id long, text string, windows string, item_id string"
    found = L.leaks(spark.createDataFrame([(*d, "c", "c") for d in docs], shape), spark.createDataFrame(items, "item_id long, text string")).collect()
    exact = [(r.doc_id, r.item_id) for r in found if r.windows]
    assert set(exact) == brute(docs, items) and len(exact) == len(brute(docs, items))
    parts = L.leaks(spark.createDataFrame([(*d, "c", "c") for d in docs], shape), spark.createDataFrame(items, "item_id long, text string"), most=100)
    assert sorted(parts.collect()) == sorted(found)


def test_weighted_similarity_against_counters():
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randint(0, 5)}" for _ in range(rnd.randint(12, 30))) for _ in range(40)]
    index = L.ItemIndex(list(enumerate(texts)))
    words = L._Hashes().of([w for t in texts[::-1] for w in t.split()])
    starts = np.array([rnd.randrange(len(words) - 11) for _ in range(300)])
    hits = np.array([rnd.randrange(len(index.start)) for _ in range(300)])
    got = index.similarity(words, starts, hits)
    for k in range(300):
        a, b = (Counter(L.shingle_hashes(x).tolist()) for x in (words[starts[k] : starts[k] + 12], index.words[index.start[hits[k]] : index.start[hits[k]] + 12]))
        weigh = lambda c: sum(int(index.weights(np.array([s], np.uint64))[0]) * n for s, n in c.items())
        assert abs(got[k] - weigh(a & b) / weigh(a | b)) < 1e-9


def test_near_windows_are_counted_apart(spark):
    rnd = random.Random(5)
    item = [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]
    near = [w for w in item]
    near[30] = "other"
    docs = spark.createDataFrame([(1, " ".join(near[25:36])), (2, "a b c d e f g h i j k l m"), (3, " ".join(item[:12]))], "doc_id long, text string")
    got = {r.doc_id: (r.windows, r.near) for r in L.leaks(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string"), similarity=0.1).collect()}
    assert got.get(3, (0, 0))[0] == 1 and 2 not in got and got.get(1, (0, 0))[0] == 0


def test_multi_index_loses_nothing_within_the_radius():
    rnd = np.random.default_rng(1)
    index = L.ItemIndex([(1, " ".join(f"x{i}" for i in range(400)))])
    base = index.prints
    flips = np.zeros(len(base), np.uint64)
    for _ in range(L.RADIUS):
        flips ^= np.uint64(1) << rnd.integers(0, 64, len(base)).astype(np.uint64)
    at, hit = index.candidates(base ^ flips)
    assert set(range(len(base))) <= set(at[hit == at].tolist())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert L.leaks(docs, items).count() == 0
    assert L.leaks(spark.createDataFrame([(1, "a " * 50)], "doc_id long, text string"), items).count() == 0
