"""Cycles of any length, against strong connection by brute force."""
import random

from tessella.operators import graph


def keys(spark, pairs):
    return {tuple(r.cycle) for r in graph.circles(spark.createDataFrame(pairs, "src string, dst string")).collect()}


def test_long_rings_are_found(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 7}") for i in range(7)]
    chain = [("n3", "t0"), *((f"t{i}", f"t{i + 1}") for i in range(6)), ("t6", "m0"), *((f"m{i}", f"m{(i + 1) % 5}") for i in range(5))]
    got = keys(spark, [*ring, *chain, ("s", "n0"), ("a", "b"), ("b", "a"), ("d", "d"), (None, "a")])
    assert got == {tuple(f"n{i}" for i in range(7)), tuple(f"m{i}" for i in range(5)), ("a", "b"), ("d",)}


def test_every_node_of_a_cycle_is_covered(spark):
    rng = random.Random(5)
    pairs = [(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(20)]
    reach = {a: {b for x, b in pairs if x == a} for a in map(str, range(14))}
    for _ in range(14):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    got = keys(spark, pairs)
    assert {n for c in got for n in c} == {a for a, r in reach.items() if a in r}
    assert all((a, b) in pairs for c in got for a, b in zip(c, [*c[1:], c[0]]))
