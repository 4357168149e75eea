"""Chains and cycles deeper than 64 nodes, which a fixed depth used to lose."""

from lamina.operators import layers

DEEP = 300


def chain(spark):
    return spark.createDataFrame([(i, i - 1 if i else None, "root" if i == 0 else None) for i in range(DEEP)], "k long, p long, v string")


def test_value_of_a_far_ancestor(spark):
    got = {r["k"]: (r["v"], r["depth"]) for r in layers.resolve_chain(chain(spark), "k", "p", "v").collect()}
    assert got == {i: ("root", i) for i in range(DEEP)}


def test_cycle_and_dangling_parent_without_a_value(spark):
    rows = [(i, (i + 1) % 100, None) for i in range(100)] + [(200, 0, None), (300, 999, None), (400, 400, "own"), (None, 400, None)]
    got = {r["k"]: (r["v"], r["depth"]) for r in layers.resolve_chain(spark.createDataFrame(rows, "k long, p long, v string"), "k", "p", "v").collect()}
    assert got == {i: (None, None) for i in [*range(100), 200, 300]} | {400: ("own", 0), None: ("own", 1)}


def test_entries_of_a_far_ancestor(spark):
    entries = spark.createDataFrame([(0, "x", "far"), (0, "y", "far"), (150, "y", "near")], "k long, n string, e string")
    got = {(r["k"], r["n"]): (r["e"], r["depth"]) for r in layers.fold_entries(chain(spark), "k", "p", entries, "n", "e").collect()}
    near = {(i, "y"): ("near", i - 150) if i >= 150 else ("far", i) for i in range(DEEP)}
    assert got == near | {(i, "x"): ("far", i) for i in range(DEEP)}


def test_long_cycle_with_a_tail(spark):
    rows = [(i, (i + 1) % 100) for i in range(100)] + [(100 + i, 99 + i if i else 5) for i in range(90)] + [(500, 500), (600, 601), (601, None), (700, 999)]
    got = {r["k"]: (r["steps"], r["cyclic"]) for r in layers.flag_cycles(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    want = {i: (100, True) for i in range(100)} | {100 + i: (101 + i, True) for i in range(90)}
    assert got == want | {500: (1, True), 600: (1, False), 601: (0, False), 700: (0, False)}
