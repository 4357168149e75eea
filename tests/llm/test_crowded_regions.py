"""Near-dedup where many different texts share long signature prefixes: crowded regions against brute force."""

import random

import pytest

from lamina.llm import neardup
from lamina.llm.components import components, extend


def shingles(text, k):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets, parent = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def crowded_rows(seed):
    """Families of texts over one shared passage: pairs inside a family reach 0.8 or narrowly miss it."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for family in range(60):
        own = [f"f{family}x{i}" for i in range(50)]
        for member in range(4):
            tail = list(own)
            for _ in range(rng.choice((0, 1, 2, 6))):
                tail[rng.randrange(len(tail))] = f"m{family}y{member}z{rng.random()}"
            rows.append((len(rows), " ".join(passage + tail)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_beyond_the_reach_are_found(spark, monkeypatch, seed):
    rows = crowded_rows(seed)
    seen = []
    monkeypatch.setattr(neardup, "deeper", lambda *a, f=neardup.deeper: seen.append(1) or f(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4, 80, reach=8).collect()}
    assert seen
    assert got == brute(rows, 4, 80)


def test_long_runs_give_the_same_at_any_reach(spark):
    rows = crowded_rows(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = brute(rows, 4, 80)
    for reach in (1, 512):
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4, 80, reach=reach).collect()} == wanted


def test_extended_components_equal_those_of_the_whole_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    early, late = (spark.createDataFrame(x, "a long, b long") for x in (edges[:25], edges[25:]))
    labels = lambda df: sorted((r.v, r.c) for r in df.collect())
    assert labels(extend(components(early), late)) == labels(components(early.union(late)))
