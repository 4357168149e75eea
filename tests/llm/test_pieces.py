"""Sampled segmentations of texts longer than one former window of 512 characters."""

import itertools
import math
import random
from collections import Counter

import pytest

pytest.importorskip("lamina.llm.common")

#: "a", "b" and "ab" with scores far apart, so that long texts still have few likely paths.
VOCABULARY = {"a": (1, -3.0), "b": (2, -5.0), "ab": (3, -1.0), "c": (4, -1.0)}


def search(text, count, seed, theta=1.0):
    """``count + 1`` paths at most: ids, log-probability, perturbed value."""
    from lamina.llm.pieces import Lattice, Trie

    lattice = Lattice(Trie(VOCABULARY, theta), theta)
    (found,) = lattice.draw([lattice.split(text)], [seed], count + 1)
    return [(tuple(lattice.spell(ids, [0] * 256).tolist()), logp, top) for _, logp, top, ids in found.paths]


def every_path(text, pieces, theta):
    """All segmentations of a short text with their weights, by full enumeration."""
    if not text:
        return [((), 0.0)]
    sizes = [n for n in range(1, len(text) + 1) if text[:n] in pieces]
    heads = [((pieces[text[:n]][0],), -theta * math.log2(2.0 - pieces[text[:n]][1]), n) for n in sizes]
    if 1 not in sizes:
        heads.append((tuple(1000 + b for b in text[0].encode()), min(-1.0, theta * -40.0), 1))
    return [(ids + rest, w + more) for ids, w, n in heads for rest, more in every_path(text[n:], pieces, theta)]


@pytest.mark.parametrize("text", ["abab", "a\u00e9ab", "abcabab", "\u2581ab\u2581ca\u2581\u2581b", "b"])
def test_all_paths_of_short_texts(text):
    pieces = VOCABULARY | {"\u2581": (5, -2.0), "\u2581a": (6, -2.5), "\u2581ab": (7, -9.0), "\u2581\u2581": (8, -4.0), "ca": (9, -7.0)}
    from lamina.llm.pieces import Lattice, Trie

    lattice = Lattice(Trie(pieces, 0.7), 0.7)
    (found,) = lattice.draw([lattice.split(text)], [5], 1000)
    wanted = every_path(text, pieces, 0.7)
    whole = math.log(sum(math.exp(w) for _, w in wanted))
    got = {tuple(lattice.spell(ids, list(range(1000, 1256))).tolist()): p for _, p, _, ids in found.paths}
    assert len(got) == len(found.paths) == len(wanted) and found.threshold() == -math.inf
    assert all(math.isclose(got[ids], w - whole, abs_tol=1e-9) for ids, w in wanted)


def test_ranks_of_a_long_text_combine_freely():
    # two ambiguous places, 1,200 characters apart: four paths in all, each of which must come out
    text = "ab" + "c" * 1200 + "ab"
    found = search(text, 4, 3)
    assert len({ids for ids, _, _ in found}) == len(found) == 4
    assert math.isclose(sum(math.exp(logp) for _, logp, _ in found), 1.0)
    tops = [top for _, _, top in found]
    assert tops == sorted(tops, reverse=True)


def test_draws_follow_the_whole_texts_distribution():
    text = "ab" + "c" * 600 + "ab"
    probability = {ids: math.exp(logp) for ids, logp, _ in search(text, 4, 0)}
    draws = 1000
    pairs = Counter(tuple(ids for ids, _, _ in search(text, 1, seed)) for seed in range(draws))
    for one, two in itertools.permutations(probability, 2):
        expected = probability[one] * probability[two] / (1 - probability[one])
        assert abs(pairs[one, two] / draws - expected) < 5 * math.sqrt(expected / draws) + 2 / draws


def test_long_texts_are_sampled_whole():
    from lamina.llm.pieces import load, sample
    from lamina.llm.tokens import tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    text = "several plain words of an ordinary sentence " * 60
    found = sample(text, 11, 3, path)
    assert len({tuple(ids) for ids, _, _ in found}) == 3
    assert all(load(path)[0].decode(ids).strip() == text.strip() for ids, _, _ in found)
    assert all(0 <= share <= 1 for _, _, share in found)
    assert sample("", 1, 2, path) == [([], 0.0, 1.0)]


def test_encode_keeps_every_row(spark):
    from lamina.llm.pieces import encode, load
    from lamina.llm.tokens import tokenizer_path

    model = load(tokenizer_path("piece_bpe_32k.model"))[0]
    rows = [(1, "Some plain text\nwith \u4e2d\u6587 and <s>", "x"), (1, "Some plain text\nwith \u4e2d\u6587 and <s>", "x"), (2, None, "x"), (3, "", None), (None, "no key here", "x"), (4, "long " * 5000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [r.asDict() for r in encode(frame).collect()]
    best = sorted((r["doc_id"] or -1, r["ids"]) for r in got if r["rank"] == 0)
    assert best == sorted((k or -1, model.encode(t or "")) for k, t, _ in rows)
    for r in got:
        assert model.decode(r["ids"]) == r["decoded"] and 0 < r["inclusion"] <= 1 or r["doc_id"] == 4
    assert sum(r["rank"] == 2 for r in got) == 4 and len(got) == 3 * 4 + 2 * 2
    assert encode(frame.limit(0)).count() == 0


def test_texts_are_encoded_by_their_words():
    from lamina.llm.pieces import MARK, lattice_of, load
    from lamina.llm.tokens import tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    processor, lattice = load(path)[0], lattice_of(path, 0.1)
    parts = ["word", "Word,", " ", "  ", "\n", "\n\n", "\t", ".", "!?", "中文", "\U0001f600", "é", "<s>", "</s>", "<0x0A>", "12.5", "-", " ", "\x00", "_", "x" * 90, "", "\r\n"]
    chosen = random.Random(3)
    texts = [a + b + c for a, b, c in itertools.product(parts[:12], repeat=3)] + ["".join(chosen.choices(parts, k=chosen.randrange(40))) for _ in range(2000)]
    numbers = lattice.number([lattice.split(processor.normalize(t)) for t in texts])
    assert lattice.library.holds and not any(MARK in t for t in texts)
    for text, ids in zip(texts, lattice.encoded(numbers)):
        assert ids.tolist() == processor.encode(text), text


def test_sets_behind_a_paths_first_steps(monkeypatch):
    from lamina.llm import pieces

    text = "ab" * 5 + "c" * 300 + "ab" * 200
    found = {}
    for reach in (1, 64, 10**6):
        monkeypatch.setattr(pieces, "REACH", reach)
        found[reach] = [search(text, 20, seed) for seed in range(20)]
    assert found[1] == found[64] == found[10**6]
