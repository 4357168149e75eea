"""Repeated passages: each is one earlier place's, and texts without ASCII spaces have them too."""

import random

import pytest

pytest.importorskip("lamina.llm.common")

SCHEMA = "doc_id long, text string"


def found(spark, texts):
    from lamina.llm.substrings import passages

    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    return sorted((r["doc_id"], r["first_doc_id"], r["start"], r["passage"]) for r in passages(docs).collect())


def test_chance_repeats_of_short_phrases_are_no_passage(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(150)]
    seen = set()
    for text in texts:  # no 100 bytes repeat
        grams = {text[i : i + 100] for i in range(len(text) - 99)}
        assert not grams & seen
        seen |= grams
    assert found(spark, texts) == []
    copied = found(spark, [*texts, texts[7][:900] + " " + texts[3][200:1000]])
    assert {(d, f) for d, f, _, _ in copied} <= {(150, 3), (150, 7)} and sum(len(p) for *_, p in copied) > 1400


def test_passage_is_covered_to_its_last_chunk():
    import numpy as np

    from lamina.llm.substrings import windows

    ends = np.array([200, 210, 250, 270, 500, 560])
    starts, rows = np.array([0, 200, 210, 250, 270, 500]), np.array([0, 0, 0, 0, 1, 1])
    first, last = windows(starts, ends, rows, 100)
    assert sorted(zip(first.tolist(), last.tolist())) == [(0, 0), (0, 1), (0, 2), (0, 3), (4, 4), (4, 5)]


def test_texts_without_ascii_spaces_share_passages(spark):
    rng = random.Random(8)

    def signs(n):
        return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))

    shared, encoded = signs(200), "".join(rng.choice("ABCDEFGHabcdefgh0123") for _ in range(600))
    wide = "\u3000".join(signs(4) for _ in range(50))
    texts = [signs(90) + shared + signs(40), signs(55) + shared + signs(70), "A" + encoded + "B" * 50, "C" * 45 + encoded + "D" * 9, wide + signs(30), signs(60) + wide]
    got = found(spark, texts)
    for doc, first, part in ((1, 0, shared), (3, 2, encoded), (5, 4, wide)):
        hits = [p for d, f, _, p in got if (d, f) == (doc, first)]
        assert hits and all(p in part or part in p or p in texts[first] for p in hits)
        assert sum(map(len, hits)) > 0.6 * len(part)


def test_no_chunk_is_longer_than_the_longest():
    import numpy as np

    from lamina.llm.substrings import LONGEST, borders

    text = ("\u4e00" * 3000 + "z" * 3000).encode()
    data = np.frombuffer(text + text, np.uint8)
    starts = borders(data, np.array([0, len(text), 2 * len(text)]))
    assert np.diff(np.append(starts, len(data))).max() <= LONGEST + 3 and len(text) in starts
    assert all(data[starts] & 0xC0 != 0x80)
