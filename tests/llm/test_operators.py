"""The corpus operators against brute-force versions on a small fixture with nulls, empties, ties and repeats."""

import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("lamina.llm.common")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"
rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(3000)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


PASSAGE = prose(60)
LONG = prose(300)
TEXTS = [
    LONG, LONG, LONG + " extra tail words", "", None, "   ", "one two", "one two", prose(50) + " " + PASSAGE + " " + prose(30),
    prose(40) + " " + PASSAGE, "Released under the MIT License. Also CC-BY and mit LICENSE", "GNU General Public License; apache license",
    "permission is hereby granted, free of charge, to any one person obtaining a copy of this software", "line\nline\nother $ # x", ("a b c d e " * 10).strip(), prose(12),
]
ROWS = [(i, t, "en", "s", len(t or ""), "k", i) for i, t in enumerate(TEXTS)]
ROWS += [(None, "null key row with a few words", None, None, None, None, None), ROWS[9]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_token_counts(docs):
    from tokenizers import Tokenizer

    from lamina.llm.tokens import token_counts, tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_bytes"]) for r in rows(token_counts(docs)))
    want = sorted((-1 if r[0] is None else r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids), len((r[1] or "").encode())) for r in ROWS)
    assert got == want


def test_token_counts_of_any_vocabulary(spark):
    from tokenizers import Tokenizer

    from lamina.llm.tokens import token_counts, tokenizer_path

    signs = ["a", "B", "7", " ", "\n", "\u00e9", "\u4e2d", "'s", "<|endoftext|>", "\u0130", "e\u0301", "!?", "  ", "word ", "\U0001f600"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(400)] + ["some plain words " * 9000, "\u4e2d" * 70000, "<|endoftext|>" * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = Tokenizer.from_file(tokenizer_path(name))
        got = {r["doc_id"]: (r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in token_counts(frame, name).collect()}
        for i, text in enumerate(texts):
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert got[i] == (n, len(text.encode()), n > 2048), (name, text[:50])


def test_license_base(docs):
    from lamina.llm.licenses import BASE_PHRASES, WORD, scan

    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows(scan(docs)))
    want = []
    for doc_id, text, *_ in ROWS:
        words = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        hits = [(i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in hits]
        want.append((-1 if doc_id is None else doc_id, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want, key=lambda r: r[:1])


def test_license_notice_with_words_put_in(docs):
    from lamina.llm.licenses import scan

    found = {r["doc_id"]: r for r in rows(scan(docs))}
    assert found[12]["labels"] == "mit-grant" and 0.6 <= found[12]["score"] < 1
    assert found[0]["labels"] == "" and found[0]["score"] == 0


def test_passages_found_and_cut(docs):
    from lamina.llm.substrings import cut_repeats, passages

    found = {(r["doc_id"], r["first_doc_id"]) for r in rows(passages(docs))}
    assert {(1, 0), (2, 0), (9, 8)} <= found
    assert not {d for d, _ in found} - {1, 2, 9, 14}
    for r in rows(passages(docs)):
        raw = (TEXTS[r["doc_id"]]).encode()
        assert raw[r["start"] : r["start"] + r["length"]].decode() == r["passage"]
    cut = {r["doc_id"]: r["text"] for r in rows(cut_repeats(docs))}
    assert cut[1] == "" and cut[0] == LONG and cut[4] is None and cut[15] == TEXTS[15]
    assert len(PASSAGE) * 0.5 < len(TEXTS[9]) - len(cut[9]) <= len(PASSAGE) + 1
    assert cut_repeats(docs).columns == docs.columns and cut_repeats(docs).count() == len(ROWS)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    from lamina.llm.packing import pack
    from lamina.llm.tokens import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in ROWS}
    pieces, sequences, seen = rows(pack(docs)), {}, Counter()
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == p["ids_crc32"]
        seen[p["doc_id"]] += p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    copies = Counter(r[0] for r in ROWS)
    assert seen == {k: len(ids[k]) * n for k, n in copies.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_near_duplicates(docs):
    from lamina.llm.neardup import near_duplicates

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()

    sets = {r[0]: shingles(r[1]) for r in ROWS if r[0] is not None}
    component = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    component[i] = component[j] = min(component[i], component[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(near_duplicates(docs, k=4)) if r["doc_id"] is not None}
    assert got == {i: (len(s), component[i], component[i] == i) for i, s in sets.items()}


def test_rules_base(docs, spark):
    from lamina.llm.rules import judge

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(judge(docs, labels))}
    for doc_id, text, *_ in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_fingerprints(docs):
    from lamina.llm.fingerprint import against_next

    got = rows(against_next(docs))
    assert len(got) == len(ROWS)
    by_text = {}
    for r in got:
        text = "null key row with a few words" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["n_chars"] == len(text)
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_html():
    from lamina.llm.markup import render

    assert render("<p>One<p>Two <b>b</b>t<script>x<y</script><div hidden>no</div>") == "One\n\nTwo bt"
    assert render("<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>long<td>z</table>") == "- a\n- b\nx     y\nlong  z"
    assert render("") == "" and render("<p") == "<p" and render("a<!-- b") == "a"


def test_sampled_segmentations():
    from lamina.llm.pieces import load, sample
    from lamina.llm.tokens import tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    found = sample("hello wide world", 7, 5, path)
    assert len({tuple(ids) for ids, _, _ in found}) == 5
    assert found == sample("hello wide world", 7, 5, path)
    assert all(load(path)[0].decode(ids) == "hello wide world" and 0 < share <= 1 for ids, _, share in found)


@pytest.mark.parametrize("name", ["tokens", "licenses", "passages", "cut", "pack", "near", "next"])
def test_empty_table(spark, name):
    from lamina.llm import fingerprint, licenses, neardup, packing, substrings, tokens

    empty = spark.createDataFrame([], SCHEMA)
    call = {"tokens": tokens.token_counts, "licenses": licenses.scan, "passages": substrings.passages, "cut": substrings.cut_repeats, "pack": packing.pack, "near": neardup.near_duplicates, "next": fingerprint.against_next}[name]
    assert call(empty).count() == 0
