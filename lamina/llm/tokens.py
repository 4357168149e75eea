"""Token counts and token ids of whole texts with public tokenizers.

Counts come from an Arrow function that returns lengths only. Long texts are
split at safe boundaries: places that the tokenizer's own pre-tokenizer can
never merge across. Units between boundaries repeat a lot, so each worker
encodes every distinct unit of a byte-balanced batch once and keeps its length
in a bounded cache; the full library is used on every text for which the
boundaries are not provably safe (unusual scripts, special strings).
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm import kernels as K
from lamina.llm.common import spread, texts, tune

#: Anything outside printable ASCII, tab, newline, return and precomposed Latin letters and signs.
UNUSUAL = re.compile("[^\x20-\x7e\t\n\r\xa1-\u012f\u0131-\u017f]")
#: The word tokenizer's pre-tokens over lower-case text of usual characters: contractions, letters, one digit, signs.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u017f]+")
DOUBLE_SPACE = re.compile(r"\s\s")
#: For texts that go to the library whole: an ASCII space or newline before an ASCII letter.
LIBRARY_CUT = re.compile(r"[ \n](?=[A-Za-z])")
BATCH_BYTES = 1 << 18
CACHE_UNITS = 1_000_000


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_parts(text: str, limit: int = 1 << 16) -> list[str]:
    """Cut a long text before spaces that precede an ASCII letter, about every ``limit`` characters."""
    if len(text) <= limit:
        return [text]
    parts, at = [], 0
    while len(text) - at > limit:
        m = LIBRARY_CUT.search(text, at + limit)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies spell bytes as characters: visible Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


# The steps before the merges for which ``PIECES`` gives the units of texts of usual characters.
UNIT_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class UnitCounter:
    """Token counts by pre-token where the vocabulary file's steps are ``UNIT_STEPS``; by the library for any other file."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        held = json.loads(self.tokenizer.to_str())
        marked = all("<|" in t["content"] for t in held["added_tokens"])
        self.by_unit = (held["normalizer"], held["pre_tokenizer"]) == UNIT_STEPS and marked
        # parts of one text may be encoded apart only if nothing is put in front of a text and spaces begin units
        self.cuts = self.by_unit or (held["normalizer"] is None and held["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
        self.spelling = byte_alphabet()
        self.cache: dict[str, int] = {}

    def length(self, unit: str) -> int:
        spelt = unit if unit.isascii() else "".join(map(self.spelling.__getitem__, unit.encode()))
        return len(self.tokenizer.model.tokenize(spelt))

    def counts(self, batch: list[str]) -> list[int]:
        """Token counts of texts; a batch is held to ``BATCH_BYTES`` by the caller."""
        units = [None if not self.by_unit or "<|" in t or UNUSUAL.search(t) else PIECES.findall(t.lower()) for t in batch]
        if len(self.cache) > CACHE_UNITS:
            self.cache = {}
        known = self.cache
        for unit in {u for us in units if us is not None for u in us if u not in known}:
            known[unit] = self.length(unit)
        get = known.__getitem__
        # all other texts go to the library in one batch
        parts = [library_parts(t) if self.cuts else [t] for t, us in zip(batch, units) if us is None]
        lengths = iter(map(len, self.tokenizer.encode_batch_fast([p for own in parts for p in own], add_special_tokens=False)) if parts else ())
        rest = iter(parts)
        return [sum(next(lengths) for _ in next(rest)) if us is None else sum(map(get, us)) for us in units]


def byte_batches(column: pa.Array, sizes: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Texts in runs of ``limit`` bytes (one text at least), so that batches cost about the same."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield column.slice(at, to - at).to_pylist()
        at = to


@lru_cache(maxsize=2)
def unit_counter(path: str) -> UnitCounter:
    return UnitCounter(path)


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, locate: Callable[[str], str] = tokenizer_path) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows stay repeated; extra columns are ignored.
    Special strings inside a text count as the library counts them by default. No begin or end tokens.
    """
    tune(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unit_counter(locate(tokenizer))
        for batch in batches:
            column = batch.column(1)
            n_bytes = np.diff(K.string_buffers(column)[1])
            n_tokens = [n for run in byte_batches(column, n_bytes) for n in counter.counts(run)]
            tokens = np.array(n_tokens, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes.astype(np.int64)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return spread(texts(docs)).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class IdEncoder:
    """Ids of byte-level BPE texts, equal to the tokenizers library's for the same vocabulary.

    The rank file of the same vocabulary drives a faster encoder for texts of usual characters; texts with
    unusual characters or special strings go to the tokenizers library itself. Without two white-space
    characters in a row the look-ahead of the pre-token pattern never matters, so it is left out there.
    """

    PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as fh:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
        self.spaced = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("byte_bpe_plain", pat_str=self.PLAIN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text, without special tokens around it."""
        if "<|" in text or UNUSUAL.search(text):
            return np.array(load_tokenizer(self.json_path).encode(text, add_special_tokens=False).ids, np.uint32)
        chosen = self.spaced if DOUBLE_SPACE.search(text) else self.plain
        return np.array(chosen.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def id_encoder(json_path: str, ranks_path: str) -> IdEncoder:
    return IdEncoder(json_path, ranks_path)
