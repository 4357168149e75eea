"""SentencePiece encoding, decoding and sampling without replacement.

The best segmentation and decoding are the library's; merges stay inside words, so it is asked for each distinct
word once, unless the model or a text rules that out (see ``Library``). Sampled segmentations come
from the lattice of all vocabulary pieces of the whole text: each complete path has
the log-probability of its scaled piece scores. No piece has a word mark after
another character, so no path crosses into a word in the middle of a piece, and the
lattice is a chain of words; runs of punctuation are words, too, where no piece holds it together with others; edges and backward masses are computed once for each
distinct word, many words at a time.

Top-k sampling without replacement is an A-star search over sets of paths whose
perturbed maximum is known. The best path of a set is drawn step by step by the
backward masses and takes over the set's maximum. The rest of the set falls apart by
the step at which a path leaves the drawn one; the maximum of each part is a Gumbel
value of the part's mass, truncated at the set's. The part with the largest goes on.
So the first k emitted are k distinct segmentations, and the best part left is the
threshold that gives each its inclusion score. All random numbers are hashes of the
row key and the place where they are used.
"""

from __future__ import annotations

import heapq
import math
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm import kernels as K
from lamina.llm.common import spread, texts, tune
from lamina.llm.tokens import tokenizer_path

TEMPERATURE = 0.1
MARK = "▁"
#: Steps of a path from which the sets that leave it are looked at first, and the most that a step's noise can be.
REACH, MOST_NOISE = 64, 37.0
#: Edges that a worker keeps; beyond, it begins anew (about 220 MB).
CACHE_EDGES = 9_000_000
#: Characters from a word's end up to which places of all words are worked on at once.
TOGETHER = 64
_MANY = K.stream(71, 8)


@lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return model, {model.id_to_piece(i): (i, model.get_score(i)) for i in usable}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


class Trie:
    """Pieces by their characters, in arrays: one step moves many places on at once."""

    def __init__(self, vocabulary: dict[str, tuple[int, float]], theta: float):
        moves: dict[tuple[int, int], int] = {}
        number, weight = [-1], [0.0]
        for piece, (own, score) in vocabulary.items():
            node = 0
            for c in map(ord, piece):
                node = moves.setdefault((node, c), len(number))
                if node == len(number):
                    number.append(-1)
                    weight.append(0.0)
            # BPE scores are merge ranks; their logarithm keeps rare pieces comparable
            number[node], weight[node] = own, -theta * math.log2(2.0 - score)
        self.number, self.weight = np.array(number, np.int64), np.array(weight)
        self.grows = np.zeros(len(number), bool)
        self.grows[[n for n, _ in moves]] = True
        self.longest = max(map(len, vocabulary), default=1)
        self.crossing = any(MARK in piece.lstrip(MARK) for piece in vocabulary)
        # neither letters, marks nor decimal digits, and in no piece together with those (higher planes slow expressions down)
        lone = {c for c in set(string.punctuation).union("\t\n\r", *vocabulary) if c < "\U00010000" and unicodedata.category(c)[0] not in "LM" and unicodedata.category(c) != "Nd"} - {MARK}
        longer = [set(piece) for piece in vocabulary if len(piece) > 1]
        while mixed_ := [held for held in longer if held & lone and held - lone - {MARK}]:
            lone -= set().union(*mixed_)
        self.lone, self.alone = "".join(sorted(lone)), lone.difference(*longer)
        # a run of marks and the characters up to the next mark, either all lone or none
        own = re.escape(self.lone)
        self.unit = re.compile(f"{MARK}*[^{MARK}{own}]+|{MARK}*[{own}]+|{MARK}+" if own else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.root = np.full(1 << 16, -1, np.int64)
        for (node, c), to in moves.items():
            if not node and c < len(self.root):
                self.root[c] = to
        size = 1 << (2 * len(moves) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        keys = np.array([n << 21 | c for n, c in moves], np.int64)
        self.keys, self.to = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        to = np.fromiter(moves.values(), np.int64, len(moves))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]], self.to[at[free]] = keys[free], to[free]  # of several the last one stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64) & self.mask

    def start(self, chars: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to from the root."""
        node = self.root[np.minimum(chars, len(self.root) - 1)]
        far = np.flatnonzero(chars >= len(self.root) - 1)
        if len(far):
            node[far] = self.step(np.zeros(len(far), np.int64), chars[far])
        return node

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to, -1 where none does."""
        keys = nodes << 21 | chars
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.to[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.to[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class Library:
    """The library's encoding of words, where that of a text is those of its words in a row.

    That is so for merges by rank with bytes for unknown characters, if no piece crosses words. Many words are encoded as
    one text, each behind a line end, which no merge passes; the characters that each id stands for tell which ids are a
    word's. ``holds`` turns false at the first words that do not normalise to themselves; whole texts are then encoded,
    as are texts that bring marks of their own.
    """

    def __init__(self, processor, trie: Trie, vocabulary: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.processor, self.byte_ids = processor, np.array(byte_ids)
        ranked = processor.is_byte(byte_ids[0]) and all(score == int(score) for _, score in vocabulary.values())
        self.holds = ranked and not trie.crossing and "\n" in trie.alone
        self.sizes = np.zeros(processor.get_piece_size(), np.int64)
        self.sizes[[own for own, _ in vocabulary.values()]] = list(map(len, vocabulary))
        self.sizes[byte_ids] = [int(b & 0xC0 != 0x80) for b in range(256)]  # a character's first byte stands for it

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """``-1 - character`` as the id of its byte, where it has one byte."""
        return np.where((ids < 0) & (ids >= -128), self.byte_ids[np.clip(-1 - ids, 0, 127)], ids)

    def encode(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some words (of ``sizes`` characters) with others between them, and where each word's begin and end."""
        ends = np.cumsum(sizes + 1) + 1  # a mark comes before the first line end
        if self.holds:
            spelt = "\n" + "\n".join(units)
            plain = spelt.replace(MARK, " ")
            ids = self.processor.encode(plain, return_type="numpy")
            reach = np.cumsum(self.sizes[ids])
            self.holds = self.processor.normalize(plain) == MARK + spelt and int(reach[-1]) == int(ends[-1])
        if not self.holds:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        return ids, np.searchsorted(reach, ends - sizes, "right"), np.searchsorted(reach, ends, "right")


class Lattice:
    """Edges of distinct words with their probabilities, given that the edge's first place is reached.

    ``first[p]`` is the first edge of place ``p``; an edge has the place it leads to (-1: the word's end), its
    log-probability, the cumulated probability of its place's edges so far, and its id (``-1 - character`` where the
    character has no piece and is its bytes; a single byte's own id if the library is known).
    """

    def __init__(self, trie: Trie, theta: float, library: Library | None = None):
        self.trie, self.theta, self.library = trie, theta, library
        self._room()
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.n_places = self.n_edges = self.n_best = 0

    def _room(self) -> None:
        """Arrays for as many edges as are kept; memory is taken only where it is written."""
        self.first, self.to, self.ids, self.begin, self.best, self.best_begin, self.best_size = (np.empty(CACHE_EDGES // k, np.int32) for k in (2, 1, 1, 8, 4, 8, 8))
        self.logq, self.cum = np.empty(CACHE_EDGES), np.empty(CACHE_EDGES)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):  # memory is taken where it is written, so half as much again costs nothing yet
            grown = np.empty((at + len(values)) * 3 // 2, held.dtype)
            grown[:at] = held[:at]
            held = grown
            setattr(self, name, held)
        held[at : at + len(values)] = values

    def split(self, text: str) -> list[str]:
        """The words of a normalised text; the whole text if a piece of the model could cross them."""
        return self.trie.unit.findall(text) if not self.trie.crossing else [text] if text else []

    def number(self, words: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's words, which hold up to the next call."""
        if self.n_edges > CACHE_EDGES:
            self.clear()
        known, every = self.units, list(chain.from_iterable(words))
        flat = np.fromiter(map(known.get, every, repeat(-1)), np.int64, len(every))
        late = np.flatnonzero(flat < 0).tolist()
        new = list(dict.fromkeys(every[i] for i in late))
        for i in range(0, len(new), 20_000):
            self.add(new[i : i + 20_000])
        flat[late] = [known[every[i]] for i in late]
        ends = np.cumsum([0, *map(len, words)]).tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encoded(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """The library's ids of texts, from those of their words."""
        flat = np.concatenate(numbers)
        sizes = self.best_size[flat].astype(np.int64)
        behind = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.best[np.repeat(self.best_begin[flat] - behind[:-1], sizes) + np.arange(behind[-1])]
        ends = behind[np.cumsum([0, *map(len, numbers)])].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def add(self, units: list[str]) -> None:
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        n, ends = len(chars), np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)  # characters up to the word's end
        at, node, found = np.arange(n), self.trie.start(chars), []
        for size in range(1, self.trie.longest + 1):
            if size > 1:
                node = self.trie.step(node, chars[at + size - 1])
            on = np.flatnonzero(node >= 0)
            at, node = at[on], node[on]
            piece = np.flatnonzero(self.trie.number[node] >= 0)
            ending = node[piece]
            found.append((at[piece], np.full(len(piece), size), self.trie.number[ending], self.trie.weight[ending]))
            on = np.flatnonzero((left[at] > size) & self.trie.grows[node])
            if not len(on):
                break
            at, node = at[on], node[on]
        whole = np.ones(n, bool)
        if found:
            whole[found[0][0][found[0][1] == 1]] = False
        bare = np.flatnonzero(whole)
        found.append((bare, np.ones(len(bare), np.int64), -1 - chars[bare], np.full(len(bare), min(-1.0, self.theta * -40.0))))
        origin, size, ids, weight = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(origin, kind="stable")
        origin, size, ids, weight = origin[order], size[order], ids[order], weight[order]
        counts = np.bincount(origin, minlength=n)
        first = np.cumsum(counts) - counts
        # backward masses, for all places equally far from their word's end at once
        mass = np.zeros(n + 1)
        near = np.argsort(left, kind="stable")
        together = int(np.searchsorted(left[near], TOGETHER, "right"))
        cuts = np.flatnonzero(np.diff(left[near[:together]], prepend=0))
        for a, b in zip(cuts, [*cuts[1:], together]):
            here = near[a:b]
            own = counts[here]
            begin = np.cumsum(own) - own
            edge = np.repeat(first[here] - begin, own) + np.arange(int(own.sum()))
            ahead = np.where(size[edge] < left[origin[edge]], mass[origin[edge] + size[edge]], 0.0)
            value = weight[edge] + ahead
            top = np.maximum.reduceat(value, begin)
            mass[here] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, own)), begin))
        for p in near[together:].tolist():  # far from a word's end there are few places, one by one
            values = [w + mass[p + k] if k < left[p] else w for k, w in zip(size[first[p] : first[p] + counts[p]].tolist(), weight[first[p] : first[p] + counts[p]].tolist())]
            top = max(values)
            mass[p] = top + math.log(sum(math.exp(v - top) for v in values)) if len(values) > 1 else top
        inner = size < left[origin]
        logq = np.minimum(weight + np.where(inner, mass[np.minimum(origin + size, n)], 0.0) - mass[origin], 0.0)
        total = np.cumsum(np.exp(logq))
        cum = total - np.repeat(np.concatenate(([0.0], total))[first], counts)
        cum[first + counts - 1] = np.inf
        for name, start, values in (
            ("first", self.n_places, np.append(first, len(origin)) + self.n_edges), ("to", self.n_edges, np.where(inner, origin + size + self.n_places, -1)),
            ("logq", self.n_edges, logq), ("cum", self.n_edges, cum), ("ids", self.n_edges, self.library.bytes_of(ids) if self.library else ids),
        ):
            self._put(name, start, values)
        known = len(self.units)
        self._put("begin", known, ends - sizes + self.n_places)
        if self.library:
            best, begin, end = self.library.encode(units, sizes)
            self._put("best", self.n_best, best)
            self._put("best_begin", known, begin + self.n_best)
            self._put("best_size", known, end - begin)
            self.n_best += len(best)
        self.units.update(zip(units, range(known, known + len(units))))
        self.n_places, self.n_edges = self.n_places + n, self.n_edges + len(origin)

    def walk(self, starts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A drawn path from each place to its word's end: all edges in a row, and how many each has."""
        taken, steps, place, step = [], np.zeros(len(starts), np.int64), starts, 0
        who = np.arange(len(starts))
        while len(who):
            r = uniform(seeds[who], step)
            edge = self.first[place].astype(np.int64)
            todo = np.flatnonzero(self.cum[edge] <= r)
            while len(todo):
                edge[todo] += 1
                todo = todo[self.cum[edge[todo]] <= r[todo]]
            taken.append((who, edge))
            steps[who] += 1
            place = self.to[edge]
            who, place, step = who[place >= 0], place[place >= 0], step + 1
        out, begin = np.empty(int(steps.sum()), np.int64), np.cumsum(steps) - steps
        for step, (who, edge) in enumerate(taken):
            out[begin[who] + step] = edge
        return out, steps

    def draw(self, words: list[list[str]], keys: list[int], count: int) -> list[Search]:
        """Searches with up to ``count`` paths of each text (its words), by falling perturbed value."""
        return self.search(self.number(words), keys, count)

    def search(self, numbers: list[np.ndarray], keys: list[int], count: int) -> list[Search]:
        """The same for texts given by their words' numbers. Every step works on all texts at once."""
        seeds = K.splitmix(np.array([k & (2**64 - 1) for k in keys], np.uint64))
        values = gumbel(uniform(mixed(seeds, 2, np.zeros(len(seeds), np.int64)), 0)).tolist()
        searches = [Search(self, self.begin[n].astype(np.int64), s, v) for n, s, v in zip(numbers, seeds, values)]
        for rank in range(count):
            waiting = [(s, branch) for s in searches if (branch := s.branch(rank)) is not None]
            if not waiting:
                break
            starts = [b.starts for _, b in waiting]
            sizes = np.array([len(x) for x in starts])
            first = np.cumsum(sizes) - sizes
            own = np.array([s.seed for s, _ in waiting])
            places = np.concatenate(starts)
            edges, steps = self.walk(places, mixed(np.repeat(own, sizes), 3 * rank, np.arange(len(places)) - np.repeat(first, sizes)))
            closes = np.zeros(len(edges), np.int32)
            closes[np.cumsum(steps) - 1] = 1
            walked = np.concatenate(([0], np.cumsum(steps)))[np.append(first, len(places))]
            parts = [(b.before, edges[x:y]) for (_, b), x, y in zip(waiting, walked[:-1], walked[1:])]
            done = [(b.done, closes[x:y].cumsum() + (b.done[-1] if len(b.done) else 0)) for (_, b), x, y in zip(waiting, walked[:-1], walked[1:])]
            path, ends = np.concatenate([x for both in parts for x in both]), np.concatenate([x for both in done for x in both])
            lengths = np.array([len(x) + len(y) for x, y in parts])
            self._part(rank, waiting, path, ends, lengths, own, count - rank)
        return searches

    def _part(self, rank: int, waiting: list, path: np.ndarray, ends: np.ndarray, lengths: np.ndarray, seeds: np.ndarray, wanted: int) -> None:
        """Notes the drawn paths, and the sets into which the rest falls: those with the largest maxima, as many as can be wanted."""
        offset = np.cumsum(lengths) - lengths
        logq = self.logq[path]
        total = np.cumsum(logq)
        base = total[offset] - logq[offset]
        logp = total[offset + lengths - 1] - base
        ids = self.ids[path]
        for (search, branch), at, n, p in zip(waiting, offset.tolist(), lengths.tolist(), logp.tolist()):
            search.paths.append((path[at : at + n], p, branch.value, ids[at : at + n]))
            search.ends.append(ends[at : at + n])
        # Sets before the branch's step leave an earlier path and are its own. A step's mass is below the path's
        # probability up to it, so beyond some steps no noise can bring one among the largest.
        start = np.array([max(b.step, 0) for _, b in waiting])
        todo, reach = np.arange(len(waiting)), REACH
        while len(todo):
            own = np.minimum(lengths[todo] - start[todo], reach)
            begin = np.cumsum(own) - own
            owner = np.repeat(todo, own)
            step = np.arange(int(own.sum())) - np.repeat(begin - start[todo], own)
            at = offset[owner] + step
            before = total[at] - logq[at] - base[owner]
            mass = np.full(len(at), -np.inf)
            some = np.flatnonzero(logq[at] < 0.0)
            mass[some] = before[some] + np.log(-np.expm1(logq[at[some]]))
            for i, j in zip(begin.tolist(), todo.tolist()):
                branch = waiting[j][1]
                if branch.step >= 0:
                    mass[i] = before[i] + self.rest(path[at[i]], branch.out)
            open_ = np.flatnonzero(mass > -np.inf)  # steps at which there was a choice
            mass[open_] += gumbel(uniform(mixed(seeds[owner[open_]], 3 * rank + 1, step[open_]), 0))
            tops = []
            for _ in range(wanted):
                top = np.maximum.reduceat(mass, begin)
                hit = np.flatnonzero(mass == np.repeat(top, own))
                hit = hit[np.searchsorted(hit, begin)]
                tops.append((top, step[hit]))
                mass[hit] = -np.inf
            last = offset[todo] + start[todo] + own - 1
            whole = (start[todo] + own == lengths[todo]) | (total[last] - base[todo] + MOST_NOISE < tops[-1][0])
            for top, steps in tops:
                for j, value, i in zip(todo[whole].tolist(), top[whole].tolist(), steps[whole].tolist()):
                    if value > -math.inf:
                        search, branch = waiting[j]
                        out = branch.out if i == branch.step else (int(path[offset[j] + i]),)
                        heapq.heappush(search.sets, (float(np.logaddexp(-branch.value, -value)), len(search.paths), i, out))
            todo, reach = todo[~whole], reach * 8

    def beside(self, edge: int) -> range:
        """All edges of an edge's place: the last one's cumulated probability is infinite."""
        edge, most = int(edge), self.trie.longest
        begin = max(edge - most, 0)
        ends = np.flatnonzero(self.cum[begin : edge + most] == np.inf) + begin
        at = int(np.searchsorted(ends, edge))
        first, last = int(ends[at - 1]) + 1 if at else begin, int(ends[at])
        return range(first, last + 1)

    def rest(self, edge: int, out: tuple[int, ...]) -> float:
        """Log-probability that a path leaves an edge's place by none of ``out``."""
        left = [self.logq[e] for e in self.beside(edge) if e not in out]
        return float(np.logaddexp.reduce(left)) if left else -math.inf

    def spell(self, ids: np.ndarray, byte_ids: list[int]) -> np.ndarray:
        """Vocabulary ids, with the bytes of characters that have no piece."""
        if not len(ids) or ids.min() >= 0:
            return ids
        out, begin = [], 0
        for i in np.flatnonzero(ids < 0).tolist():
            out += [ids[begin:i], np.array([byte_ids[b] for b in chr(-1 - int(ids[i])).encode()], np.int32)]
            begin = i + 1
        return np.concatenate([*out, ids[begin:]]) if begin else ids


def mixed(seed: np.ndarray | np.uint64, use: int, place: np.ndarray) -> np.ndarray:
    """A seed for each place of one of a row's uses of random numbers."""
    with np.errstate(over="ignore"):
        return K.splitmix(seed + np.uint64(use + 1) * _MANY[0] + place.astype(np.uint64) * _MANY[1])


def uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from hashes."""
    with np.errstate(over="ignore"):
        return (K.splitmix(seeds + np.uint64(step + 1) * _MANY[2]) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def uniform_of(seed: int, use: int, place: int) -> float:
    """``uniform(mixed(seed, use, place), 0)`` for one place."""
    x = seed + (use + 1) * int(_MANY[0]) + place * int(_MANY[1])
    for more in (0, int(_MANY[2])):
        x = (x + more) & (2**64 - 1)
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        x ^= x >> 31
    return (x >> 11) * 2.0**-53


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(np.maximum(u, 1e-300)))


@dataclass
class Branch:
    """Where a path goes on: places of the rest of its word and of all later words; its first steps and the words done after each."""

    starts: np.ndarray
    before: np.ndarray
    done: np.ndarray
    value: float
    step: int = -1
    out: tuple[int, ...] = ()


class Search:
    """The search over one text's paths. A set holds the paths that share a path's first steps and do not go on by some edges."""

    def __init__(self, lattice: Lattice, words: np.ndarray, seed: np.uint64, value: float):
        self.lattice, self.words, self.seed, self.value = lattice, words, seed, value
        self.paths: list[tuple[np.ndarray, float, float, np.ndarray]] = []  # edges, log-probability, value, ids
        self.ends: list[np.ndarray] = []  # of each path: words complete after each step
        self.sets: list[tuple[float, int, int, tuple[int, ...]]] = []  # -value, number of the path, step, edges left out

    def branch(self, rank: int) -> Branch | None:
        """The next path's beginning: of the set with the largest maximum, which leaves its earlier path by another edge."""
        none = np.zeros(0, np.int64)
        if rank == 0:
            return Branch(self.words, none, none, self.value) if len(self.words) else None
        if not self.sets:
            return None
        value, number, step, out = heapq.heappop(self.sets)
        lattice, edges, ends = self.lattice, self.paths[number - 1][0], self.ends[number - 1]
        choice = [e for e in lattice.beside(edges[step]) if e not in out]
        logq = lattice.logq[choice]
        odds = np.cumsum(np.exp(logq - logq.max()))
        r = uniform_of(int(self.seed), 3 * rank + 2, step) * odds[-1]
        edge = choice[min(int(np.searchsorted(odds, r, "right")), len(choice) - 1)]
        complete, to = int(ends[step - 1]) if step else 0, int(lattice.to[edge])
        later = self.words[complete + 1 :]
        starts = np.concatenate(([to], later)) if to >= 0 else later
        return Branch(starts, np.append(edges[:step], edge), np.append(ends[:step], complete + (to < 0)), -value, step, (*out, edge))

    def threshold(self) -> float:
        return -self.sets[0][0] if self.sets else -math.inf


@lru_cache(maxsize=2)
def lattice_of(path: str, theta: float) -> Lattice:
    processor, vocabulary, byte_ids = load(path)
    trie = Trie(vocabulary, theta)
    return Lattice(trie, theta, Library(processor, trie, vocabulary, byte_ids))


def inclusion(logp: float, threshold: float) -> float:
    """Probability that a path of this log-probability exceeds the threshold."""
    return -math.expm1(-math.exp(min(logp - threshold, 50.0)))


Drawn = list[tuple[np.ndarray, float, float]]


def sample_words(words: list[list[str]], keys: list[int], count: int, path: str, theta: float = TEMPERATURE) -> list[Drawn]:
    """``count`` distinct segmentations of each whole text (its normalised words) at most: ids, log-probability, inclusion score."""
    return sample_numbers(lattice_of(path, theta).number(words), keys, count, path, theta)


def sample_numbers(numbers: list[np.ndarray], keys: list[int], count: int, path: str, theta: float = TEMPERATURE) -> list[Drawn]:
    """The same for texts given by their words' numbers in the lattice."""
    byte_ids, lattice = load(path)[2], lattice_of(path, theta)
    out = []
    for search in lattice.search(numbers, keys, count):
        least = search.threshold()
        out.append([(lattice.spell(ids, byte_ids), p, inclusion(p, least)) for _, p, _, ids in search.paths] or [(np.zeros(0, np.int32), 0.0, 1.0)])
    return out


def sample(text: str, key: int, count: int, path: str, theta: float = TEMPERATURE) -> list[tuple[list[int], float, float]]:
    """The same for one text."""
    words = lattice_of(path, theta).split(load(path)[0].normalize(text))
    return [(ids.tolist(), logp, share) for ids, logp, share in sample_words([words], [key], count, path, theta)[0]]


PIECES = "doc_id long, rank int, ids array<int>, logp double, inclusion double, decoded string"


def encode(docs: DataFrame, samples: int = 2, model: str = "piece_bpe_32k.model", locate: Callable[[str], str] = tokenizer_path) -> DataFrame:
    """Segmentations of every whole text: ``doc_id, rank, ids, logp, inclusion, decoded``.

    Rank 0 is the library's own encoding (``logp`` null, ``inclusion`` 1), ranks from 1 are sampled. ``decoded`` is
    the text that the library gives back for the ids of rank 0; a sampled path spells the same normalised text, so it
    has the same. A null or empty text has empty ids. A null key seeds as -1; repeated rows repeat; other columns are
    ignored. An empty table gives no rows.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = locate(model)
        processor, lattice = load(path)[0], lattice_of(path, TEMPERATURE)

        def work(keys: list[int | None], held: list[str]) -> pa.RecordBatch:
            numbers = lattice.number([lattice.split(processor.normalize(text)) for text in held])
            drawn = sample_numbers(numbers, [-1 if k is None else k for k in keys], samples, path) if samples else [[]] * len(held)
            ids, texts_, logps, shares, counts = [], [], [], [], []
            for text, own, best in zip(held, drawn, lattice.encoded(numbers)):
                if not lattice.library.holds or MARK in text:
                    best = np.array(processor.encode(text), np.int32)
                ids += [best, *(found for found, _, _ in own)]
                texts_.append(processor.decode(best.tolist()))
                logps += [None, *(logp for _, logp, _ in own)]
                shares += [1.0, *(share for _, _, share in own)]
                counts.append(1 + len(own))
            counts = np.array(counts)
            rank = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            origin = pa.array(np.repeat(np.arange(len(keys)), counts))
            key, decoded = pa.array(keys, pa.int64()).take(origin), pa.array(texts_, pa.string()).take(origin)
            return pa.RecordBatch.from_arrays([key, pa.array(rank.astype(np.int32)), lists, pa.array(logps, pa.float64()), pa.array(shares), decoded], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            keys, held, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                held.append(text)
                size += len(text)
                if size > 1 << 19:  # arrays of that many steps stay near the processor
                    yield work(keys, held)
                    keys, held, size = [], [], 0
            if keys:
                yield work(keys, held)

    return spread(texts(docs)).mapInArrow(run, PIECES)
