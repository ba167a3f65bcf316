"""SentencePiece segmentations sampled without replacement, and their decoding.

The pieces of a SentencePiece model span a lattice over a text; a path's probability is the
product of its pieces' weights, normalised over all paths. ``sample`` draws the ``k`` paths with the
highest Gumbel-perturbed log-probabilities, which is a sample without replacement, by A* search: a
region of paths is bounded by its own Gumbel maximum; the best region gives up the path at its maximum
and is split into the regions that leave that path at each word. No piece holds a blank but at
its start or a line break, so the lattice falls apart into words, and a split at a word needs nothing but
that word's path probability. Words are sampled backwards from the lattice's forward sums, all
words of a chunk at once. Random numbers are hashes of the row key, so a row gets the same paths in
any partition.

The inclusion score of a path is the chance that it exceeds the (k+1)-th perturbed value, given that
value: 1 - exp(-exp(log p - kappa)); it is 1 where there are no more than k paths.

The model file brings no probabilities (its scores are merge ranks), and none is trained: a piece of
merge rank r weighs 1 / (r + OFFSET). Characters without a piece are their UTF-8 bytes' pieces.

Defined results: a null or empty text has the one path of its leading blank; a text with fewer than
k paths gives all of them; repeated rows, having equal keys, give equal paths; extra columns
stay out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import by_chunks, table, text_size
from colloquy.llm.registry import query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Paths drawn, added to a merge rank, and characters of text worked on at once.
K, OFFSET, CHUNK = 2, 10, 1 << 19
#: Letters of the words whose lattices a task remembers; words of more letters are cut where no piece lies across.
REMEMBERED, LONG = 1 << 20, 64
#: Paths of a word that may be listed where draws keep meeting barred ones; words with more are drawn on.
LISTED = 4096

#: Words of the lattice: no piece goes past their ends.
_WORD = re.compile(r"\n| *[^ \n]+| +")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BELOW_ONE = np.nextafter(np.float32(1), np.float32(0))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every number."""
    x = (x + _MIX).astype(np.uint64, copy=False)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    x = mixed(x)
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 1.0 / (1 << 53)
    return out


@dataclass
class Vocabulary:
    """Pieces with a real blank for the model's mark, their weights, and the ids of the 256 bytes."""

    pieces: list[str]
    weights: np.ndarray
    byte_ids: np.ndarray
    kinds: np.ndarray  # 0 text, 1 byte, 2 other
    spelled: np.ndarray  # the bytes of all pieces, one piece after the other
    start: np.ndarray  # of each piece therein
    size: np.ndarray

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i).replace("▁", " ") for i in range(n)]
        kinds = np.array([1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) else 0 for i in range(n)])
        byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == 1):
            byte_ids[int(pieces[i][3:5], 16)] = i
        first = int(np.flatnonzero(kinds == 0)[0])
        weights = 1.0 / (np.maximum(np.arange(n) - first, 0) + OFFSET)
        weights[kinds == 1] = 1.0 / (n + OFFSET)
        spelled = [bytes([int(p[3:5], 16)]) if kind == 1 else p.encode() for p, kind in zip(pieces, kinds)]
        size = np.array([len(s) for s in spelled])
        spelled = np.frombuffer(b"".join(spelled), np.uint8)
        return Vocabulary(pieces, weights, byte_ids, kinds, spelled, np.cumsum(size) - size, size)

    def decode(self, ids) -> str:
        """The text of a path; without the leading blank that encoding puts first."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - ends + size, size)
        at += np.arange(len(at))
        return self.spelled[at].tobytes().decode("utf-8", "replace")[1:]


class Lattice:
    """The pieces as a trie: a node for each distinct beginning of a piece, the root being 0."""

    def __init__(self, vocabulary: Vocabulary):
        text = np.flatnonzero(vocabulary.kinds == 0)
        self.longest = max(len(vocabulary.pieces[i]) for i in text)
        self.weights, self.byte_ids = vocabulary.weights, vocabulary.byte_ids
        self.logs = np.log(self.weights)
        self.kind = np.uint16 if len(self.weights) < 1 << 16 else np.int32  # of a piece's number
        nodes: dict[int, int] = {}
        ends = []
        for i in text.tolist():
            node = 0
            for c in vocabulary.pieces[i]:
                node = nodes.setdefault(node << 21 | ord(c), len(nodes) + 1)
            ends.append(node)
        self.pair = np.fromiter(chain([-1], nodes), np.int64, len(nodes) + 1)  # node before, and the letter
        self.piece = np.zeros(len(self.pair), self.kind)  # that ends at a node; 0 if none does
        self.piece[ends] = text
        self.inner = np.zeros(len(self.pair), bool)  # whether longer beginnings follow
        self.inner[self.pair[1:] >> 21] = True
        self.inner[0] = False  # 0 also stands for no node
        place = self._place(self.pair[1:])
        order = np.argsort(place, kind="stable")
        same = np.flatnonzero(place[order][1:] == place[order][:-1])
        self.after = np.zeros(len(self.pair), np.int32)  # the next node of the same place
        self.after[order[same] + 1] = order[same + 1] + 1
        self.slots = np.zeros(1 << 18, np.int32)
        self.slots[place[order[::-1]]] = order[::-1] + 1

    @staticmethod
    def _place(pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * _MIX) >> np.uint64(46)).view(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node that each node leads to by a letter; 0 where there is none."""
        pair = node.astype(np.int64)
        pair <<= 21
        pair |= code
        out = self.slots[self._place(pair)]
        bad = np.flatnonzero(self.pair[out] != pair)
        while len(bad):
            out[bad] = other = self.after[out[bad]]
            bad = bad[other > 0]
            bad = bad[self.pair[out[bad]] != pair[bad]]
        return out

    def walk(self, codes: np.ndarray, following: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each size, where pieces of it begin, their last letters' places, and the pieces; of size 1 also 0 for none.

        ``following`` has the place of the letter behind each place, -1 at a word's end.
        """
        start = np.flatnonzero(following >= 0)
        row, node = following[start], np.zeros(len(start), np.int32)
        for size in range(1, self.longest + 1):
            node = self.step(node, codes[row])
            piece = self.piece[node]
            if size == 1:
                yield size, start, row, piece
            else:
                some = np.flatnonzero(piece)
                yield size, start[some], row[some], piece[some]
            behind = following[row]
            live = np.flatnonzero(self.inner[node] & (behind >= 0))
            start, row, node = start[live], behind[live], node[live]


def letters_of(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


class Words:
    """The lattices of distinct words, given longest first: for each place, which pieces end there and how likely.

    Places are ordered by their distance from their word's begin, then by word; those of distance 0 have no pieces.
    """

    def __init__(self, words: list[str], lattice: Lattice):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        most = int(self.length[0]) if len(words) else 0
        n = np.searchsorted(-self.length, -np.arange(most + 2), "right")  # words of at least so many letters
        base = np.concatenate([[0], np.cumsum(n)])
        distance = np.repeat(np.arange(most + 2), n)
        word = np.arange(base[-1]) - base[distance]
        following = np.where(word < n[np.minimum(distance + 1, most + 1)], np.arange(base[-1]) + n[distance], -1)
        offset = np.concatenate([[0], np.cumsum(self.length)])
        codes = letters_of("".join(words))
        self.codes = np.zeros(base[-1], np.uint32)
        self.codes[len(words) :] = codes[(offset[word] + distance - 1)[len(words) :]]
        self.row = base[self.length] + np.arange(len(words))  # of each word's end

        count, found = np.zeros(base[-1], np.int64), []
        for _, start, row, piece in lattice.walk(self.codes, following):
            found.append((start, row, piece, nth := count[row]))
            count[row] = nth + 1
        first = np.concatenate([[0], np.cumsum(count)])
        self.last = first[1:] - 1
        self.piece = np.empty(first[-1], lattice.kind)
        self.source = np.empty(first[-1], np.int64)  # the place where a piece begins
        for start, row, piece, nth in found:
            at = first[row] + nth
            self.piece[at], self.source[at] = piece, start
        del found

        p = lattice.weights[self.piece]
        bare = np.flatnonzero(self.piece == 0)
        p[bare] = bytes_weight(lattice, self.codes[np.searchsorted(self.last, bare)])
        sums, many, scale = np.ones(base[-1]), np.ones(base[-1]), np.zeros(len(words))
        whole = np.ones(base[-1])
        with np.errstate(over="ignore", invalid="ignore"):
            for end in range(1, most + 1):
                a, b = base[end], base[end + 1]
                edges, begin = slice(first[a], first[b]), first[a:b] - first[a]
                source = self.source[edges]
                p[edges] *= sums[source]
                sums[a:b] = whole[a:b] = np.add.reduceat(p[edges], begin)
                many[a:b] = np.add.reduceat(many[source], begin)
                if end % lattice.longest == 0 and (m := n[end + 1]):  # else sums of long words vanish
                    by = whole[a : a + m]
                    scale[:m] += np.log(by)
                    for at in base[end + 1 - lattice.longest : end + 1]:
                        sums[at : at + m] /= by
            self.total = np.log(whole[self.row]) + scale  # logarithm of the sum over all paths
            self.many = many[self.row]  # how many paths there are
        lower = np.zeros(first[-1])  # cumulated over the pieces that end at a place, shortest first, without the own one
        rows = np.flatnonzero(count > 1)
        for nth in range(1, lattice.longest):
            at = first[rows] + nth
            lower[at] = lower[at - 1] + p[at - 1]
            rows = rows[count[rows] > nth + 1]
        lower /= np.repeat(whole, count)
        self.lower = lower.astype(np.float32)
        self.source[self.source < len(words)] = -1


def bytes_weight(lattice: Lattice, codes: np.ndarray) -> np.ndarray:
    size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    return lattice.weights[lattice.byte_ids[0]] ** size


class Memory:
    """Lattices of words: all that a task met since it last held more than ``REMEMBERED`` letters."""

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.known: dict[str, int] = {}
        self.held = {"word": 0, "place": 0, "piece": 0}
        kinds = {
            "word": {"length": np.int64, "row": np.int64, "total": np.float64, "many": np.float64},
            "place": {"last": np.int32, "codes": np.uint32},
            "piece": {"lower": np.float32, "piece": lattice.kind, "source": np.int32},
        }
        self.columns = {name: of for of, some in kinds.items() for name in some}
        for some in kinds.values():
            for name, kind in some.items():
                setattr(self, name, np.empty(0, kind))

    def _add(self, name: str, values: np.ndarray) -> None:
        old, n = getattr(self, name), self.held[self.columns[name]]
        if n + len(values) > len(old):
            new = np.empty((n + len(values)) * 5 // 4, old.dtype)
            new[:n] = old[:n]
            setattr(self, name, old := new)
        old[n : n + len(values)] = values

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of every word; lattices are built of those not remembered."""
        if self.held["place"] > REMEMBERED:
            self.known.clear()
            self.held = dict.fromkeys(self.held, 0)
        n, own = len(self.known), dict.fromkeys(words)
        new = sorted((w for w in own if w not in self.known), key=len, reverse=True)
        self.known.update(zip(new, range(n, n + len(new))))
        own = dict(zip(own, map(self.known.__getitem__, own)))  # a small one is quicker for all the words
        built = Words(new, self.lattice)
        built.row += self.held["place"]
        built.last += self.held["piece"]
        built.source[built.source >= 0] += self.held["place"]
        for name in self.columns:
            self._add(name, getattr(built, name))
        self.held["word"] += len(new)
        self.held["place"] += len(built.codes)
        self.held["piece"] += len(built.piece)
        return np.fromiter(map(own.__getitem__, words), np.int64, len(words))

    def every(self, word: int) -> list[tuple[float, np.uint64, np.ndarray]]:
        """All paths of one word: log-probability, name and ids."""
        out = []
        todo = [(int(self.row[word]), -float(self.total[word]), np.uint64(0), [])]
        while todo:
            row, log, name, tail = todo.pop()
            if row < 0:
                out.append((min(log, 0.0), name, np.array(tail, np.int32)))
                continue
            for at in range(int(self.last[row - 1]) + 1 if row else 0, int(self.last[row]) + 1):
                piece = int(self.piece[at])
                if piece:
                    ids, p = [piece], self.lattice.weights[piece]
                else:
                    ids = self.lattice.byte_ids[list(chr(self.codes[row]).encode("utf-8", "surrogatepass"))].tolist()
                    p = float(bytes_weight(self.lattice, self.codes[row : row + 1])[0])
                todo.append((int(self.source[at]), log + float(np.log(p)), name * _BASE + np.uint64(piece + 1), [*ids, *tail]))
        return out

    def draw(self, word: np.ndarray, key: np.ndarray) -> Paths:
        """A path for each entry of ``word``, by hashes of ``key``; backwards from the word's end."""
        n = len(word)
        order = np.argsort(word)  # entries of one word read the same places, one after the other
        own = word[order]
        row, keys, live = self.row[own], key[order], order
        sums, names = -self.total[own], np.zeros(n, np.uint64)
        spaces = np.cumsum(self.length[word])  # a path has no more pieces than letters
        ids, slot = np.zeros(int(spaces[-1]) if n else 0, np.int32), spaces[order] - 1
        log, name, count, step = np.empty(n), np.empty(n, np.uint64), np.empty(n, np.int64), 0
        while len(live):
            u = uniform(keys + np.uint64(step) * _BASE).astype(np.float32)
            np.minimum(u, _BELOW_ONE, out=u)  # may have been rounded up
            at = self.last[row].astype(np.int64)
            high = np.flatnonzero(self.lower[at] > u)
            while len(high):
                at[high] = less = at[high] - 1
                high = high[self.lower[less] > u[high]]
            piece = self.piece[at].astype(np.int64)
            p = self.lattice.logs[piece]
            ids[slot] = piece
            bare = np.flatnonzero(piece == 0)
            if len(bare):
                code = self.codes[row[bare]]
                ids[slot[bare]] = -code.astype(np.int64) - 1
                p[bare] = np.log(bytes_weight(self.lattice, code))
            sums += p
            names *= _BASE
            piece += 1
            names += piece.view(np.uint64)
            row = self.source[at]
            slot -= 1
            step += 1
            done = np.flatnonzero(row < 0)
            if len(done):
                who = live[done]
                log[who], name[who], count[who] = sums[done], names[done], step
                more = np.flatnonzero(row >= 0)
                live, row, slot, keys, sums, names = (x[more] for x in (live, row, slot, keys, sums, names))
        ids = ids[ids != 0]
        if len(ids) and ids.min() < 0:
            ids, count = self._spelled(ids, count)
        return Paths(np.minimum(log, 0.0), name, ids, count)

    def _spelled(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece, given as numbers below zero, as their bytes' pieces."""
        bare = np.flatnonzero(ids < 0)
        codes = (-ids[bare] - 1).tolist()
        spelled = {c: self.lattice.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in set(codes)}
        wide = np.ones(len(ids), np.int64)
        wide[bare] = [len(spelled[c]) for c in codes]
        new = np.repeat(ids, wide)
        new[new < 0] = np.concatenate([spelled[c] for c in codes])
        ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(count)])]
        return new, np.diff(ends)


def words_of(text: str, lattice: Lattice) -> list[str]:
    """The words of a text and the blank before it; long ones cut wherever no piece of several letters lies across."""
    words = _WORD.findall(" " + text)
    if max(map(len, words)) <= LONG:
        return words
    return [part for w in words for part in (_parts(w, lattice) if len(w) > LONG else [w])]


def _parts(word: str, lattice: Lattice) -> list[str]:
    places = np.append(np.arange(1, len(word) + 1), -1)  # the begin of the word, then its letters
    covered = np.zeros(len(word) + 1, np.int64)  # +1 and -1 where pieces begin to lie across a cut, and end
    for size, start, end, _ in lattice.walk(np.append(np.uint32(0), letters_of(word)), places):
        if size > 1:
            covered[start + 1] += 1
            covered[end] -= 1
    cuts = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
    ends = np.concatenate([cuts[cuts > 0], [len(word)]]).tolist()
    return [word[a:b] for a, b in zip([0, *ends], ends)]


@dataclass
class Paths:
    """Log-probability and name of each path; the ids of all in order, and how many of each."""

    log: np.ndarray
    name: np.ndarray
    ids: np.ndarray
    count: np.ndarray


class Search:
    """The A* search of one text: emitted paths, and the bounds of the regions each of them left."""

    def __init__(self, key: np.uint64, first: int, many: np.ndarray):
        self.key, self.first, self.n, self.many = key, first, len(many), many
        self.paths: list[dict] = []

    def emit(self, log: np.ndarray, name: np.ndarray, value: float, start: int, barred: list, mass: float, ids, count) -> None:
        """Take a path that leaves its region's prefix at word ``start``; split the rest of the region."""
        before = np.concatenate([[0.0], np.cumsum(log)])
        left = np.exp(log[start:])
        barred = [*barred, name[start]] if start < self.n else barred
        if start < self.n:
            mass += left[0]
            left[0] = mass
        with np.errstate(divide="ignore", over="ignore"):
            weight = before[start : self.n] + np.log1p(-np.minimum(left, 1.0))
            spent = self.many[start:] <= 1
            spent[:1] |= self.many[start : start + 1] <= len(barred)
            weight[spent] = -np.inf
            number = np.uint64(len(self.paths) + 1)
            u = uniform(self.key + number * _BASE + np.arange(start, self.n, dtype=np.uint64) * _MIX)
            free = weight - np.log(-np.log(u))
            bound = -np.logaddexp(-value, -free)
        self.paths.append(
            {"log": log, "name": name, "value": value, "start": start, "barred": barred, "mass": mass, "bound": bound, "ids": ids, "count": count}
        )

    def best(self) -> tuple[float, int, int]:
        """(bound, path, word) of the best region left."""
        tops = [(float(p["bound"].max(initial=-np.inf)), m) for m, p in enumerate(self.paths)]
        value, m = max(tops)
        return value, m, int(np.argmax(self.paths[m]["bound"])) + self.paths[m]["start"] if value > -np.inf else -1


def sampled(texts: list[str], keys: np.ndarray, k: int, lattice: Lattice, memory: Memory | None = None) -> list[list[dict]]:
    """For each text, its paths as dicts of ``ids, log_prob, perturbed, inclusion``."""
    with np.errstate(over="ignore"):  # hashes wrap around
        return _sampled(texts, keys, k, memory or Memory(lattice))


def _sampled(texts: list[str], keys: np.ndarray, k: int, words: Memory) -> list[list[dict]]:
    lattice = words.lattice
    split = [words_of(t, lattice) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    first = np.concatenate([[0], np.cumsum(sizes)])
    code = words.numbers(list(chain.from_iterable(split)))
    del split
    inner = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    lane = mixed(np.repeat(keys, sizes) ^ mixed(inner.astype(np.uint64)))  # a stream of its own for each word of a text

    def drawn(where: np.ndarray, turn: int):
        paths = words.draw(code[where], mixed(lane[where] + np.uint64(turn) * _MIX))
        return paths.log, paths.name, paths.ids, paths.count, np.concatenate([[0], np.cumsum(paths.count)])

    log, name, ids, count, at = drawn(np.arange(first[-1]), 0)
    # the first paths of all texts at once, as ``emit`` takes one
    before = np.zeros(first[-1])
    for a, b in zip(first[:-1], first[1:]):
        np.cumsum(log[a : b - 1], out=before[a + 1 : b])
    many = words.many[code]
    u = uniform(keys)
    values = -np.log(-np.log(u))
    with np.errstate(divide="ignore"):
        weight = before + np.log1p(-np.minimum(np.exp(log), 1.0))
        weight[many <= 1] = -np.inf
        u = uniform(np.repeat(keys + _BASE, sizes) + inner.astype(np.uint64) * _MIX)
        bound = -np.logaddexp(-np.repeat(values, sizes), -(weight - np.log(-np.log(u))))
    runs = []
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        run = Search(keys[d], a, many[a:b])
        path = {"log": log[a:b], "name": name[a:b], "value": values[d], "start": 0, "barred": [name[a]], "mass": float(np.exp(log[a]))}
        run.paths.append(path | {"bound": bound[a:b], "ids": ids[at[a] : at[b]], "count": count[a:b]})
        runs.append(run)
    for turn in range(1, k):
        picked = [(r, *r.best()) for r in runs]
        picked = [p for p in picked if p[1] > -np.inf]
        where = [np.arange(r.first + i, r.first + r.n) for r, _, _, i in picked]
        if not where:
            break
        edge = np.concatenate([[0], np.cumsum([len(w) for w in where])])
        log, name, ids, count, at = drawn(np.concatenate(where), turn)
        head = _unbarred(words, code, lane, picked, name[edge[:-1]], turn)
        for j, (r, value, m, i) in enumerate(picked):
            old, a, b = r.paths[m], edge[j], edge[j + 1]
            barred, mass = (old["barred"], old["mass"]) if i == old["start"] else ([old["name"][i]], float(np.exp(old["log"][i])))
            own_log, own_name, own_ids, own_count = log[a:b].copy(), name[a:b].copy(), ids[at[a] : at[b]], count[a:b].copy()
            if j in head:
                own_log[0], own_name[0], new = head[j]
                own_ids, own_count[0] = np.concatenate([new, own_ids[count[a] :]]), len(new)
            kept = int(old["count"][:i].sum())
            old["bound"][i - old["start"]] = -np.inf
            r.emit(
                np.concatenate([old["log"][:i], own_log]),
                np.concatenate([old["name"][:i], own_name]),
                value, i, barred, mass,
                np.concatenate([old["ids"][:kept], own_ids]),
                np.concatenate([old["count"][:i], own_count]),
            )
    out = []
    for r in runs:
        kappa = r.best()[0]
        rows = []
        for p in r.paths:
            log_prob = float(p["log"].sum())
            with np.errstate(over="ignore"):
                chance = float(-np.expm1(-np.exp(log_prob - kappa))) if kappa > -np.inf else 1.0
            rows.append({"ids": p["ids"], "log_prob": log_prob, "perturbed": float(p["value"]), "inclusion": chance})
        out.append(rows)
    return out


def _unbarred(words: Memory, code, lane, picked, names, turn: int) -> dict:
    """New paths for the first words of regions whose draw is barred there: drawn until none is."""
    out, open_ = {}, []
    for j, (r, _, m, i) in enumerate(picked):
        old = r.paths[m]
        barred = old["barred"] if i == old["start"] else [old["name"][i]]
        if names[j] in barred:
            open_.append((j, r.first + i, barred))
    tries, again = 1, 1
    while open_:  # the more have failed, the more are drawn at once
        if tries > 16:
            for j, w, barred in (o for o in open_ if words.many[code[o[1]]] <= LISTED):
                left = [p for p in words.every(code[w]) if p[1] not in barred]
                weight = np.cumsum(np.exp([p[0] for p in left]))
                u = uniform(mixed(lane[w : w + 1] + np.uint64(turn) * _MIX))[0] * weight[-1]
                out[j] = left[min(int(np.searchsorted(weight, u, "right")), len(left) - 1)]
            open_ = [o for o in open_ if o[0] not in out]
            if not open_:
                break
        where = np.repeat(np.array([w for _, w, _ in open_]), tries)
        number = np.tile(np.arange(again, again + tries, dtype=np.uint64), len(open_))
        paths = words.draw(code[where], mixed(mixed(lane[where] + np.uint64(turn) * _MIX) + number * _BASE))
        ids, at = paths.ids, np.concatenate([[0], np.cumsum(paths.count)])
        rest = []
        for x, (j, w, barred) in enumerate(open_):
            free = np.flatnonzero(~np.isin(paths.name[x * tries : (x + 1) * tries], barred))
            if len(free):
                y = x * tries + int(free[0])
                out[j] = (paths.log[y], paths.name[y], ids[at[y] : at[y + 1]])
            else:
                rest.append((j, w, barred))
        open_, again, tries = rest, again + tries, min(4 * tries, 1 << 16)
    return out


def sample(docs: DataFrame, doc_id: str, text: str, vocabulary: Vocabulary, k: int, schema: str, row: Callable) -> DataFrame:
    """Rows of ``row(doc_id, text, rank, path)`` for the k paths of every document, with columns ``schema``.

    ``path`` has ``ids`` (an array), ``log_prob``, ``perturbed`` and ``inclusion``; ``row`` runs in the
    tasks and decides what of it is kept.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.lit("segmentation"), F.col(doc_id)).alias("key")
    )
    fields = T.StructType([narrow.schema["doc_id"], *T.StructType.fromDDL(schema).fields])
    held: dict = {}

    def make(rows: list[dict]) -> dict:
        if "memory" not in held:
            held["memory"] = Memory(Lattice(vocabulary))
        keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
        found = sampled([r["text"] or "" for r in rows], mixed(keys), k, held["memory"].lattice, held["memory"])
        made = [row(r["doc_id"], r["text"] or "", rank, p) for r, some in zip(rows, found) for rank, p in enumerate(some, 1)]
        return {f.name: [m[i] for m in made] for i, f in enumerate(fields)}

    return by_chunks(narrow, make, fields, text_size(), CHUNK)


def encoded(docs: DataFrame, doc_id="doc_id", text="text", k: int = K, model: str = MODEL) -> DataFrame:
    """``doc_id, rank, ids, log_prob, perturbed, inclusion`` of the k paths of every document."""

    def row(key, _, rank, p):
        return key, rank, p["ids"], p["log_prob"], p["perturbed"], p["inclusion"]

    schema = "rank int, ids array<int>, log_prob double, perturbed double, inclusion double"
    return sample(docs, doc_id, text, Vocabulary.load(model), k, schema, row)


def decoded(rows: DataFrame, ids: str, model: str = MODEL, name: str = "text") -> DataFrame:
    """``rows`` with the text of their ``ids``."""
    vocabulary = Vocabulary.load(model)

    @F.pandas_udf("string")
    def text(some: pd.Series) -> pd.Series:
        return some.map(lambda x: None if x is None else vocabulary.decode(np.asarray(x, np.int64)))

    return rows.withColumn(name, text(ids))


@query("op5_segmentation")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = Vocabulary.load(MODEL)

    def row(key, text, rank, p):
        back = vocabulary.decode(p["ids"])
        ids = hashlib.sha256(p["ids"].astype("<i4").tobytes()).hexdigest()
        return key, rank, len(p["ids"]), p["log_prob"], p["perturbed"], p["inclusion"], ids, back == text

    schema = (
        "rank int, n_pieces int, log_prob double, perturbed double, inclusion double, ids_sha256 string, round_trip boolean"
    )
    return sample(table(spark, folder, "documents"), "doc_id", "text", vocabulary, K, schema, row)
