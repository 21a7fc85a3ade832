"""Periodic runs of words, found on a grammar of the texts: Re-Pair, one look at every rule, all derivations of it.

A run is a stretch of consecutive words with smallest period q and at least max(24, 3 q) words that no neighbouring word
extends with period q.

* **Stretches.** All runs of nine words that lie in a run come twice in their text (a run has at least 2 q + 8 words).
  Words that no such nine words cover end the stretches that are looked at; shorter stretches than a run are left out.
* **Re-Pair** over the word ids of all stretches of a block of texts: the pair of neighbours that occurs most often
  becomes a rule, until no pair occurs twice. It goes in rounds that handle all pairs at once: of overlapping pairs the
  more frequent one is replaced, of equally frequent ones that which occurs first. What is left of a stretch is joined
  two by two, so that each stretch has one root.
* **Boundaries.** A run crosses the middle of the smallest node of the derivation that holds it. So every rule is looked
  at once, at one place where it stands: for each period up to a third of it, the run around its middle. The longer side
  of a run has at least half of its words, so at the middle a run of at least max(12 - q, q / 2) words comes again q words
  on or back; only such periods are extended, to both sides within the rule, by halving steps over prefix hashes.
* **Translation.** What was found in a rule stands at each of its derivations. An interval inside another one with its
  period is cut off by the end of a rule and goes; of one interval with several periods the smallest is the run.

Blocks are made in one task from the texts that an Arrow batch holds, ``BLOCK`` words or one text at a time; results do
not depend on how texts are put together, since no rule is looked at beyond its own words. Words are compared as bytes
(by numbers made from them); longer runs of words as 64-bit hashes.

Defined results: null and empty texts and texts of white space have no words and no runs. Each row is judged by itself:
repeated rows, shared ids and null ids need no rule. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ID, _power, lean, mix, pa_schema, text_of, token_hashes

LEAST = 24
COPIES = 3
#: Words in a block, unless one text has more.
BLOCK = 1 << 20
_COVER = 9
_GRAM = 4
_PAIRS = 1 << 22
RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string"


def loop_of_id(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) for one text in ten, chosen by the crc32 of its id: from word a on it goes on with period p."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


def _ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of every member, and its number in the group."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def stretches(h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what may hold runs, in the word hashes of texts with the given edges."""
    n = len(h)
    if n < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    m = n - _COVER + 1
    gram = mix(owner[:m].astype(np.uint64) + np.uint64(1))
    for i in range(_COVER):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + h[i : m + i]
    whole = np.flatnonzero(owner[:m] == owner[_COVER - 1 :])
    gram = mix(gram[whole])
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    twice = np.zeros(len(whole), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = whole[twice]
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + _COVER, -1)
    cover = np.cumsum(step[:-1]) > 0
    change = np.flatnonzero((cover[1:] != cover[:-1]) | (owner[1:] != owner[:-1])) + 1
    start, end = np.r_[0, change], np.r_[change, n]
    good = cover[start] & (end - start >= LEAST)
    return start[good], end[good]


class Grammar:
    """Rules of two symbols each. Symbols below ``terminals`` are words; a rule only uses symbols with smaller numbers."""

    def __init__(self, words: np.ndarray, own: np.ndarray, terminals: int):
        self.left = [np.full(terminals, -1, dtype=np.int64)]
        self.right = [np.full(terminals, -1, dtype=np.int64)]
        self.size = np.ones(terminals, dtype=np.int64)
        self.at = [np.full(terminals, -1, dtype=np.int64)]  # one place where it stands
        self.rounds = [(0, terminals)]
        self.s, self.own, self.pos = words.astype(np.int64), own, np.arange(len(words))
        while self._replace(self._frequent()):
            pass
        while self._replace(self._two_by_two()):
            pass
        self.roots, self.root_at = self.s, self.pos
        self.left, self.right, self.at = (np.concatenate(x) for x in (self.left, self.right, self.at))

    def _neighbours(self) -> np.ndarray:
        return np.flatnonzero(self.own[1:] == self.own[:-1])

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a pair becomes a rule, and a number for each pair; no two of them overlap."""
        i = self._neighbours()
        codes = self.s[i] * len(self.size) + self.s[i + 1]
        _, first, inverse, count = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
        weight = np.where(count[inverse] > 1, count[inverse] * (len(codes) + 1) - first[inverse], -1)
        # pairs of one symbol with itself overlap one another: every other one counts
        joined = (np.diff(i) == 1) if len(i) else np.empty(0, dtype=bool)
        head = np.r_[True, ~(joined & (inverse[1:] == inverse[:-1]))] if len(i) else np.empty(0, dtype=bool)
        block = np.cumsum(head) - 1
        starts = np.flatnonzero(head)
        w = weight[starts]
        touch = joined[starts[1:] - 1] if len(starts) else joined
        beats = w > 0
        if len(w) > 1:
            beats[1:] &= ~touch | (w[1:] > w[:-1])
            beats[:-1] &= ~touch | (w[:-1] > w[1:])
        chosen = beats[block] & ((np.arange(len(i)) - starts[block]) % 2 == 0) if len(i) else head
        return i[chosen], codes[chosen]

    def _two_by_two(self) -> tuple[np.ndarray, np.ndarray]:
        number = np.arange(len(self.own)) - np.searchsorted(self.own, self.own)
        i = self._neighbours()
        i = i[number[i] % 2 == 0]
        return i, np.arange(len(i))

    def _replace(self, chosen: tuple[np.ndarray, np.ndarray]) -> bool:
        i, code = chosen
        if not len(i):
            return False
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        base = len(self.size)
        left, right = self.s[i[first]], self.s[i[first] + 1]
        self.left.append(left)
        self.right.append(right)
        self.at.append(self.pos[i[first]])
        self.size = np.r_[self.size, self.size[left] + self.size[right]]
        self.rounds.append((base, len(self.size)))
        self.s[i] = base + inverse
        keep = np.ones(len(self.s), dtype=bool)
        keep[i + 1] = False
        self.s, self.own, self.pos = self.s[keep], self.own[keep], self.pos[keep]
        return True

    def derivations(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rules, places): every place where a wanted rule is derived, level by level of the trees."""
        below = wanted.copy()
        for lo, hi in self.rounds[1:]:
            below[lo:hi] |= below[self.left[lo:hi]] | below[self.right[lo:hi]]
        node, at = self.roots, self.root_at
        while True:
            some = below[node]
            node, at = node[some], at[some]
            if not len(node):
                return
            here = wanted[node]
            yield node[here], at[here]
            inner = self.left[node] >= 0
            node, at = node[inner], at[inner]
            left = self.left[node]
            node, at = np.r_[left, self.right[node]], np.r_[at, at + self.size[left]]


class _Same:
    """Compares runs of words at two places by a polynomial over the words modulo 2^64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.up = _power("up", n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def equal(self, x: np.ndarray, y: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        """Whether the k words from x are those from y, where x < y."""
        return (self.sums[x + k] - self.sums[x]) * self.up[y - x] == self.sums[y + k] - self.sums[y]

    def ahead(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from x and y on are equal, at most ``most``."""
        return self._longest(lambda k: self.equal(x, y, k), most)

    def back(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before x and y."""
        return self._longest(lambda k: self.equal(x - k, y - k, k), most)

    @staticmethod
    def _longest(good: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
        low = np.zeros(len(most), dtype=np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            tried = np.minimum(low + step, most)
            low = np.where(good(tried), tried, low)
            step >>= 1
        return low


def boundary_runs(g: Grammar, same: _Same) -> np.ndarray:
    """Columns rule, start and end within it, period: runs that touch the middle of a rule, at least as a part of one."""
    nodes = np.flatnonzero(g.size >= LEAST)
    found = []
    k, first = _GRAM, 1
    while len(nodes):
        last = 4 * k - 2
        start, size = g.at[nodes], g.size[nodes]
        middle = start + g.size[g.left[nodes]]
        most = np.minimum(size // COPIES, last)
        ahead = np.minimum(most, np.minimum(start + size - middle - k, 2 * (start + size - middle) // COPIES))
        back = np.minimum(most, np.minimum(middle - start - k, 2 * (middle - start) // COPIES))
        for on, limit in ((True, ahead), (False, back)):
            todo = np.flatnonzero(limit >= first)
            cuts = np.searchsorted(np.cumsum(limit[todo] - first + 1), np.arange(_PAIRS, (limit[todo] - first + 1).sum() + _PAIRS, _PAIRS), side="right")
            for piece in np.split(todo, np.unique(cuts)):
                if not len(piece):
                    continue
                group, q = _ragged(limit[piece] - first + 1)
                j, q = piece[group], q + first
                m = middle[j]
                hit = same.equal(m, m + q, k) if on else same.equal(m - q - k, m - k, k)
                j, q, m = j[hit], q[hit], m[hit]
                x, y = (m, m + q) if on else (m - q, m)
                r = same.ahead(x, y, start[j] + size[j] - y)
                b = same.back(x, y, x - start[j])
                s, e = x - b, y + r
                long = e - s >= np.maximum(LEAST, COPIES * q)
                found.append(np.stack([nodes[j], s - start[j], e - start[j], q], axis=1)[long])
        k, first = 2 * k, last + 1
        nodes = nodes[g.size[nodes] >= COPIES * first]
    if not found:
        return np.empty((0, 4), dtype=np.int64)
    return _smallest(np.concatenate(found))


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows that differ in the last column only, the one where it is smallest."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
    return rows[new]


def maximal(rows: np.ndarray) -> np.ndarray:
    """(start, end, period) without intervals inside others of their period, with the smallest period of each."""
    if not len(rows):
        return rows
    start, end, q = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))].T
    rank = np.cumsum(np.r_[0, np.diff(q) != 0]) * (end.max() + 1)
    reach = np.maximum.accumulate(end + rank)
    new = np.r_[True, (end + rank)[1:] > reach[:-1]]
    return _smallest(np.stack([start, end, q], axis=1)[new])


def block_runs(words: np.ndarray, own: np.ndarray, terminals: int) -> np.ndarray:
    """(start, end, period) of all runs in numbered words whose stretches have the numbers ``own``."""
    g = Grammar(words, own, terminals)
    parts = boundary_runs(g, _Same(words))
    count = np.bincount(parts[:, 0], minlength=len(g.size))
    first = np.cumsum(count) - count
    out = [np.empty((0, 3), dtype=np.int64)]
    for node, at in g.derivations(count > 0):
        group, k = _ragged(count[node])
        part = parts[first[node][group] + k]
        out.append(np.stack([part[:, 1] + at[group], part[:, 2] + at[group], part[:, 3]], axis=1))
    return maximal(np.concatenate(out))


def _block(texts: list[list[bytes]], hashes: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    edges = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    start, end = stretches(np.concatenate(hashes), edges)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(start):
        return runs
    number: dict[bytes, int] = {}
    owner = np.searchsorted(edges, start, side="right") - 1
    ids: list[int] = []
    for t, s, e in zip(owner.tolist(), (start - edges[owner]).tolist(), (end - edges[owner]).tolist()):
        ids += [number.setdefault(w, len(number)) for w in texts[t][s:e]]
    own, _ = _ragged(end - start)
    base = np.cumsum(end - start) - (end - start)
    found = block_runs(np.array(ids, dtype=np.int64), own, len(number))
    part = own[found[:, 0]]
    place = found[:, 0] - base[part] + start[part] - edges[owner[part]]
    for t, s, n, q in zip(owner[part].tolist(), place.tolist(), (found[:, 1] - found[:, 0]).tolist(), found[:, 2].tolist()):
        runs[t].append((s, n, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    goes = np.zeros(len(words), dtype=bool)
    for s, n, q in runs:
        goes[s + q : s + n] = True
    return b" ".join([words[i] for i in np.flatnonzero(~goes).tolist()])


def find_runs(docs: DataFrame, loop: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """One row for each row: doc_id, n_words, runs by start and period, the strongest run, and the text without repeats.

    ``strongest`` has the greatest length / period (ties: smallest start, then period), null without runs. ``collapsed``
    are the words, one space apart, without those that a run holds after its first period. ``loop`` may give a text's
    (a, p) for words from a on to be replaced by a repetition of the p words from a.
    """
    target = pa_schema(SCHEMA)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(ID).to_pylist(), b.column("text")
            at = 0
            while at < len(ids):
                words, hashes, total, begin = [], [], 0, at
                while at < len(ids) and (total < BLOCK or at == begin):
                    text = texts[at].as_py()
                    w, h = text.encode().split(), token_hashes(text, lower=False)
                    again = loop(ids[at], len(w)) if loop else None
                    if again:
                        a, p = again
                        source = np.r_[np.arange(a), a + (np.arange(len(w) - a) % p)]
                        w, h = [w[i] for i in source.tolist()], h[source]
                    words.append(w)
                    hashes.append(h)
                    total += len(w)
                    at += 1
                runs = _block(words, hashes)
                best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else None for r in runs]
                named = lambda r: dict(zip(("start", "length", "period"), r)) if r else None
                columns = [
                    pa.array(ids[begin:at], type=target.field(0).type),
                    pa.array([len(w) for w in words], type=target.field(1).type),
                    pa.array([[named(x) for x in r] for r in runs], type=target.field(2).type),
                    pa.array([named(x) for x in best], type=target.field(3).type),
                    pa.array([_collapsed(w, r) for w, r in zip(words, runs)], type=pa.binary()).cast(target.field(4).type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    rows = lean(docs, ID, "text").select(F.col(ID).cast("long"), text_of().alias("text"))
    return rows.mapInArrow(work, SCHEMA)
