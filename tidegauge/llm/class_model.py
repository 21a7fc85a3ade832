"""Language-model scoring by a Brown class bigram: log p(text) = sum of log p(class | class before) + log p(word | class).

Counts cover all training documents, and every training word has a class of its own, found by exchange clustering: a word
moves to the class where the likelihood of the class bigram gains most, until a round over all words of a kind raises the
log-likelihood by less than ``RISE`` a token. Three kinds of words are clustered one after the other:

* the ``CORE`` most frequent ones move one after the other, with class counts kept up to date, while all other words
  stand in by ``TIED`` ties, one for each mix of last two bytes;
* the other words of the head (at most ``HEAD``, chosen by a count threshold, 16 bytes each in all tasks) start in the class of
  their tie and move by what stands before and after them in the text, many at once;
* all further words, however many, are rows of a table with their contexts and do the same; where two of them are
  neighbours, each round looks up the class of the other by a join.

p(d | c) is smoothed towards the class frequencies, p(word | class) by adding one, with one more for each tie of the class:
words that were never seen have the class of their tie and share its one, so that the whole is a distribution.

Words are 64-bit hashes. In scoring, words outside the head meet the table of their counts and classes in a join, together
with the classes on both sides; only the sums of a document come back. No count and no word is cut: the head only decides
which way a word is looked up, and what the driver holds does not grow with the corpus.

Defined results: null and empty texts are just the end token; an empty training part gives N = 0 and log 1 = 0 for the
base and a uniform model; rows that repeat an id and its text get equal results. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import _LOWER, ID, KEY, Scratch, crc_mod, lean, stored, text_key, text_of, token_hashes, token_spans

HEAD = 1 << 19
LEXICON = HEAD
CORE = 4096
TIED = 256
CLASSES = 32
WIDTH = CLASSES + 1
UNITS = LEXICON + TIED + 1
END_UNIT, END_CLASS = UNITS - 1, CLASSES
#: Clustering ends when a round raises the log-likelihood of the class bigram by less than this a token.
RISE = 0.02
#: So many parts of the words move one after the other in a round, each on contexts counted anew: words that move together
#: on old counts rush into the same classes.
CORE_PARTS, PARTS, TURNS = 4, 16, 2
TOWARDS = 50.0
END_HASH = np.uint64(1)
_FLUSH = 1 << 20
_ROW = 1 << 18
_NEIGHBOUR = 20  # bits of a unit
_LEAST_BLOCKS = 64


@dataclass(frozen=True)
class Model:
    """What a task needs to score: words of the head, classes of units, and log probabilities by class and unit."""

    total: int
    types: int
    head: np.ndarray  # sorted hashes
    head_n: np.ndarray
    words: np.ndarray  # sorted hashes of the lexicon
    word_unit: np.ndarray
    classes: np.ndarray
    move: np.ndarray
    unit_log: np.ndarray
    room: np.ndarray  # words of each class with their ones: what p(word | class) is divided by
    tails: DataFrame | None  # (h, c): the classes of the words outside the head, in a written table


def held_out():
    return crc_mod(7) == 2


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the tie of each: a mix of its last two bytes."""
    h = token_hashes(text)
    if not len(h):
        return h, np.empty(0, dtype=np.int32)
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    start, end = token_spans(raw)
    last, before = raw[end - 1].astype(np.int32), np.where(end - start > 1, raw[end - 2], 0).astype(np.int32)
    return h, (last * 31 + before * 7) % TIED


def lookup(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether each value is there."""
    if not len(sorted_hashes):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


def word_counts(training: DataFrame) -> DataFrame:
    """(h, tie, n) of every training word and of the end token; merged in each task before the shuffle."""

    def merged(parts: list) -> pd.DataFrame:
        h, tie = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        found, first, n = np.unique(h, return_index=True, return_counts=True)
        return pd.DataFrame({"h": found.view(np.int64), "tie": tie[first].astype(np.int32), "n": n})

    def count(batches):
        parts, size, ends = [], 0, 0
        for b in batches:
            for text in b["text"]:
                h, tie = read(text)
                ends += 1
                if len(h):
                    parts.append((h, tie))
                    size += len(h)
                if size >= _FLUSH:
                    yield merged(parts)
                    parts, size = [], 0
        if parts:
            yield merged(parts)
        if ends:
            yield pd.DataFrame({"h": [int(END_HASH)], "tie": np.array([-1], dtype=np.int32), "n": [ends]})

    return training.mapInPandas(count, "h long, tie int, n long").groupBy("h", "tie").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, limit: int) -> pd.DataFrame:
    """The words with the largest counts, at most ``limit``: all at or above a count, found from the counts of counts."""
    words = counts.filter("tie >= 0")
    # one row for each power of two and sixteenth of it: a few hundred rows
    grade = F.floor(F.log2(F.col("n").cast("double")) * 16)
    grades = sorted(((r["g"], r["c"]) for r in words.groupBy(grade.alias("g")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, so_far = None, 0
    for g, c in grades:
        if so_far + c > limit:
            break
        least, so_far = g, so_far + c
    if least is None:
        return pd.DataFrame({"h": np.empty(0, dtype=np.int64), "tie": np.empty(0, dtype=np.int32), "n": np.empty(0, dtype=np.int64)})
    return words.filter(grade >= least).toPandas()


def units_of(h: np.ndarray, tie: np.ndarray, words: np.ndarray, word_unit: np.ndarray) -> np.ndarray:
    at, there = lookup(words, h)
    return np.where(there, word_unit[at] if len(words) else 0, LEXICON + tie)


def unit_texts(training: DataFrame, words: np.ndarray, word_unit: np.ndarray) -> DataFrame:
    """(units, tails): the units of texts in order, each text closed by the end unit, as 32-bit numbers, and the hashes of
    those words that are outside the lexicon. A row has many texts.

    The counting passes differ only in the class of each unit, so texts are split and looked up once for all of them.
    """
    held = training.sparkSession.sparkContext.broadcast((words, word_unit))

    def code(batches):
        words_, word_unit_ = held.value

        def row():
            return pd.DataFrame({"units": [np.concatenate(parts).astype("<u4").tobytes()], "tails": [np.concatenate(outside).tobytes()]})

        for b in batches:
            parts, outside, size = [], [], 0
            for text in b["text"]:
                h, tie = read(text)
                units = units_of(h, tie, words_, word_unit_)
                parts.append(np.append(units, END_UNIT))
                outside.append(h[units >= LEXICON])
                size += len(h) + 1
                if size >= _ROW:
                    yield row()
                    parts, outside, size = [], [], 0
            if parts:
                yield row()

    return training.mapInPandas(code, "units binary, tails binary")


def _joined(batches, n: int, *names: str):
    """Arrays of about ``n`` units, and of their tails if asked for, from rows of ``unit_texts``."""
    held: list = [[] for _ in names]
    for b in batches:
        for row in zip(*(b[c] for c in names)):
            for some, x in zip(held, row):
                some.append(x)
            if sum(map(len, held[0])) >= 4 * n:
                yield [np.frombuffer(b"".join(x), dtype="<u4" if c == "units" else "<u8") for c, x in zip(names, held)]
                held = [[] for _ in names]
    if held[0]:
        yield [np.frombuffer(b"".join(x), dtype="<u4" if c == "units" else "<u8") for c, x in zip(names, held)]


def _around(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes before and after each unit. An end is what stands before the first word of the text after it."""
    return np.concatenate(([END_CLASS], cls[:-1])), np.concatenate((cls[1:], [END_CLASS]))


def _merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def unit_pairs(texts: DataFrame, fold: np.ndarray) -> DataFrame:
    """(l, r, n): how often unit l stands before unit r in all ``unit_texts``, ``fold`` being what stands for each unit.

    Every text is closed by the end unit, which is also what stands before the first word.
    """
    size, end = int(fold.max()) + 1, int(fold[END_UNIT])
    held = texts.sparkSession.sparkContext.broadcast(fold)

    def count(batches):
        for (units,) in _joined(batches, 4 * _FLUSH, "units"):
            units = held.value[units].astype(np.int64)
            pair, n = np.unique(np.concatenate(([end], units[:-1])) * size + units, return_counts=True)
            for i in range(0, len(pair), 1 << 18):
                some = pair[i : i + (1 << 18)]
                yield pd.DataFrame({"l": (some // size).astype(np.int32), "r": (some % size).astype(np.int32), "n": n[i : i + (1 << 18)]})

    return texts.mapInPandas(count, "l int, r int, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))


def context_counts(texts: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit has each class before it and after it: two (units, classes + 1), of ``unit_pairs`` or of
    ``unit_texts``."""
    pairs = unit_pairs(texts, np.arange(UNITS, dtype=np.int32)) if "units" in texts.columns else texts
    cells = len(classes) * WIDTH
    held = texts.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))

    def count(batches):
        total = np.zeros(2 * cells, dtype=np.int64)

        def add(some: list) -> None:
            l, r, n = (np.concatenate([b[c].to_numpy() for b in some]).astype(np.int64) for c in ("l", "r", "n"))
            np.add.at(total, r * WIDTH + held.value[l], n)
            np.add.at(total, cells + l * WIDTH + held.value[r], n)

        some, size = [], 0
        for b in batches:
            some.append(b)
            size += len(b)
            if size >= _FLUSH:
                add(some)
                some, size = [], 0
        if some:
            add(some)
        hit = np.flatnonzero(total)
        for i in range(0, len(hit), 65536):
            yield pd.DataFrame({"cell": hit[i : i + 65536].astype(np.int32), "n": total[hit[i : i + 65536]]})

    # the table has at most 2 * units * (CLASSES + 1) rows, however large the corpus
    summed = pairs.mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    held.destroy()
    flat = np.zeros(2 * cells)
    flat[summed["cell"].to_numpy(dtype=int)] = summed["n"].to_numpy(dtype=float)
    return flat[:cells].reshape(-1, WIDTH), flat[cells:].reshape(-1, WIDTH)


def _summed(pairs: DataFrame) -> np.ndarray:
    """The table of class pairs from (cell, n): rows are classes before, columns classes after."""
    flat = np.zeros(WIDTH * WIDTH)
    for r in pairs.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flat[r["cell"]] = r["n"]
    return flat.reshape(WIDTH, WIDTH)


def class_pairs(texts: DataFrame, classes: np.ndarray, outside: bool = True) -> np.ndarray:
    """How often each class follows each, over all texts; ``outside``: pairs with words outside the lexicon count, by tie."""
    held = texts.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))

    def count(batches):
        total = np.zeros(WIDTH * WIDTH, dtype=np.int64)
        for (units,) in _joined(batches, _FLUSH, "units"):
            cls = held.value[units].astype(np.int64)
            pair = np.concatenate(([END_CLASS], cls[:-1])) * WIDTH + cls
            if not outside:
                tail = (units >= LEXICON) & (units != END_UNIT)
                pair = pair[~(tail | np.concatenate(([False], tail[:-1])))]
            total += np.bincount(pair, minlength=WIDTH * WIDTH)
        yield pd.DataFrame({"cell": np.arange(WIDTH * WIDTH, dtype=np.int32), "n": total})

    table = _summed(texts.mapInPandas(count, "cell int, n long"))
    held.destroy()
    return table


def lexicon_neighbours(texts: DataFrame, blocks: int) -> DataFrame:
    """(block, keys, ns): the units beside each unit of the lexicon beyond the core, and how often they stand there.

    A key is the unit, one bit for after instead of before, and the neighbour. Units are dealt to blocks by their rank, so
    blocks are about as large as each other, and the rounds read no text.
    """

    def cut(batches):
        for (units,) in _joined(batches, 4 * _FLUSH, "units"):
            units = units.astype(np.int64)
            mine = (units >= CORE) & (units < LEXICON)
            own = units[mine] << (_NEIGHBOUR + 1)
            before, after = np.concatenate(([END_UNIT], units[:-1]))[mine], np.concatenate((units[1:], [END_UNIT]))[mine]
            key, n = np.unique(np.concatenate((own | before, own | (1 << _NEIGHBOUR) | after)), return_counts=True)
            block = (key >> (_NEIGHBOUR + 1)) % blocks
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.diff(block[order], prepend=-1))
            some = np.split(order, first[1:]) if len(order) else []
            yield pd.DataFrame({"block": block[order][first].astype(np.int32), "keys": [key[i].tobytes() for i in some], "ns": [n[i].tobytes() for i in some]})

    def merge(pdf):
        key, n = _merged(*(np.frombuffer(b"".join(pdf[c]), dtype=np.int64) for c in ("keys", "ns")))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "keys": [key.tobytes()], "ns": [n.tobytes()]})

    schema = "block int, keys binary, ns binary"
    return texts.mapInPandas(cut, schema).groupBy("block").applyInPandas(merge, schema)


def moved_units(blocks: DataFrame, classes, table: np.ndarray) -> DataFrame:
    """(h, now, n) as from ``moved``, of the units of ``lexicon_neighbours``, with the broadcast classes of all units."""

    def run(batches):
        change = np.zeros((WIDTH, WIDTH))
        for b in batches:
            for keys, ns in zip(b["keys"], b["ns"]):
                key, n = np.frombuffer(keys, dtype=np.int64), np.frombuffer(ns, dtype=np.int64)
                units, at = np.unique(key >> (_NEIGHBOUR + 1), return_inverse=True)
                cell = ((key >> _NEIGHBOUR) & 1) * WIDTH + classes.value[key & ((1 << _NEIGHBOUR) - 1)]
                counts = np.bincount(at * (2 * WIDTH) + cell, weights=n, minlength=len(units) * 2 * WIDTH).reshape(-1, 2, WIDTH)
                now = classes.value[units].astype(np.int64)
                best = best_classes(table, now, counts[:, 0], counts[:, 1])
                _add_moves(change, now, best, counts)
                yield pd.DataFrame({"h": pd.array(units, dtype="Int64"), "now": best.astype(np.int32), "n": np.nan})
        at = np.flatnonzero(change)
        yield pd.DataFrame({"h": pd.array([None] * len(at), dtype="Int64"), "now": at.astype(np.int32), "n": change.ravel()[at]})

    return blocks.mapInPandas(run, "h long, now int, n double")


def _listed(each: DataFrame) -> DataFrame:
    """(h, cells, ns) from (h, cell, n); a word has at most 2 * WIDTH cells."""
    some = each.groupBy("h").agg(F.collect_list(F.struct("cell", "n")).alias("__x"))
    return some.select("h", F.col("__x.cell").alias("cells"), F.col("__x.n").alias("ns"))


def tail_contexts(texts: DataFrame, classes: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Of words outside the lexicon: (h, now, cell, n), as in ``lexicon_contexts``, ``now`` being the class of the tie, and
    -1 in place of the cell where the neighbour is outside as well; and (l, r), such neighbours."""
    held = texts.sparkSession.sparkContext.broadcast(classes)

    def around(batches):
        for units, tails in _joined(batches, _FLUSH, "units", "tails"):
            cls = held.value[units].astype(np.int32)
            tail = (units >= LEXICON) & (units != END_UNIT)
            before, after = _around(np.where(tail, -1, cls))
            at = np.flatnonzero(tail)
            h, now = tails.view(np.int64), cls[at]
            for some in np.array_split(np.arange(len(at)), len(at) // 65536 + 1):
                b, a = before[at[some]], after[at[some]]
                yield pd.DataFrame({"h": h[some], "now": now[some], "before": b.astype(np.int32), "after": np.where(a < 0, -1, a + WIDTH).astype(np.int32)})

    def pairs(batches):
        for units, tails in _joined(batches, _FLUSH, "units", "tails"):
            tail = (units >= LEXICON) & (units != END_UNIT)
            h = tails.view(np.int64)
            place = np.cumsum(tail) - 1
            at = np.flatnonzero(tail[:-1] & tail[1:])
            yield pd.DataFrame({"l": h[place[at]], "r": h[place[at + 1]]})

    each = texts.mapInPandas(around, "h long, now int, before int, after int")
    each = each.select("h", "now", F.explode(F.array("before", "after")).alias("cell"))
    # a word keeps its row if all its neighbours are outside: the cell -1 stands for them
    each = each.groupBy("h", "now", "cell").agg(F.count("*").alias("n"))
    return each, texts.mapInPandas(pairs, "l long, r long").groupBy("l", "r").agg(F.count("*").alias("n"))


def _plogp(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _pair_table(classes: np.ndarray, right: np.ndarray) -> np.ndarray:
    table = np.zeros((WIDTH, WIDTH))
    np.add.at(table, classes, right)  # rows: class before, columns: class after
    return table


def likelihood(table: np.ndarray) -> float:
    """What the log-likelihood of the class bigram, a token, owes to the classes."""
    return float((_plogp(table).sum() - _plogp(table.sum(axis=1)).sum() - _plogp(table.sum(axis=0)).sum()) / max(table.sum(), 1))


def exchange(classes: np.ndarray, left: np.ndarray, right: np.ndarray, turn: int, parts: int = 2) -> np.ndarray:
    """Moves each unit of this turn to the class that raises the bigram likelihood most, one after the other."""
    classes, end = classes.copy(), len(classes) - 1
    table = _pair_table(classes, right)
    for u in np.argsort(-left.sum(axis=1), kind="stable"):
        if u == end or u % parts != turn % parts or not left[u].any():
            continue
        a, before, after = classes[u], left[u], right[u]
        table[:, a] -= before
        table[a, :] -= after
        np.maximum(table, 0, out=table)
        rows, cols = table.sum(axis=1), table.sum(axis=0)
        gain = (_plogp(table + before[:, None]) - _plogp(table)).sum(axis=0) + (_plogp(table + after[None, :]) - _plogp(table)).sum(axis=1)
        gain -= _plogp(rows + after.sum()) - _plogp(rows) + _plogp(cols + before.sum()) - _plogp(cols)
        gain[END_CLASS] = -np.inf
        best = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else int(a)
        classes[u] = best
        table[:, best] += before
        table[best, :] += after
    return classes


def best_classes(table: np.ndarray, now: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The class where the bigram likelihood gains most, for many words at once against one table of class pairs.

    What a word has in the table itself is taken out of the row and column of its class before it is compared.
    """
    out, rows, cols = now.copy(), table.sum(axis=1), table.sum(axis=0)

    def gains(into: np.ndarray, extra: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Sum over classes i of what into[i, c] gains from extra[w, i], c being each class; ``here`` is the word's own."""
        at, i = np.nonzero(extra)
        n = extra[at, i][:, None]
        gain = _plogp(into[i] + n) - _plogp(into[i])
        own = here[at]
        mine = into[i, own]
        gain[np.arange(len(at)), own] = _plogp(mine) - _plogp(np.maximum(mine - n[:, 0], 0))
        total = np.zeros((len(extra), WIDTH))
        if len(at):
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            total[at[starts]] = np.add.reduceat(gain, starts, axis=0)
        return total

    for some in np.array_split(np.arange(len(now)), len(now) // 2048 + 1):
        here, k = now[some], np.arange(len(some))
        gain = gains(table, left[some], here) + gains(table.T, right[some], here)
        for whole, n in ((cols, left[some].sum(axis=1)), (rows, right[some].sum(axis=1))):
            less = _plogp(whole[None, :] + n[:, None]) - _plogp(whole)[None, :]
            less[k, here] = _plogp(whole[here]) - _plogp(np.maximum(whole[here] - n, 0))
            gain -= less
        gain[:, END_CLASS] = -np.inf
        best = gain.argmax(axis=1)
        out[some] = np.where(gain[k, best] > gain[k, here] + 1e-9, best, here)
    return out


def _add_moves(change: np.ndarray, now: np.ndarray, best: np.ndarray, counts: np.ndarray) -> None:
    """Adds to the table of class pairs what moves from ``now`` to ``best`` change; counts are (words, before or after, class)."""
    new = best != now
    for to, sign in ((best[new], 1.0), (now[new], -1.0)):
        np.add.at(change.T, to, sign * counts[new, 0])
        np.add.at(change, to, sign * counts[new, 1])


def moved(words: DataFrame, table: np.ndarray) -> DataFrame:
    """(h, now, n): the best class of each word, from (h, now, cells, ns) and ``more``, further cells; and, where h is null,
    what the moves add to the cell ``now`` of the table."""
    held = words.sparkSession.sparkContext.broadcast(table)

    def dense(b, cells: str, ns: str) -> np.ndarray:
        c, n = b.column(cells), b.column(ns)
        size = np.diff(c.offsets.to_numpy())
        at = np.repeat(np.arange(len(size)), size) * (2 * WIDTH) + c.flatten().to_numpy()
        return np.bincount(at, weights=n.flatten().to_numpy(), minlength=len(size) * 2 * WIDTH).reshape(len(size), 2, WIDTH)

    def run(batches):
        change = np.zeros((WIDTH, WIDTH))
        for b in batches:
            if not len(b):
                continue
            counts = dense(b, "cells", "ns")
            if "more" in b.schema.names:
                counts = counts + dense(b, "more", "more_ns")
            now = b.column("now").to_numpy().astype(np.int64)
            best = best_classes(held.value, now, counts[:, 0], counts[:, 1])
            _add_moves(change, now, best, counts)
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(best.astype(np.int32)), pa.nulls(len(best), pa.float64())], names=["h", "now", "n"])
        at = np.flatnonzero(change)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(change.ravel()[at])], names=["h", "now", "n"])

    return words.mapInArrow(run, "h long, now int, n double")


def cluster_core(pairs: DataFrame) -> np.ndarray:
    """Classes of the core, of the ties that stand for all other words, and of the end, from ``unit_pairs``."""
    classes = (np.arange(CORE + TIED + 1) % CLASSES).astype(np.int64)
    classes[-1] = END_CLASS
    best, most, turn, was = classes, -np.inf, 0, -np.inf
    while True:
        left, right = context_counts(pairs, classes)
        now = likelihood(_pair_table(classes, right))
        best, most = (classes, now) if now > most else (best, most)
        if turn % CORE_PARTS == 0:
            if most < was + RISE:
                return best
            was = most
        classes, turn = exchange(classes, left, right, turn, CORE_PARTS), turn + 1


def cluster_lexicon(texts: DataFrame, classes: np.ndarray, tokens: int) -> np.ndarray:
    """Classes of all units, after the words of the lexicon beyond the core have moved."""
    spark, table = texts.sparkSession, class_pairs(texts, classes)
    work = Scratch(spark, "lexicon")
    blocks = work.put(lexicon_neighbours(texts, max(_LEAST_BLOCKS, tokens >> 19)), "blocks")
    while True:
        after, now = classes.copy(), table.copy()
        for part in range(PARTS):
            held = spark.sparkContext.broadcast(after.astype(np.uint8))
            got = moved_units(blocks.filter(f"block % {PARTS} = {part}"), held, now).toPandas()
            held.destroy()
            change = got["h"].isna()
            np.add.at(now.reshape(-1), got["now"][change].to_numpy(dtype=int), got["n"][change].to_numpy(dtype=float))
            np.maximum(now, 0, out=now)
            after[got["h"][~change].to_numpy(dtype=int)] = got["now"][~change].to_numpy(dtype=int)
        new = class_pairs(texts, after)
        rise = likelihood(new) - likelihood(table)
        if rise > 0:
            classes, table = after, new
        if rise < RISE:
            work.drop(blocks)
            return classes


def cluster_tails(texts: DataFrame, classes: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(h, now) of all words outside the lexicon, and the table of class pairs of the whole text."""
    spark, inner = texts.sparkSession, class_pairs(texts, classes, outside=False)
    work = Scratch(spark, "tails")
    each, pairs = (work.put(t, name) for t, name in zip(tail_contexts(texts, classes), ("each", "pairs")))
    start = each.groupBy("h").agg(F.first("now").alias("now"), F.collect_list(F.when(F.col("cell") >= 0, F.struct("cell", "n"))).alias("__x"))
    words = work.put(start.select("h", "now", F.col("__x.cell").alias("cells"), F.col("__x.n").alias("ns")), "words")
    work.drop(each)

    def whole(words: DataFrame) -> np.ndarray:
        """The table of class pairs with the words' classes."""
        one = words.select("now", F.explode(F.arrays_zip("cells", "ns")).alias("x"))
        one = one.select(F.when(F.col("x.cells") < WIDTH, F.col("x.cells") * WIDTH + F.col("now")).otherwise(F.col("now") * WIDTH + F.col("x.cells") - WIDTH).alias("cell"), F.col("x.ns").alias("n"))
        l, r = (words.select(F.col("h").alias(c), F.col("now").alias(f"{c}_now")) for c in "lr")
        two = pairs.join(l, "l").join(r, "r").select((F.col("l_now") * WIDTH + F.col("r_now")).alias("cell"), "n")
        return inner + _summed(one.unionByName(two))

    table = whole(words)
    while work.count(words):
        of = words.select(F.col("h").alias("__h"), "now")
        other = pairs.join(of, F.col("r") == F.col("__h")).select(F.col("l").alias("h"), (F.col("now") + WIDTH).alias("cell"), "n")
        other = other.unionByName(pairs.join(of, F.col("l") == F.col("__h")).select(F.col("r").alias("h"), F.col("now").alias("cell"), "n"))
        more = _listed(other.groupBy("h", "cell").agg(F.sum("n").alias("n"))).select("h", F.col("cells").alias("more"), F.col("ns").alias("more_ns"))
        none = F.array()
        known = words.join(more, "h", "left").select("h", "now", "cells", "ns", F.coalesce("more", none.cast("array<int>")).alias("more"), F.coalesce("more_ns", none.cast("array<long>")).alias("more_ns"))
        known, now, parts = work.put(known, "known"), table.copy(), []
        for turn in range(TURNS):
            parts.append(work.put(moved(known.filter(F.pmod(F.xxhash64("h"), F.lit(TURNS)) == turn), now), "moved"))
            for r in parts[-1].filter("h is null").groupBy("now").agg(F.sum("n").alias("n")).collect():
                now[divmod(r["now"], WIDTH)] += r["n"]
            np.maximum(now, 0, out=now)
        to = reduce(DataFrame.unionByName, parts).filter("h is not null").select("h", "now")
        after = work.put(known.drop("now", "more", "more_ns").join(to, "h").select("h", "now", "cells", "ns"), "words")
        work.drop(known, *parts)
        new = whole(after)
        rise = likelihood(new) - likelihood(table)
        if rise > 0:
            words, after, table = after, words, new
        work.drop(after)
        if rise < RISE:
            break
    work.drop(pairs)
    return words.select("h", F.col("now").alias("c")), table


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the stored table of all training counts (h, tie, n)."""
    training = docs.filter(~held_out()).select(text_of().alias("text"))
    counts = stored(word_counts(training), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = _frequent(counts, HEAD)
    # arrays of their own, since sorted copies of the frame would add to what the driver holds
    some = np.lexsort((frequent["h"].to_numpy(), -frequent["n"].to_numpy()))
    word_hash, often, tie = frequent["h"].to_numpy()[some].view(np.uint64), frequent["n"].to_numpy()[some], frequent["tie"].to_numpy()[some]
    del frequent, some
    order = np.argsort(word_hash)
    words, word_unit = word_hash[order], np.arange(len(often), dtype=np.int64)[order]
    texts = stored(unit_texts(training, words, word_unit), "units")
    # the core and the ties are numbered on; words of the lexicon beyond the core are folded to their ties
    fold = np.zeros(UNITS, dtype=np.int32)
    fold[: len(often)] = CORE + tie
    fold[:CORE] = np.arange(CORE)
    fold[LEXICON:] = np.arange(CORE, CORE + TIED + 1)
    pairs = stored(unit_pairs(texts, fold), "pairs")
    classes = cluster_core(pairs)[fold]
    if len(often) > CORE:
        classes = cluster_lexicon(texts, classes, int(sums["n"]))
    tails, table = None, None
    if sums["v"] > len(often) + 1:
        tails, table = cluster_tails(texts, classes)
    table = class_pairs(texts, classes) if table is None else table
    general = (table.sum(axis=0) + 1) / (table.sum() + WIDTH)
    move = np.log10((table + TOWARDS * general[None, :]) / (table.sum(axis=1, keepdims=True) + TOWARDS))
    ties = slice(LEXICON, LEXICON + TIED)
    room = table.sum(axis=0) + np.bincount(classes[: len(often)], minlength=WIDTH) + np.bincount(classes[ties], minlength=WIDTH)
    if tails is not None:
        for r in tails.groupBy("c").agg(F.count("*").alias("v")).collect():
            room[r["c"]] += r["v"]
    unit_log = np.full(UNITS, -np.inf)
    unit_log[: len(often)] = np.log10((often + 1) / room[classes[: len(often)]])
    unit_log[ties] = -np.log10(room[classes[ties]])
    unit_log[END_UNIT] = 0.0
    n = often.astype(np.int64)[order]
    return Model(int(sums["n"]), int(sums["v"]), words, n, words, word_unit.astype(np.int32), classes, move, unit_log, room, tails), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    rows = lean(docs, ID, "text").select(ID, text_key().alias(KEY), held_out().alias("held_out"), text_of().alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(replace(model, tails=None))
    ends = counts.filter("tie = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches):
        m = held.value
        below = np.log10(m.total + m.types + 1)
        for b in batches:
            out = {k: [] for k in ("n_tokens", "known", "base", "part", "tails", "before", "after", "ties")}
            for text in b["text"]:
                h, tie = read(text)
                units = units_of(h, tie, m.words, m.word_unit)
                there = units < LEXICON
                at, _ = lookup(m.head, h[there])
                logs = np.log10(m.head_n[at] + 1.0) if len(at) else np.zeros(0)
                cls = np.concatenate(([END_CLASS], m.classes[units], [END_CLASS]))
                # a word outside the head has its class and count in a table, so pairs with it are summed up after a join
                tail = np.concatenate(([False], ~there, [False]))
                pair = ~(tail[:-1] | tail[1:])
                around = np.where(tail, -1, cls).astype(np.int32)
                out["n_tokens"].append(len(h) + 1)
                out["known"].append(int(there.sum()) + (ends > 0))
                out["base"].append(float(logs.sum() + np.log10(ends + 1.0) - (len(h) + 1) * below))
                out["part"].append(float(m.move[cls[:-1], cls[1:]][pair].sum() + m.unit_log[units[there]].sum()))
                out["tails"].append(h[~there].view(np.int64))
                out["before"].append(around[:-2][~there])
                out["after"].append(around[2:][~there])
                out["ties"].append(tie[~there].astype(np.int32))
            yield pd.DataFrame({ID: b[ID], KEY: b[KEY], "held_out": b["held_out"]} | out)

    id_type = dict(rows.dtypes)[ID]
    lists = "tails array<long>, before array<int>, after array<int>, ties array<int>"
    parts = stored(rows.mapInPandas(run, f"{ID} {id_type}, {KEY} long, held_out boolean, n_tokens long, known long, base double, part double, {lists}"), "parts")
    tails = counts.filter("tie >= 0").select("h", "n").limit(0).withColumn("c", F.lit(0)) if model.tails is None else counts.filter("tie >= 0").select("h", "n").join(model.tails, "h")
    move, room = (F.lit([float(x) for x in a.ravel()]) for a in (model.move, np.maximum(model.room, 1)))
    tie_class = F.lit([int(c) for c in model.classes[LEXICON : LEXICON + TIED]])
    moved_ = lambda a, b: F.get(move, F.col(a) * WIDTH + F.col(b))
    doc = [ID, KEY]
    # one row for each word outside the head; copies of a row are many rows here and are divided out
    rare = parts.filter(F.size("tails") > 0).select(*doc, F.posexplode(F.arrays_zip("tails", "before", "after", "ties")).alias("at", "x"), F.get("tails", F.col("at") + 1).alias("next"), F.get("ties", F.col("at") + 1).alias("next_tie"))
    rare = rare.select(*doc, F.col("x.tails").alias("h"), F.col("x.before").alias("b"), F.col("x.after").alias("a"), F.get(tie_class, F.col("x.ties")).alias("t"), F.when(F.col("x.after") < 0, F.col("next")).alias("next"), F.get(tie_class, F.col("next_tie")).alias("next_t"))
    found = rare.join(tails, "h", "left").withColumn("mine", F.coalesce("c", "t"))
    word = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.get(room, F.col("mine")))
    sides = F.when(F.col("b") >= 0, moved_("b", "mine")).otherwise(0.0) + F.when(F.col("a") >= 0, moved_("mine", "a")).otherwise(0.0)
    each = found.select(*doc, F.coalesce(F.log10(F.col("n") + 1.0), F.lit(0.0)).alias("base"), (word + sides).alias("value"), F.col("n").isNotNull().cast("int").alias("seen"))
    two = found.filter("next is not null").select(*doc, "mine", F.col("next").alias("h"), "next_t").join(tails.select("h", "c"), "h", "left").withColumn("then", F.coalesce("c", "next_t"))
    each = each.unionByName(two.select(*doc, F.lit(0.0).alias("base"), moved_("mine", "then").alias("value"), F.lit(0).alias("seen")))
    added = each.groupBy(F.col(ID).alias("__id"), F.col(KEY).alias("__key")).agg(F.sum("base").alias("more"), F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    copies = parts.groupBy(F.col(ID).alias("__id"), F.col(KEY).alias("__key")).agg(F.count("*").alias("copies"))
    same = F.col(ID).eqNullSafe(F.col("__id")) & (F.col(KEY) == F.col("__key"))
    joined = parts.select(ID, KEY, "held_out", "n_tokens", "known", "base", "part").join(copies, same).drop("__id", "__key").join(added, same, "left")
    more, value = (F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0)) for c in ("more", "value"))
    seen = F.coalesce(F.col("seen") / F.col("copies"), F.lit(0)).cast("long")
    total = F.col("part") + value
    return joined.select(ID, "held_out", "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))
