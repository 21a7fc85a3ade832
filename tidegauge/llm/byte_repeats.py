"""Suffix-array dedup: bytes of strings that also start in an earlier document, by column-wise index construction.

A window is a string of ``LENGTH`` bytes inside one document. Bytes covered by a window that also starts in a document
with a smaller doc_id are removed.

* **Dealing windows out.** The smallest hash of the 24-byte grams of a window is its mark: equal windows have equal marks
  wherever they stand. Neighbouring windows with one mark form a piece of at most ``LENGTH + 26`` bytes, so that each
  window is in one piece and all equal windows are in pieces with one mark.
* **Marks of one text only** go first. Each task sends the distinct marks of its texts, packed by ranges of the mark, and
  gets back those that another text has. Marks that several texts of a batch share are known there and sent once. About
  a fourteenth of the bytes are marks; most of them end here. Equal texts count as one: the smallest id holds the text,
  and its other copies go without a look at their windows.
* **Column-wise construction.** Pieces with shared marks, merged with their places in each batch, are brought together by
  mark. A task takes them in blocks and builds the suffix array of a block as a collection of documents: one more symbol
  of every piece each round, from its end on. The new suffixes are placed by the stable order of the symbols of the
  Burrows-Wheeler transform (what precedes the suffixes so far), and common prefixes of new neighbours are one more than
  the smallest between their predecessors. Transform, common prefixes and suffix numbers are read and written in
  sequence, old to new. Windows are equal where the common prefix is at least ``LENGTH``; each interval of them gets its
  smallest doc_id, and every place drops the windows whose smallest doc_id is below its own.

Blocks hold ``BLOCK`` pieces or the pieces of one mark, so the sequential files of the construction are arrays in memory.
Both joins use one shuffle of the texts. Equality is decided on the bytes (of whole texts: on two 64-bit hashes); marks
only bring pieces together.

Defined results: null and empty texts have no bytes; rows that share an id never remove one another's bytes, so exact
repeats keep theirs; a null id counts as smaller than every other one; strings never cross documents; an empty table
gives no rows. Ids are integers. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ID, lean, mix, text_of

LENGTH = 50
GRAM = 24
#: Pieces in one collection, unless one mark has more.
BLOCK = 4_096
#: Bytes of text hashed at once, unless one text has more.
CHUNK = 2 << 20
#: Marks dealt to one range, about.
MARKS = 1 << 20
_SPREAD = LENGTH - GRAM + 1
_END = 0xFF  # no byte of UTF-8
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _marks(raw: np.ndarray) -> np.ndarray:
    """For each place where LENGTH bytes start, the smallest hash of the grams in them."""
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    h = _BYTE[raw]
    for k in (1, 2, 4):
        h = h[:-k] * power(k) + h[k:]
    n = len(raw) - GRAM + 1
    # three times eight bytes
    least = mix(h[:n] * power(16) + h[8 : 8 + n] * power(8) + h[16 : 16 + n])
    for k in (1, 2, 4, 8):
        least = np.minimum(least[:-k], least[k:])
    rest = _SPREAD - 16
    return np.minimum(least[:-rest], least[rest:])


def _chunks(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, edges of the texts in them) for rows whose bytes are worked on together."""
    at = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
        yield lo, raw[at[lo] : at[hi]], (at[lo : hi + 1] - at[lo]).astype(np.int64)
        lo = hi


def _pieces(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its text, where its first window starts, how many windows it has, their mark."""
    if len(raw) < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    mark = _marks(raw)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    whole = owner[: len(mark)] == owner[LENGTH - 1 :]
    new = np.ones(len(mark), dtype=bool)
    new[1:] = (mark[1:] != mark[:-1]) | (owner[1 : len(mark)] != owner[: len(mark) - 1]) | ~whole[:-1]
    start = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.r_[new[1:] | ~whole[1:], True] & whole) + 1
    # a mark that comes again and again must not make a long piece
    parts = -(-(stop - start) // _SPREAD)
    run = np.repeat(np.arange(len(start)), parts)
    step = (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)) * _SPREAD
    start, stop = start[run] + step, stop[run]
    return owner[start], start, np.minimum(stop - start, _SPREAD), mark[start]


def _short(mark: np.ndarray, bits: int) -> np.ndarray:
    """Range and last 32 bits of a mark: enough to leave few marks of one document."""
    return ((mark >> np.uint64(64 - bits)) << np.uint64(32) | (mark & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and end."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return start, np.r_[start[1:], len(values)]


def _blob(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _send(bits: int):
    """For each range of marks: the texts of a batch that have some, how many, and which; apart from that, known shared ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row").to_numpy()
            marks, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for first, raw, edges in _chunks(b.column("text")):
                owner, _, _, mark = _pieces(raw, edges)
                marks.append(_short(mark, bits))
                rows.append(row[first + owner])
            mark, rows = np.concatenate(marks), np.concatenate(rows)
            order = np.lexsort((rows, mark))
            mark, rows = mark[order], rows[order]
            head = np.ones(len(mark), dtype=bool)
            head[1:] = mark[1:] != mark[:-1]
            new = head.copy()
            new[1:] |= rows[1:] != rows[:-1]
            mark, rows, head = mark[new], rows[new], head[new]
            shared = ~head | np.r_[~head[1:], False] if len(head) else head
            out: dict[str, list] = {f.name: [] for f in _SENT_ARROW}

            def add(part, rows, marks, low):
                start, end = _runs_of(rows)
                values = [part, _blob(rows[start], "<i8"), _blob(end - start, "<u4"), _blob(marks, "<u4" if low else "<i8"), not low]
                for name, value in zip(out, values):
                    out[name].append(value)

            sent, by = mark[head], rows[head]
            order = np.lexsort((by, sent >> 32))
            sent, by = sent[order], by[order]
            for lo, hi in zip(*_runs_of(sent >> 32)):
                add(int(sent[lo] >> 32), by[lo:hi], sent[lo:hi] & 0xFFFFFFFF, True)
            if shared.any():
                order = np.argsort(rows[shared], kind="stable")
                add(int(row[0] & ((1 << bits) - 1)), rows[shared][order], mark[shared][order], False)
            yield pa.RecordBatch.from_pydict(out, schema=_SENT_ARROW)

    return work


_SENT = "part bigint, rows binary, counts binary, marks binary, known boolean"
_SENT_ARROW = pa.schema([("part", pa.int64()), ("rows", pa.binary()), ("counts", pa.binary()), ("marks", pa.binary()), ("known", pa.bool_())])


def _answer(table: pa.Table) -> pa.Table:
    """(row, marks): those of one range that several texts have."""

    def read(known: bool) -> tuple[np.ndarray, np.ndarray]:
        t = table.filter(pc.equal(table.column("known"), known))
        whole = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=kind)
        return np.repeat(whole("rows", "<i8"), whole("counts", "<u4")), whole("marks", "<i8" if known else "<u4").astype(np.int64)

    rows, low = read(False)
    order = np.lexsort((rows, low))
    rows, low = rows[order], low[order]
    shared = np.zeros(len(low), dtype=bool)
    if len(low):
        start, end = _runs_of(low)
        several = rows[start] != rows[end - 1]
        shared = np.repeat(several, end - start)
    known_rows, known = read(True)
    rows = np.r_[rows[shared], known_rows]
    marks = np.r_[low[shared] | table.column("part")[0].as_py() << 32, known]
    order = np.argsort(rows, kind="stable")
    rows, marks = rows[order], marks[order]
    start, end = _runs_of(rows)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array(marks))
    return pa.table({"row": pa.array(rows[start], pa.int64()), "marks": lists})


def _extract(bits: int):
    """The distinct pieces of a batch with shared marks, each with all its places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, doc, lists = b.column("row").to_numpy(), b.column("doc").to_numpy(), b.column("marks")
            number: dict[bytes, int] = {}
            code: list[int] = []
            marks, places = [np.empty(0, np.uint64)], [np.empty((0, 3), np.int64)]
            for first, raw, edges in _chunks(b.column("text")):
                owner, start, n, mark = _pieces(raw, edges)
                some = lists.slice(first, len(edges) - 1)
                wanted = some.flatten().to_numpy()
                of = np.repeat(np.arange(len(edges) - 1), np.diff(some.offsets.to_numpy()))
                salted = lambda text, value: mix(mix(text.astype(np.uint64)) ^ value.astype(np.uint64))
                hit = np.isin(salted(owner, _short(mark, bits)), salted(of, wanted))
                owner, start, n = owner[hit], start[hit], n[hit]
                data = raw.tobytes()
                code += [number.setdefault(data[s:e], len(number)) for s, e in zip(start.tolist(), (start + n + LENGTH - 1).tolist())]
                marks.append(mark[hit])
                places.append(np.stack([row[first + owner], doc[first + owner], start - edges[owner]], axis=1))
            codes, place, mark = np.array(code, dtype=np.int64), np.concatenate(places), np.concatenate(marks)
            order = np.argsort(codes, kind="stable")
            first_of, last_of = _runs_of(codes[order])
            place = np.ascontiguousarray(place[order])
            blobs = [place[lo:hi].tobytes() for lo, hi in zip(first_of.tolist(), last_of.tolist())]
            columns = [pa.array(mark[order][first_of].astype(np.int64)), pa.array(list(number), pa.binary()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "piece", "places"])

    return work


_PIECES = "mark bigint, piece binary, places binary"


def smallest_holders(pieces: list[bytes], doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For window t of piece i the smallest ``doc`` of the pieces that hold it; one column for each t, unused ones max.

    Column by column from the right, the suffixes of all pieces are put in order: ``before`` is the transform, ``common``
    the common prefix with the suffix above, ``latest`` the place of the newest suffix of each piece. The ends come first,
    in piece order, and agree with nothing. Which suffix stands where is read off the finished transform.
    """
    m = len(pieces)
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
    text = np.full((m, int(size.max())), _END, dtype=np.uint8)
    text[np.arange(text.shape[1]) < size[:, None]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    before = text[np.arange(m), size - 1]
    common = np.zeros(m, dtype=np.uint8)
    latest = np.arange(m)
    going = np.arange(m)  # pieces with symbols left
    for step in range(1, int(size.max()) + 1):
        order = _by_symbol(before)
        source = latest[going]
        owner = np.empty(len(before), dtype=np.int32)
        owner[source] = going
        new = np.zeros(len(before), dtype=bool)
        new[source] = True
        new = new[order]
        k = np.flatnonzero(new)  # the new suffixes among all with a symbol, in order
        who = owner[order[k]]
        place = m + k
        left = size[who] - step
        # a new suffix and what follows it get new neighbours
        new[1:] |= new[:-1].copy()
        turn = np.flatnonzero(new)
        same = turn[(turn > 0) & (before[order[turn]] == before[order[turn - 1]])]
        spans = np.stack([order[same - 1] + 1, order[same] + 1], axis=1).ravel()
        least = np.minimum.reduceat(np.r_[common, np.uint8(0)], spans)[::2] if len(spans) else np.empty(0, np.uint8)
        old = np.ones(len(before) + len(k), dtype=bool)
        old[place] = False
        common = _merged(old, common, np.uint8(0))
        common[m + turn] = 0
        common[m + same] = least + np.uint8(1)
        before = _merged(old, before, np.where(left > 0, text[who, left - 1], _END).astype(np.uint8))
        latest[who] = place
        going = np.flatnonzero(size > step)
    # a suffix with one symbol more stands where the transform sends its predecessor
    order = _by_symbol(before)
    at = np.empty(len(before), dtype=np.int64)
    at[order] = m + np.arange(len(order))
    heads = np.flatnonzero(common < length)
    group = np.cumsum(common < length) - 1
    named = np.full(len(before), -1, dtype=np.int32)
    out = np.full((m, max(1, int(size.max()) - length + 1)), np.iinfo(np.int64).max, dtype=np.int64)
    here, places = np.arange(m), []
    for step in range(1, int(size.max()) + 1):
        some = np.flatnonzero(size >= step)
        here[some] = at[here[some]]
        named[here[some]] = some
        if step >= length:
            places.append((some, size[some] - step, here[some].copy()))
    holder = np.r_[doc, np.iinfo(np.int64).max][named]  # the ends hold nothing
    least = np.minimum.reduceat(holder, heads)
    for who, window, place in places:
        out[who, window] = least[group[place]]
    return out


def _by_symbol(before: np.ndarray) -> np.ndarray:
    """Places in stable order of their symbols, without those of whole pieces."""
    order = np.argsort(before, kind="stable")
    return order[: len(order) - np.count_nonzero(before == _END)]


def _merged(old: np.ndarray, was: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(old), dtype=was.dtype)
    out[old], out[~old] = was, new
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by mark to the places that drop windows: bit t of ``mask`` stands for the window t bytes on."""
    held: list[pa.RecordBatch] = []
    n = 0

    def build() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        number: dict[bytes, int] = {}
        code = np.array([number.setdefault(x, len(number)) for x in t.column("piece").to_pylist()], dtype=np.int64)
        blobs = t.column("places").to_pylist()
        code = np.repeat(code, [len(x) // 24 for x in blobs])
        row, doc, at = np.frombuffer(b"".join(blobs), dtype=np.int64).reshape(-1, 3).T
        lowest = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(lowest, code, doc)
        found = smallest_holders(list(number), lowest)
        mask = np.zeros(len(code), dtype=np.int64)
        for i in range(found.shape[1]):
            mask |= (found[code, i] < doc).astype(np.int64) << i
        some = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (row, doc, at, mask)], names=["row", "doc", "at", "mask"])

    for b in batches:
        mark = b.column("mark").to_numpy()
        cuts = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        if held and len(mark) and held[-1].column("mark")[-1].as_py() != mark[0]:
            cuts = np.r_[0, cuts]
        lo = 0
        for hi in cuts.tolist():
            if n + hi - lo >= BLOCK:
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                yield build()
                held.clear()
                n, lo = 0, hi
        if lo < b.num_rows:
            held.append(b.slice(lo))
            n += b.num_rows - lo
    if held:
        yield build()


_CLEANED = "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_CLEANED_ARROW = pa.schema([(ID, pa.int64()), ("n_bytes", pa.int64()), ("removed", _SPANS), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their windows to remove to removed runs of bytes and what is left; texts are worked on many at once."""
    for b in batches:
        copies = b.column("copy").fill_null(False).to_numpy(zero_copy_only=False)
        for first, raw, edges in _chunks(b.column("text")):
            size, n = np.diff(edges), len(edges) - 1
            whole = copies[first : first + n] & (size >= LENGTH)
            cuts = b.column("cuts").slice(first, n)
            text = np.repeat(np.arange(n), cuts.value_lengths().fill_null(0).to_numpy())
            values = cuts.flatten()
            at, mask = values.field("at").to_numpy(), values.field("mask").to_numpy()
            own = ~copies[first + text]
            text, at, mask = text[own], at[own], mask[own]
            # a window removes LENGTH bytes from its start on, all of one text
            starts = np.zeros(len(raw), dtype=np.int8)
            for t in range(_SPREAD):
                here = (mask >> t & 1).astype(bool)
                starts[edges[text[here]] + at[here] + t] = 1
            step = starts.copy()
            step[LENGTH:] -= starts[:-LENGTH]
            gone = (np.cumsum(step, dtype=np.int8) > 0) | np.repeat(whole, size)
            # runs end with their text
            opens, closes = gone.copy(), gone.copy()
            opens[1:] &= ~gone[:-1]
            closes[:-1] &= ~gone[1:]
            some = np.flatnonzero(size)
            opens[edges[some]] = gone[edges[some]]
            closes[edges[some + 1] - 1] = gone[edges[some + 1] - 1]
            start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            spans = np.searchsorted(start, edges)
            base = np.repeat(edges[:-1], np.diff(spans))
            pairs = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"])
            left = np.r_[0, np.cumsum(~gone)][edges].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(left.tobytes()), pa.py_buffer(raw[~gone].tobytes())])
            removed = pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([b.column(ID).slice(first, n), pa.array(size, pa.int64()), removed.cast(_SPANS), kept], schema=_CLEANED_ARROW)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, ``removed`` (maximal runs of bytes, ends exclusive) and ``kept`` (the other bytes) of every row."""
    own = lean(docs, ID, "text").select(F.col(ID).cast("long"), text_of().alias("text"))
    # both joins below take these columns by row, so that one shuffle of the texts serves them
    rows = own.select(ID, F.xxhash64("text").alias("row"), F.xxhash64(F.lit("twin"), F.col("text")).alias("twin"), "text")
    doc = F.coalesce(F.col(ID), F.lit(-(1 << 63))).alias("doc")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, 2 * total / (_SPREAD + 1) / MARKS))))

    # the smallest id with a text holds it; a list for each first hash, for texts that share it by chance
    holders = rows.groupBy("row", "twin").agg(F.min(doc).alias("lowest"))
    holder = F.struct("twin", "lowest").alias("holder")
    lowest = F.element_at(F.filter("holders", lambda h: h["twin"] == F.col("twin")), 1)["lowest"]

    sent = rows.select("row", "text").mapInArrow(_send(bits), _SENT)
    shared = sent.groupBy("part").applyInArrow(_answer, "row bigint, marks array<bigint>")
    both = shared.select("row", "marks", F.lit(None).cast("struct<twin:bigint,lowest:bigint>").alias("holder"))
    both = both.unionByName(holders.select("row", F.lit(None).cast("array<bigint>").alias("marks"), holder))
    known = both.groupBy("row").agg(F.flatten(F.collect_list("marks")).alias("marks"), F.collect_list("holder").alias("holders")).filter(F.size("marks") > 0)
    kept = rows.join(known, "row").select("row", doc, "text", "marks", lowest.alias("lowest")).filter("doc = lowest")
    pieces = kept.select("row", "doc", "text", "marks").mapInArrow(_extract(bits), _PIECES)
    drops = pieces.repartition("mark").sortWithinPartitions("mark").mapInArrow(_index, "row bigint, doc bigint, at bigint, mask bigint")

    cuts = drops.select("row", F.struct("doc", "at", "mask").alias("cut"), F.lit(None).cast("struct<twin:bigint,lowest:bigint>").alias("holder"))
    cuts = cuts.unionByName(holders.select("row", F.lit(None).cast("struct<doc:bigint,at:bigint,mask:bigint>").alias("cut"), holder))
    cuts = cuts.groupBy("row").agg(F.collect_list("cut").alias("cuts"), F.collect_list("holder").alias("holders"))
    found = rows.join(cuts, "row").select(ID, doc, "text", lowest.alias("lowest"), "cuts")
    mine = F.filter("cuts", lambda c: c["doc"] == F.col("doc"))
    return found.select(ID, "text", (F.col("doc") > F.col("lowest")).alias("copy"), mine.alias("cuts")).mapInArrow(_cut, _CLEANED)
