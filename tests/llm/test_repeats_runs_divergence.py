"""Byte repeats, periodic runs and source divergence against brute force, and the rows each has to define."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import CLASHING, ROWS
from tidegauge import session
from tidegauge.llm import byte_repeats, periodic_runs, queries, source_divergence
from tidegauge.llm.common import table, token_hashes


@pytest.fixture(scope="module", autouse=True)
def work_dir(spark):
    session.local_work_dir(spark)


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.when(F.col("doc_id") != 5, "en"))
    return df.select("*", *[F.lit("mine").alias(c) for c in [*CLASHING, "a.b", "mark", "piece", "row", "term", "runs", "at"]]).repartition(3)


# ---- byte repeats ----------------------------------------------------------------------------------------------------


def _low(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def removed_by_hand(rows, length=byte_repeats.LENGTH):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, _low(d)), _low(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < _low(d):
                gone[i : i + length] = b"\1" * length
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, len(b), sum(gone), len(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def removed(df):
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    rows = byte_repeats.remove_repeats(df).select("doc_id", "n_bytes", gone, F.size("removed"), "kept").collect()
    return [(*r[:4], bytes(r[4])) for r in rows]


def in_order(rows):
    return sorted(rows, key=lambda r: (_low(r[0]), r[1:]))


@pytest.mark.parametrize("chunk", [1, 150, byte_repeats.CHUNK])
def test_texts_are_cut_many_at_once(monkeypatch, chunk):
    """Texts of one batch, cut in chunks of about so many bytes: neighbours that are gone as a whole stay two runs."""
    monkeypatch.setattr(byte_repeats, "CHUNK", chunk)
    texts = ["a" * 60, "", "b" * 60, "c" * 49, "d" * 100, "é" * 60]
    cut = lambda at, mask: {"doc": 0, "at": at, "mask": mask}
    cuts = [[], [], [cut(0, 0b1)], [], [cut(0, 0b11), cut(0, 0b11), cut(50, 0b1)], [cut(5, 1 << 26)]]
    copies = [True, True, False, True, False, False]
    kind = pa.list_(pa.struct([("doc", pa.int64()), ("at", pa.int64()), ("mask", pa.int64())]))
    arrays = [pa.array([1, 2, 3, None, 5, 6], pa.int64()), pa.array(texts), pa.array(copies), pa.array(cuts, kind)]
    parts = list(byte_repeats._cut([pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "copy", "cuts"])]))
    assert len(parts) == (6 if chunk == 1 else 3 if chunk == 150 else 1)
    got = pa.Table.from_batches(parts).to_pylist()
    spans = [[(r["start"], r["end"]) for r in x["removed"]] for x in got]
    assert spans == [[(0, 60)], [], [(0, 50)], [], [(0, 100)], [(31, 81)]]
    for x, t, gone in zip(got, texts, spans):
        raw = t.encode()
        assert x["n_bytes"] == len(raw)
        assert x["kept"] == bytes(c for i, c in enumerate(raw) if not any(lo <= i < hi for lo, hi in gone))


def test_removed_bytes_of_the_table(spark, sf):
    df = table(spark, sf, "documents")
    want = removed_by_hand([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert in_order(removed(df)) == in_order(want)
    got = {r.doc_id: r for r in queries.QUERIES["op11_byte_repeats"](spark, sf).collect()}
    for d, n, gone, spans, kept in want:
        assert tuple(got[d])[1:] == (n, gone, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_of_overlapping_copies(spark, seed):
    rnd = random.Random(seed)
    passage = "".join(rnd.choice("abcdé ") for _ in range(400))
    rows = [(i, passage[rnd.randrange(200) : rnd.randrange(200, 400)] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(30)))) for i in range(80)]
    rows += [(None, passage[:120]), (3, passage[50:300]), (3, passage[50:300]), (7, None), (8, ""), (9, "a" * 3000), (10, "a" * 2000 + "b")]
    rows += [(11, "ab" * 400), (-5, "b" + "ab" * 100), (12, "a" * 49), (13, "a" * 50), (14, passage), (15, passage), (16, passage), (-9, passage[::-1]), (2, passage[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert in_order(removed(df)) == in_order(removed_by_hand(rows))


def test_removed_bytes_of_awkward_rows(spark, awkward):
    got = in_order(removed(awkward))
    assert len(got) == len(ROWS)
    by = {(r[0], r[1]): r for r in got}
    line = ROWS[0][1].encode()
    same = [r for r in got if r[0] == 1]
    assert len(same) == 2 and all(r[2] == 0 and r[4] == line for r in same)  # rows of one id spare one another
    assert by[(9, len(ROWS[9][1].encode()))][2] >= len(ROWS[0][1].split("\n")[1])  # the passage of id 1
    assert by[(7, 300_000)][2] == 0 and by[(2, 0)][2] == by[(3, 0)][2] == 0
    assert removed(awkward.limit(0)) == []


def test_index_finds_every_equal_window():
    rnd = random.Random(4)
    for _ in range(20):
        k = rnd.choice([1, 2, 4])
        base = bytes(rnd.randrange(97, 97 + k) for _ in range(300))
        pieces = list({base[s : s + 50 + rnd.randrange(27)] for s in (rnd.randrange(220) for _ in range(rnd.randrange(1, 60)))})
        doc = np.array([rnd.randrange(9) for _ in pieces])
        least = {}
        for p, d in zip(pieces, doc):
            for t in range(len(p) - 49):
                least[p[t : t + 50]] = min(least.get(p[t : t + 50], 99), d)
        got = byte_repeats.smallest_holders(pieces, doc)
        assert all(got[i, t] == least[p[t : t + 50]] for i, p in enumerate(pieces) for t in range(len(p) - 49))


# ---- periodic runs ---------------------------------------------------------------------------------------------------


def runs_by_hand(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    k = rnd.choice([1, 2, 3, 5, 30])
    w = [str(rnd.randrange(k)) for _ in range(rnd.randrange(400))]
    for _ in range(rnd.randrange(5)):
        base = [str(rnd.randrange(k)) for _ in range(rnd.randrange(1, 40))]
        at = rnd.randrange(len(w) + 1)
        w[at:at] = [base[i % len(base)] for i in range(rnd.randrange(1, 150))]
    if rnd.random() < 0.2:  # a Fibonacci word has runs that overlap
        a, b = ["a"], ["a", "b"]
        for _ in range(rnd.randrange(4, 11)):
            a, b = b, b + a
        w += b
    return w * rnd.choice([1, 1, 1, 2, 3])


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_repetitive_texts(seed):
    rnd = random.Random(seed)
    for _ in range(15):
        texts = [repetitive(rnd) for _ in range(rnd.randrange(1, 9))]
        hashes = [token_hashes(" ".join(t), lower=False) for t in texts]
        got = periodic_runs._block([[x.encode() for x in t] for t in texts], hashes)
        assert got == [runs_by_hand(t) for t in texts]


def test_every_rule_derives_its_words():
    rnd = random.Random(8)
    words = np.array([rnd.randrange(3) for _ in range(300)] * 2, dtype=np.int64)
    own = np.repeat([0, 1, 2], [100, 350, 150])
    g = periodic_runs.Grammar(words, own, 3)
    derived = {s: [s] for s in range(3)}
    for s in range(3, len(g.size)):
        derived[s] = derived[g.left[s]] + derived[g.right[s]]
        assert derived[s] == words[g.at[s] : g.at[s] + g.size[s]].tolist()
    assert sum((derived[r] for r in g.roots.tolist()), []) == words.tolist()
    assert len(g.roots) == 3


def test_runs_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        w = (r.text or "").encode().split()
        again = periodic_runs.loop_of_id(r.doc_id, len(w))
        if again:
            a, p = again
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
        runs = runs_by_hand(w) if len(w) < 3000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        written = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        g = got[r.doc_id]
        assert (g.n_runs, g.start, g.length, g.period) == (len(runs), *best)
        assert g.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert g.runs_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert len(got) == table(spark, sf, "documents").count()


def test_runs_of_awkward_rows(spark, awkward):
    got = periodic_runs.find_runs(awkward).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_words == 0 and by[i].runs == [] and by[i].collapsed == "" and by[i].strongest is None for i in (2, 3, 4))
    assert by[7].n_words == 1 and by[None].runs == []
    words = ROWS[6][1].encode().split()
    assert by[6].n_words == len(words)
    for r in by[6].runs:  # each is what it says
        s, n, q = r
        assert words[s : s + n - q] == words[s + q : s + n]
        assert s == 0 or words[s - 1] != words[s + q - 1]
        assert s + n == len(words) or words[s + n] != words[s + n - q]
    assert len(by[6].runs) > 0
    assert periodic_runs.find_runs(awkward.limit(0)).count() == 0


# ---- source divergence -----------------------------------------------------------------------------------------------


def audit_by_hand(rows, min_docs, top=10):
    terms = lambda t: "".join(c if c > "\x7f" or c.isalpha() else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split(" ")
    docs = [(lang or "", source or "", [t for t in terms(text) if t]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        df, counts = {}, {s: {} for _, s, _ in here}
        for _, s, ts in here:
            for t in set(ts):
                df[t] = df.get(t, 0) + 1
            for t in ts:
                counts[s][t] = counts[s].get(t, 0) + 1
        kept = [t for t in df if df[t] >= min_docs]
        whole = {t: sum(c.get(t, 0) for c in counts.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c.get(t, 0) + 2) // (sum(c.get(x, 0) for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            words = [(t, f(p[s][t], q[t])) for t in kept if counts[s].get(t, 0) and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("size", [source_divergence.SLICE, 1])
def test_divergence_by_hand(spark, size):
    rnd = random.Random(3)
    words = ["And", "the", "über", "É", "x1y", "it's", "東京", "zz", "and", "q" * 40]
    rows = [(" ".join(rnd.choice(words[: 4 + i % 7]) for _ in range(rnd.randrange(12))), rnd.choice(["en", "de", None, "a\x00b"]), rnd.choice(["s1", "s2", "é", None])) for i in range(150)]
    rows += [(None, "xx", "s1"), ("alone in its lang", "xx", "s2"), ("", "yy", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(4)
    got = sorted(tuple(r) for r in source_divergence.audit(df, min_docs=5, size=size).collect())
    assert got == audit_by_hand(rows, 5)


def test_divergence_of_awkward_rows(spark, awkward):
    rows = source_divergence.audit(awkward, min_docs=1).collect()
    groups = {(r.lang, r.source) for r in awkward.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).collect()}
    assert {(r.lang, r.source) for r in rows if r.part == "pair"} == {g for g in groups if sum(o[0] == g[0] for o in groups) > 1}
    assert source_divergence.audit(awkward.limit(0)).count() == 0
