"""Corpus operators: SQL checks, brute force, held-out accuracy, and the awkward rows every operator has to define."""

import collections
import glob
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import TESTDATA
from tidegauge import session
from tidegauge.llm import class_model, decontaminate, licences, line_labels, line_runs, mixing, near_duplicates, personal_data, quality_classifier, queries, toxicity
from tidegauge.llm.common import shingle_hashes, table, token_hashes
from tools.check import canonical


@pytest.fixture(scope="module", autouse=True)
def work_dir(spark):
    session.local_work_dir(spark)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TESTDATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_result_as_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got, want = df.toPandas(), duck.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


# ---- awkward rows ----------------------------------------------------------------------------------------------------

CLASHING = ["score", "key", "n", "a", "b", "c", "idx", "row", "y", "h", "start", "target", "line", "size", "taken", "spans", "w", "node", "kept", "i"]
LINE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, "Plain words here, some more of them, and an end.\n" + LINE, "x"),
    (1, "Plain words here, some more of them, and an end.\n" + LINE, "x"),
    (2, None, "x"),
    (3, "", None),
    (4, " \n\t \n", None),
    (5, "one two", "y"),
    (6, "\n".join(f"line {i % 700} of a very long text {i % 30}" for i in range(20_000)), "y"),
    (7, "a" * 300_000, "y"),
    (8, "9" * 200_000 + " 4111 1111 1111 1111 mail me at jo@ex.org", "y"),
    (9, "Another start.\n" + LINE, "x"),
    (None, "a row without an id but with words in it", "x"),
    (10, "É Å ß 東京 two words 🙂 end", "z"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, LINE, "q"), (2, None, "q"), (3, "", "q"), (4, "two words", "q"), (None, "one two", "q"), (5, LINE, "q")], "item_id long, text string, doc_id string")


OPERATORS = {
    "decontaminate": lambda d, it, lb: decontaminate.report(d, it),
    "personal_data": lambda d, it, lb: personal_data.detect(d),
    "class_model": lambda d, it, lb: class_model.score(d, *class_model.fit(d)),
    "quality": lambda d, it, lb: quality_classifier.score(d, quality_classifier.fit(d, lb)),
    "licences": lambda d, it, lb: licences.scan(d, licences.known_digests(d.sparkSession)),
    "line_runs": lambda d, it, lb: line_runs.remove_runs(d),
    "mixing": lambda d, it, lb: mixing.mix(d)[1],
    "line_labels": lambda d, it, lb: line_labels.judge(d.select("doc_id", "text"), line_labels.fit(d)),
    "toxicity": lambda d, it, lb: toxicity.score(d, toxicity.fit(d, lb)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_gets_a_row(awkward, items, no_labels, name):
    got = OPERATORS[name](awkward, items, no_labels).collect()
    want = collections.Counter(r[0] for r in ROWS)
    assert collections.Counter(r.doc_id for r in got) == want


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(awkward, items, no_labels, name):
    assert OPERATORS[name](awkward.limit(0), items.limit(0), no_labels).collect() == []


def test_contamination_of_awkward_rows(awkward, items):
    got = {r.doc_id: r for r in decontaminate.report(awkward, items).collect()}
    assert (got[1].n_hit, got[1].n_items) == (60, 2) and got[9].contaminated
    assert got[1].items_sha256 == hashlib.sha256(b"1,5").hexdigest()
    assert (got[5].n_hit, got[5].n_items) == (2, 0)  # the item without an id marks words and is not listed
    assert got[10].n_hit == 2 and got[10].n_words == 8
    assert got[2].n_words == got[3].n_words == 0 and not got[2].contaminated
    kept = decontaminate.remove_documents(awkward, items)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 6, 7, 8, None}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(awkward, items).collect()}
    assert cut[9] == "Another start" and cut[5] == "" and cut[2] is None
    assert cut[10] == "É Å ß 東京 🙂 end"


def test_decontamination_without_broadcast_is_the_same(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    a, b = (canonical(decontaminate.report(docs, bench, max_broadcast=m).drop("ranges").toPandas()) for m in (10**6, 0))
    assert a == b


def test_near_duplicates_of_awkward_rows(awkward):
    rows = near_duplicates.classes(awkward).collect()
    got = {r.doc_id: r for r in rows}
    assert set(got) == {r[0] for r in ROWS}
    assert got[9].component_id == 1 and not got[9].kept and sum(r.kept for r in rows if r.doc_id == 1) == 1
    assert got[2].n_shingles == got[3].n_shingles == got[4].n_shingles == 0 and got[3].kept
    assert got[5].n_shingles == 1
    assert near_duplicates.classes(awkward.limit(0)).collect() == []
    kept = near_duplicates.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in rows)


# ---- near-duplicates -------------------------------------------------------------------------------------------------


def test_hashes_tell_words_apart():
    words = [f"w{i}" for i in range(50_000)] + ["é", "É", "a", "aa", "aaa"]
    assert len(np.unique(token_hashes(" ".join(words), lower=False))) == len(words)
    assert (token_hashes("The\x0bCAT  sat\r\n") == token_hashes("the cat sat")).all()
    assert token_hashes("É")[0] != token_hashes("é")[0]
    assert len(shingle_hashes(token_hashes("a b c d e a b c d e"))) == 5


def test_crowded_nodes_lose_no_link(spark):
    """Chains and clusters of near copies far larger than a small node, around one shared passage."""
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(80)]
    rows, n = [], 0
    for cluster in range(6):
        base = shared + [f"c{cluster}x{i}" for i in range(120)]
        for _ in range(40):
            words = list(base)
            for at in rng.choice(len(words), 3, replace=False):
                words[at] = f"e{rng.integers(10**9)}"
            rows.append((n, " ".join(words)))
            n += 1
    chain = [f"k{i}" for i in range(200)]
    for step in range(30):  # each is near the next only
        rows.append((n, " ".join(chain[step * 4 :] + [f"k{200 + i}" for i in range(step * 4)])))
        n += 1
    for i in range(150):
        rows.append((n, " ".join(shared + [f"u{i}x{j}" for j in range(90)])))
        n += 1
    order = rng.permutation(n)
    rows = [(int(order[i]), t) for i, t in rows]
    got = {r.doc_id: r.component_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = {i: set(shingle_hashes(token_hashes(t)).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in sets}


# ---- line runs -------------------------------------------------------------------------------------------------------


def _brute_runs(rows, min_words):
    seqs = [(d, [(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]) for d, t in sorted(rows)]
    where, deleted = collections.defaultdict(list), collections.defaultdict(set)
    for k, (d, s) in enumerate(seqs):
        for j, (_, x) in enumerate(s):
            for k2, j2 in where[x]:
                a, m = seqs[k2][1], 0
                while j + m < len(s) and j2 + m < len(a) and s[j + m][1] == a[j2 + m][1]:
                    m += 1
                if sum(len(s[j + q][1].split()) for q in range(m)) >= min_words:
                    deleted[d] |= {s[j + q][0] for q in range(m)}
            where[x].append((k, j))
    return {d: sorted(deleted[d]) for d, _ in seqs}


def test_line_runs_against_all_pairs_of_places(spark, texts):
    rows = list(texts.items())
    got = line_runs.remove_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _brute_runs(rows, 50)
    assert any(want.values())
    assert {r.doc_id: list(r["__deleted"]) for r in got} == want
    for r in got:
        lines = (texts[r.doc_id] or "").split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in set(want[r.doc_id]))


def test_line_runs_on_random_sequences(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "\n".join(" ".join([f"l{v}"] * (1 + v % 4)) if v else "" for v in rng.integers(0, 7, rng.integers(1, 60)))) for i in range(60)]
    got = line_runs.remove_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_words=9).collect()
    assert {r.doc_id: list(r["__deleted"]) for r in got} == _brute_runs(rows, 9)


# ---- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "phone": 9 <= len(digits) <= 15}[kind]


def _base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _valid(k, m.group(0))]


def _check_spans(got, texts):
    for r in got:
        name = lambda spans: [(personal_data.KINDS[s.kind], s.start, s.end) for s in spans]
        assert name(r.base) == _base(texts[r.doc_id])
        assert set(name(r.base)) <= set(name(r.spans))


def test_base_spans_of_the_tables(spark, sf, texts):
    got = personal_data.detect(table(spark, sf, "documents")).collect()
    assert sum(len(r.base) for r in got) > 5
    _check_spans(got, texts)


def test_base_spans_of_hard_texts(spark):
    rng = np.random.default_rng(1)
    parts = ["a@b.c", "_d@e.f.", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.4.5", " ", "-", "+1 (555) 123-4567", "+49", "4111111111111111", "4111 1111-1111 1111", "12", "é🙂", "%+x", "\n", "0", "mail: "]
    texts = {i: "".join(rng.choice(parts, rng.integers(1, 40))) for i in range(400)}
    texts[1000] = "x " + " ".join("10.0.0.%d jo%d@ex.org" % (i % 300, i) for i in range(3000))
    got = personal_data.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    _check_spans(got, texts)


def test_windows_inside_longer_runs(spark):
    texts = {
        0: "pay 4111111111111111 4012888888881881 now", 1: "pay 4111 1111 1111 1111 5500-0000-0000-0004 now", 2: "pay 4111111111111112 4012888888881882 now",
        3: "call +49 30 1234567 2024 11 30 18 now", 4: "é 999.192.168.1.10 now", 5: " ".join("4" * 2_000), 6: "12 4111111111111111",
    }
    got = collections.defaultdict(set)
    for r in personal_data.candidates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        for s in r.found:
            assert texts[r.doc_id][s.start : s.end] == s.value and texts[r.doc_id][: s.start].endswith(s.left) and texts[r.doc_id][s.end :].startswith(s.right)
            if not s.base and not s.strict:
                got[r.doc_id].add((personal_data.KINDS[s.kind], s.value))
    assert got[0] == {("card", "4111111111111111"), ("card", "4012888888881881")}
    assert {("card", "4111 1111 1111 1111"), ("card", "5500-0000-0000-0004")} <= got[1]
    assert not any(k == "card" for k, _ in got[2])  # the check digits are wrong
    assert ("phone", "+49 30 1234567") in got[3]
    assert got[4] == {("ip", "192.168.1.10")}
    assert ("card", "4111111111111111") in got[6]


def test_two_adjacent_cards_are_found(spark):
    def number(i, right):
        stem = f"4{i * 7919 % 10**8:014d}"
        twice = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(stem))))
        return stem + str((-twice + (not right)) % 10)

    good = "4111111111111111"
    rows = [(i, f"{i} credit card {number(i, True)} for order {i} at once") for i in range(400)] + [(1000 + i, f"list {i} counts as {number(i, True)}{number(i + 1, False)} pieces in stock") for i in range(400)]
    rows.append((5000, f"7 credit card {good} 4012888888881881 for order 7 at once"))
    got = {r.doc_id: r for r in personal_data.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000].base == [] and [(s.start, s.end) for s in got[5000].spans] == [(14, 30), (31, 47)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "🙂 write jo@ex.org or 10.0.0.1!", 5), (2, None, 6)], "doc_id long, text string, spans int")
    got = {r.doc_id: r.text for r in personal_data.redact(df).collect()}
    assert got == {1: "🙂 write [email] or [ip]!", 2: None}


# ---- language model --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [class_model.HEAD, 300])
def test_base_score_of_the_class_model(spark, sf, texts, monkeypatch, head):
    monkeypatch.setattr(class_model, "HEAD", head)
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in class_model.score(docs, *class_model.fit(docs)).collect()}
    words = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i in texts if not held[i] for w in words[i])
    total, types = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), total, held[i])
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (total + types + 1)) for w in ws), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than the unigram on texts not seen


def test_class_model_is_a_distribution(spark, sf):
    docs = table(spark, sf, "documents")
    m, counts = class_model.fit(docs)
    assert np.allclose((10**m.move).sum(axis=1), 1)
    words = counts.filter("tie >= 0").toPandas()
    units = class_model.units_of(words["h"].to_numpy().view(np.uint64), words["tie"].to_numpy(), m.words, m.word_unit)
    p = 10 ** m.unit_log[units] * np.where(units >= class_model.LEXICON, words["n"] + 1.0, 1.0)
    per_class = np.bincount(m.classes[units], weights=p, minlength=class_model.CLASSES)
    # what is missing to one is the share of words never seen, one for each tied unit, and of lexicon units without a word
    assert (per_class < 1).all()
    tied = np.arange(class_model.LEXICON, class_model.LEXICON + class_model.TIED)
    unseen = np.bincount(m.classes[tied], weights=10 ** m.unit_log[tied], minlength=class_model.CLASSES + 1)[:-1]
    empty = np.arange(len(m.words), class_model.LEXICON)
    rest = np.bincount(m.classes[empty], weights=10 ** m.unit_log[empty], minlength=class_model.CLASSES + 1)[:-1]
    assert np.allclose(per_class + unseen + rest, 1)


def test_class_model_splits_texts_once_for_all_counting_passes(spark, sf, monkeypatch):
    coded = []
    real = class_model.unit_texts
    monkeypatch.setattr(class_model, "unit_texts", lambda *a: coded.append(1) or real(*a))
    class_model.fit(table(spark, sf, "documents"))
    assert coded == [1]


def test_context_counts_of_texts(spark):
    docs = spark.createDataFrame([("a b a",), ("",), ("b",)], "text string").repartition(2)
    ha, hb = (class_model.token_hashes(w)[0] for w in "ab")
    words = np.sort(np.array([ha, hb]))
    units = np.where(words == ha, 0, 1)
    classes = np.zeros(class_model.UNITS, dtype=np.int64)
    classes[1], classes[class_model.END_UNIT] = 5, class_model.END_CLASS
    left, right = class_model.context_counts(class_model.unit_texts(docs, words, units), classes)
    end, e = class_model.END_CLASS, class_model.END_UNIT
    assert {(u, c): left[u, c] for u, c in zip(*np.nonzero(left))} == {(0, end): 1, (0, 5): 1, (1, 0): 1, (1, end): 1, (e, 0): 1, (e, 5): 1, (e, end): 1}
    assert {(u, c): right[u, c] for u, c in zip(*np.nonzero(right))} == {(0, 5): 1, (0, end): 1, (1, 0): 1, (1, end): 1, (e, 0): 1, (e, 5): 1, (e, end): 1}


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    left, right = np.zeros((class_model.UNITS, class_model.CLASSES + 1)), np.zeros((class_model.UNITS, class_model.CLASSES + 1))
    kinds = rng.integers(0, 2, 60)
    left[:60] = np.where(kinds[:, None] == 0, 30, 1) * (np.arange(class_model.CLASSES + 1) == 3) + np.where(kinds[:, None] == 1, 30, 1) * (np.arange(class_model.CLASSES + 1) == 4)
    right[:60] = left[:60][:, ::-1]
    start = np.arange(class_model.UNITS) % class_model.CLASSES
    start[class_model.END_UNIT] = class_model.END_CLASS
    moved = class_model.exchange(class_model.exchange(start, left, right, 0), left, right, 1)
    assert len(set(moved[:60])) < len(set(start[:60]))


# ---- classifiers -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("module, label, accuracy", [(quality_classifier, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, accuracy):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = module.score(docs, module.fit(docs, labels))
    got = scored.filter("held_out").join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got[label]).mean() >= accuracy
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_labels_of_one_class_give_the_frequency(awkward, spark):
    labels = spark.createDataFrame([(1, 1), (5, 1), (9, None)], "doc_id long, quality int")
    got = quality_classifier.score(awkward, quality_classifier.fit(awkward, labels)).select("score").distinct().collect()
    assert len(got) == 1 and got[0].score > 0.5


# ---- line labels -----------------------------------------------------------------------------------------------------


def test_base_counts_of_line_rules(spark, sf, texts):
    got = line_labels.judge(table(spark, sf, "documents").select("doc_id", "text"), line_labels.fit(table(spark, sf, "documents"))).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        words = [w.decode() for w in t.encode().split()]
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if x.encode().split():
                dup += x in seen
                seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(2)
    for _ in range(50):
        e, t = rng.normal(size=rng.integers(1, 8)), rng.normal(size=(2, 2))
        value = lambda y: sum(e[i] * v for i, v in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(e)), key=value)
        assert math.isclose(value(line_labels.decode(e, t).astype(int)), value(best))


def test_field_outvotes_single_cues():
    cue, plain = 1 | 2 | 4 | 1 << 5, 1 | 2 | 4 | 8
    e, t = line_labels.train([np.array([plain] * 20), np.array([cue] * 20), np.array([plain] * 10 + [cue] * 10)])
    assert not line_labels.decode(line_labels.unpack(np.array([plain] * 9)) @ e, t).any()
    assert line_labels.decode(line_labels.unpack(np.array([cue] * 9)) @ e, t).all()


# ---- mixing ----------------------------------------------------------------------------------------------------------


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix_of_the_tables(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "text").collect()
    pieces, per = mixing.mix(table(spark, sf, "documents"), block_words=64)
    got = per.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    want = _targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 * 6
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(table(spark, sf, "documents"), block_words=64)[1].collect())
    slots = collections.Counter()
    for p in pieces.collect():
        slots[p.slot] += p.n_words
        assert p.n_words > 0
    assert max(slots.values()) <= 64 and sum(slots.values()) == sum(taken.values())


def _source_rows(sizes, words=40):
    """Documents of at most ``words`` words with the given number of words for each source."""
    rows = []
    for source, n in sizes.items():
        rows += [(len(rows) + i, " ".join(["w"] * min(words, n - at)), source) for i, at in enumerate(range(0, n, words))]
    return rows


@pytest.mark.parametrize("sizes", [{"a": 400, "b": 300, "c": 200}, {"a": 100, "b": 90_000, "c": 30_000, "d": 7, "e": 1}])
def test_mix_gives_every_source_its_target(spark, sizes):
    docs = spark.createDataFrame(_source_rows(sizes), "doc_id long, text string, source string")
    pieces, per = mixing.mix(docs)  # blocks as in production
    want, got, pieces = _targets(sizes), per.collect(), pieces.collect()
    for s in sizes:
        taken = sum(r.taken for r in got if r.source == s)
        assert taken > 0 and abs(taken - want[s]) <= 0.5, (s, taken, want[s])
    for r in got:
        assert r.taken <= 2 * r.size
    slots = collections.Counter()
    for p in pieces:
        slots[p.slot] += p.n_words
    assert sorted(slots) == list(range(len(slots))) and max(slots.values()) <= mixing.BLOCK_WORDS
    # any beginning of the schedule holds every source near its share: each is within two blocks of it
    source_of = {r.doc_id: r.source for r in got}
    so_far, total, by_slot = collections.Counter(), sum(want.values()), collections.defaultdict(list)
    for p in pieces:
        by_slot[p.slot].append(p)
    for slot in sorted(by_slot):
        for p in by_slot[slot]:
            so_far[source_of[p.doc_id]] += p.n_words
        if slot % 16 == 0:
            part = sum(so_far.values()) / total
            assert all(abs(so_far[s] - part * want[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)
    # what is mixed keeps documents of every source
    assert {r.source for r in mixing.mixed_documents(docs).collect()} == set(sizes)


# ---- licences --------------------------------------------------------------------------------------------------------


def test_licence_spellings(spark):
    mit = licences.KNOWN["MIT"]
    rows = [(1, "MIT-like header (c) 2020 Jo\n" + mit), (2, "Copyright (c) 2001 Jo Doe\nAll rights reserved.\n\n" + mit.upper().replace(" ", "  \n ")), (3, "Text before.\nLicensed under the Apache Licence, v2.0\nText after."), (4, mit + " Not quite."), (5, None)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_digests(spark)).collect()}
    assert got[2].licence == "MIT" and got[1].licence is None and "MIT" in got[1].line_licences
    assert got[3].line_licences == "Apache-2.0 notice" and got[3].n_licence_lines == 1
    assert got[4].licence is None and got[5].digest is None


# ---- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, texts):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    mixed = corpus_pipeline.run(spark, sf)
    assert mixed.columns[: len(columns)] == columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = session.materialize(stage(spark, docs, sf), "stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "line dedup":
            gone = _brute_runs(list(before.items()), 50)
            assert set(after) == set(before)
            assert all(after[i] == "\n".join(x for k, x in enumerate(before[i].split("\n")) if k not in set(gone[i])) for i in before)
        elif name == "near-duplicates":
            sets = {i: set(shingle_hashes(token_hashes(t or "")).tolist()) for i, t in after.items()}
            for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
                both = len(sets[a] & sets[b])
                assert 100 * both < 75 * (len(sets[a]) + len(sets[b]) - both)
        else:
            assert all(after[i] == before[i] for i in after)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.mix(docs)[1].filter("taken > 0").collect())


def test_pipeline_stages_on_awkward_rows(spark, awkward, sf):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES:
        docs = session.materialize(stage(spark, docs, sf), "stage")
        assert stage(spark, docs.limit(0), sf).count() == 0


# ---- schedule of the mix, identity of near-duplicates ----------------------------------------------------------------


def test_slots_follow_golden_points(spark):
    """Every slot's source is the one whose stretch of the cumulative block counts holds its point; amounts are exact."""
    quotas = {0: 40_000, 1: 100, 2: 9_000, 3: 1, 4: 700}
    named = spark.createDataFrame([(k, float(v)) for k, v in quotas.items()], "source_no long, target double")
    got = sorted(mixing.schedule(named).collect())
    blocks = {k: -(-v // mixing.BLOCK_WORDS) for k, v in quotas.items()}
    n, want, done, i = sum(blocks.values()), [], collections.Counter(), 0
    edges = list(itertools.accumulate(blocks.values()))
    while len(want) < n:
        i += 1
        cell = int(i * mixing.GOLDEN % 1.0 * n)
        source = next(k for k, e in enumerate(edges) if cell < e)
        if done[source] < blocks[source]:
            want.append((len(want), source, done[source]))
            done[source] += 1
    assert [(r.slot, r.source_no, r.block) for r in got] == want
    words = collections.Counter()
    for r in got:
        words[r.source_no] += r.words
    assert words == quotas


def test_mix_keeps_columns_with_awkward_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, 8), (1, "a b c", "s", 7, 8)], "doc_id long, text string, source string, copy int, `a.b` int")
    got = mixing.mixed_documents(docs)
    assert got.columns[:5] == docs.columns and {(r["copy"], r["a.b"]) for r in got.collect()} == {(7, 8)}


def test_near_duplicates_judge_texts_of_one_id_apart(spark):
    a, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [("a1", a), ("a1", other), ("a2", a + " end"), ("a2", a + " end"), (None, other), ("e", None), ("e", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id or "", r.n_shingles, r.component_id, r.kept) for r in near_duplicates.classes(docs).collect())
    assert got == sorted([("a1", 56, "a1", True), ("a1", 56, "a1", True), ("a2", 57, "a1", False), ("a2", 57, "a1", False), ("", 56, "a1", False), ("e", 0, "e", True), ("e", 0, "e", True)])
    left = sorted(((r.doc_id, r.text) for r in near_duplicates.keep_one(docs).collect()), key=str)
    assert left == sorted([("a1", a), ("a1", other), ("e", None), ("e", None)], key=str)


def test_written_tables_are_counted_without_a_job(spark):
    work = near_duplicates.Scratch(spark, "counts")
    some, none = work.put(spark.range(7).repartition(3), "some"), work.put(spark.range(7).filter("id < 0"), "none")
    group, jobs = "counting", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert (work.count(some), work.count(none)) == (7, 0) == (some.filter("true").count(), 0)
        made = len(jobs.getJobIdsForGroup(group))
        assert (work.count(some), work.count(none)) == (7, 0)
        assert len(jobs.getJobIdsForGroup(group)) == made
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_mixed_nodes_of_few_and_of_many_rows(spark, monkeypatch):
    """Few rows meet once, by node; many take the way that deals heavy nodes to parts. Both find the same."""
    rows = [(n, a, a % c) for n, size, c in ((1, 5, 1), (2, 6, 2), (-3, 1, 1), (2**60, 9, 4)) for a in range(size)]
    df = spark.createDataFrame(rows, "node long, a long, c long").repartition(3)
    few = near_duplicates._mixed(df, len(rows))
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(near_duplicates, "MANY", 0)
    many = near_duplicates._mixed(df, len(rows))
    names = ["node", "a", "c", "size", "centre"]
    assert few.columns == names
    got = sorted(map(tuple, few.collect()))
    assert got == sorted(map(tuple, many.select(names).collect()))
    assert {(r[0], r[3]) for r in got} == {(2, 6), (2**60, 9)}


def test_components_of_few_and_of_many_links(spark, monkeypatch):
    """A long chain, a star, a ring and repeated links: one task and rounds of joins give the same components."""
    links = [(i + 1, i) for i in range(60)] + [(100, 200 + i) for i in range(40)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(-5, -7), (-5, -7), (400, 400)]
    want = {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 240)]} | {i: 300 for i in range(300, 309)} | {-5: -7, -7: -7, 400: 400}
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    for few in (len(links), 0):
        monkeypatch.setattr(near_duplicates, "FEW", few)
        work = near_duplicates.Scratch(spark, "links")
        assert {r.a: r.c for r in near_duplicates.components(df, work, len(links))[0].collect()} == want


def test_small_nodes_are_linked_on_full_sets():
    """Links of nodes that are cut over batches give the components of all pairs at the threshold."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for node in range(-3, 4):
        base = rng.choice(2**62, 60, replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 60), replace=False), rng.choice(2**62, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(25)]
        comp = {a: a for a in range(25)} | {3: 1}
        for a in range(25):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    lo, hi = sorted((comp[a], comp[b]))
                    comp = {k: lo if v == hi else v for k, v in comp.items()}
        want[node] = comp
        rows += [(node, a + 100 * node, (1 if a == 3 else a) + 100 * node, sets[a].tobytes()) for a in range(25)]
    for size in (1, 7, 25, 60, 1000):
        batches = [pa.table(dict(zip("node a c s".split(), map(list, zip(*rows[i : i + size]))))) for i in range(0, len(rows), size)]
        links = [p for out in near_duplicates._within(iter([{n: b.column(n).combine_chunks() for n in b.column_names} for b in batches])) for p in zip(out["a"], out["b"])]
        for node, comp in want.items():
            got = {a: a for a in range(25)} | {3: 1}
            for a, b in links:
                if a // 100 == node:
                    lo, hi = sorted((got[a % 100], got[b % 100]))
                    assert lo != hi  # a forest
                    got = {k: lo if v == hi else v for k, v in got.items()}
            groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
            assert groups(got) == groups(comp)


def test_a_crowd_below_the_threshold_takes_few_steps(spark, monkeypatch):
    """Documents that share half their words met level after level; as one small node they are compared in one step."""
    common = " ".join(f"c{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{common} " + " ".join(f"w{i}x{j}" for j in range(18 + i % 3))) for i in range(150)], "doc_id long, text string")
    steps, put = [], near_duplicates.Scratch.put
    monkeypatch.setattr(near_duplicates.Scratch, "put", lambda self, df, name: steps.append(name) or put(self, df, name))
    assert sum(r.kept for r in near_duplicates.classes(docs).collect()) == 150
    assert len(steps) < 20, steps


def test_personal_data_learns_from_all_candidates(spark, monkeypatch):
    text = " ".join(f"mail a{i}@site{i}.org" for i in range(700)) + " " + " ".join(f"host 10.0.{i}.999" for i in range(100))
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("x "), F.lit(text)).alias("text"))
    sizes, keep = [], personal_data.stored
    monkeypatch.setattr(personal_data, "stored", lambda df, name: sizes.append(keep(df, name)) or sizes[-1])
    assert personal_data.fit(personal_data.candidates(docs)) is not None
    assert sizes[0].count() == 30 * 800


def test_members_of_nodes_are_made_once(spark, monkeypatch):
    """Many rows of nodes, and few: no step repeats the pass over the sets that deals them to their trees."""
    sets = spark.createDataFrame([(a, 1, [a // 2 % 5] * near_duplicates.COORDINATES) for a in range(20)], "a long, copies long, sig array<int>").repartition(2)
    put, found = near_duplicates.Scratch.put, []
    for many in (10**6, 0):
        plans = []
        with monkeypatch.context() as m:
            m.setattr(near_duplicates, "MANY", many)
            m.setattr(near_duplicates.Scratch, "put", lambda self, df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or put(self, df, name))
            join = near_duplicates._Join(sets, sets, near_duplicates.Scratch(spark, "once"))
            nodes, crowded = join.mixed(near_duplicates._first_nodes(sets, 0, 3), 60, "nodes")
            assert sum(p.count("Generate explode(transform(") for p in plans) == 1
        found.append(sorted(map(tuple, nodes.select("node", "a", "c", "size", "centre").collect())))
        assert crowded == 0 and len(found[-1]) == 60
    assert found[0] == found[1]


def test_few_links_are_merged_in_one_step(spark, monkeypatch):
    """Steps of few links wrote three tables each; they add the same components as steps of many."""
    steps, put = [], near_duplicates.Scratch.put
    monkeypatch.setattr(near_duplicates.Scratch, "put", lambda self, df, name: steps.append(name) or put(self, df, name))
    sets = spark.createDataFrame([(i, 1) for i in range(9)], "a long, copies long")
    rounds = [[(5, 4), (4, 3), (5, 3)], [(8, 7)], [(3, 8), (2, 2)]]
    want = [{3: 3, 4: 3, 5: 3}, {3: 3, 4: 3, 5: 3, 7: 7, 8: 7}, {2: 2, 3: 3, 4: 3, 5: 3, 7: 3, 8: 3}]
    for few in (100, 0):
        monkeypatch.setattr(near_duplicates, "FEW", few)
        join = near_duplicates._Join(sets, sets, near_duplicates.Scratch(spark, "merge"))
        for links, comp in zip(rounds, want):
            steps.clear()
            join.merge(spark.createDataFrame(links, "a long, b long").repartition(3), len(links))
            assert {r.a: r.c for r in join.comp.collect()} == comp
            assert not few or steps == ["components"]
