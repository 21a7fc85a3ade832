"""Source divergence audit: how far the term use of each source lies from the other sources of its language.

Every document becomes an exact sparse count vector by ``CountVectorizer`` with ``minDF`` and the largest integer as
vocabulary size, so that no term is cut off. A vocabulary belongs to one lang: terms are written as lang, U+0000, term
(no term holds that character), which fits all langs at once, counts documents per lang and makes no job per lang.
``CountVectorizer`` sends its vocabulary to the driver and on to the tasks. So terms are dealt by their hash to as many
slices as keep a vocabulary near ``SLICE`` terms, and each slice is fitted and counted by itself: memory is bounded, and
since every sum is over terms the slices just add up. The number of slices comes from a count of frequent terms in one
64th of the term space and has no effect on results.

Group sums are sums of the sparse vectors per (lang, source), combined before the shuffle. With p and q as the smoothed
shares per thousand millions, a pair of sources is the sum of f over **all** kept terms of the lang. Where a source
lacks a term its share is one constant, so only occurring terms are looked at: with p0 and q0 for these constants,

    sum f(p, q) = V f(p0, q0) + sum over a's terms [f(p, q0) - f(p0, q0)] + sum over b's terms [f(p0, q) - f(p0, q0)]
                  + sum over shared terms [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)].

The middle sums need only how many terms have which count. f is symmetric, so a pair is worked out once. All numbers are
integers: long where the bound is known, decimals with 38 digits for the shares.

Defined results: null text, lang and source are empty strings; a row is a document, repeated rows count each time; a
group without terms still gets its pairs; a lang without kept terms has pair values 0 and no term rows; an empty table
has no rows. Further columns are not read. Ties are ranked by the item in UTF-8 order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.common import stored, text_of

MIN_DOCS = 10
TOP = 10
#: Terms in one vocabulary, about; more are worked on slice by slice.
SLICE = 1_000_000
_PROBES = 64
_MARK = "\x00"
#: Bytes of text split at once, unless one text has more.
CHUNK = 1 << 20


def _term_class() -> np.ndarray:
    """Byte to byte: letters A-Z lowered, and 0 for all that ends a term."""
    byte = np.arange(256, dtype=np.uint8)
    byte[65:91] += 32
    byte[:65] = byte[91:97] = byte[123:128] = 0
    return byte


_TERM_CLASS = _term_class()


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of many texts at once, each behind its lang; bytes from 128 up only occur inside terms."""
    for b in batches:
        lo = 0
        while lo < b.num_rows:
            text = b.column("text")
            at = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
            raw = _TERM_CLASS[np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[at[lo] : at[hi]]]
            edges = at[lo : hi + 1] - at[lo]
            inside = raw != 0
            before = np.zeros(len(raw) + 1, dtype=bool)
            before[1:] = inside
            before[edges] = False  # a text ends its last term
            starts = np.flatnonzero(inside & ~before[:-1])
            lists = np.searchsorted(starts, edges).astype(np.int32)
            place = np.concatenate([[0], np.cumsum(inside)])
            ends = np.append(place[starts], place[-1]).astype(np.int32)
            values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw[inside].tobytes()))
            rows = b.slice(lo, hi - lo)
            owner = pa.array(np.repeat(np.arange(hi - lo), np.diff(lists)))
            values = pc.binary_join_element_wise(rows.column("lang").take(owner), values, _MARK)
            yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("source"), pa.ListArray.from_arrays(pa.array(lists), values)], names=["lang", "source", "terms"])
            lo = hi


def _slices(tokens: DataFrame, min_docs: int, size: int) -> int:
    """Enough slices for the terms that occur ``min_docs`` times, of which the kept ones are a part."""
    term = tokens.select(F.explode("terms").alias("term")).filter(F.pmod(F.xxhash64("term"), F.lit(_PROBES)) == 0)
    return max(1, math.ceil(term.groupBy("term").count().filter(F.col("count") >= min_docs).count() * _PROBES / size))


def group_sums(docs: DataFrame, min_docs: int = MIN_DOCS, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """((lang, source) of every group, (lang, source, term, n) for kept terms that occur there)."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    raw = docs.select(lang.alias("lang"), source.alias("source"), text_of().alias("text"))
    tokens = stored(raw.mapInArrow(_terms, "lang string, source string, terms array<string>"), "terms")
    n_slices = _slices(tokens, min_docs, size)
    found = None
    for i in range(n_slices):
        part = tokens
        if n_slices > 1:
            part = tokens.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(n_slices)) == i))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=min_docs, vocabSize=2**31 - 1).fit(part)
        vocabulary = model.vocabulary
        if not vocabulary:
            continue
        vector = F.unwrap_udt("vector")
        entries = model.transform(part.select("source", "terms")).select("source", F.inline(F.arrays_zip(vector["indices"].alias("at"), vector["values"].alias("n"))))
        sums = entries.groupBy("source", "at").agg(F.sum("n").cast("long").alias("n"))
        # a term's place in the vocabulary stands for its lang too
        names = pd.DataFrame({"at": np.arange(len(vocabulary), dtype=np.int32), "name": vocabulary})
        named = sums.join(tokens.sparkSession.createDataFrame(names, "at int, name string"), "at")
        term = F.substring_index("name", _MARK, -1)
        lang_of = F.substring("name", F.lit(1), F.length("name") - F.length(term) - 1)
        sums = stored(named.select(lang_of.alias("lang"), "source", term.alias("term"), "n"), "sums")
        found = sums if found is None else found.unionByName(sums)
    if found is None:
        found = tokens.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    return tokens.select("lang", "source").distinct(), found


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(n) + F.lit(2).cast("decimal(1,0)"))
    return F.call_function("div", top, wide(total) + F.lit(2).cast("decimal(1,0)") * wide(v)) + 1


def distance(p: str | Column, q: str | Column) -> Column:
    """floor((p - q)^2 / (p + q)) in longs: shares are at most 10^9 + 1."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, size: int = SLICE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    groups, sums = group_sums(docs, min_docs, size)
    # one row for each kept term of a lang, with its count there
    terms = sums.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "total_lang"])
    rest = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))
    groups = stored(groups.withColumn("rest", rest), "groups")

    shares = sums.join(groups, ["lang", "source"]).join(terms, ["lang", "term"])
    shares = shares.select("lang", "source", "term", "n", "rest", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))
    shares = stored(shares, "shares")
    by_rank = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    part = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    term_rows = part.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("b"), F.col("rest").alias("rest_b"))
    pairs = groups.select("lang", F.col("source").alias("a"), F.col("rest").alias("rest_a"), "v").join(other, "lang").filter("a <> b")
    none = distance("rest_a", "rest_b")
    # how many terms of a have which share, against the constant of every other source
    levels = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("terms"))
    alone = levels.join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (distance("p", "rest_b") - none)).alias("alone"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("rest").alias("rest_a"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("rest").alias("rest_b"))
    extra = distance("pa", "pb") - distance("pa", "rest_b") - distance("rest_a", "pb") + none
    shared = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(extra).alias("shared"))
    turned = lambda df, name: df.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col(name).alias(f"{name}_b"))
    both = shared.select("lang", "a", "b", "shared").unionByName(shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    alone = stored(alone, "alone")
    on = ["lang", "a", "b"]
    value = F.coalesce(F.col("v") * none, F.lit(0)) + F.coalesce("alone", F.lit(0)) + F.coalesce("alone_b", F.lit(0)) + F.coalesce("shared", F.lit(0))
    joined = pairs.join(alone, on, "left").join(turned(alone, "alone"), on, "left").join(both, on, "left")
    pair_rows = joined.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value"))
    pair_rows = pair_rows.withColumn("rank", F.row_number().over(by_rank))
    return pair_rows.unionByName(term_rows)
