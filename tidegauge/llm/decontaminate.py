"""Benchmark decontamination: n-gram windows of benchmark items, found in documents by a broadcast hash set.

Everything runs inside Spark SQL. A document is split into words once; every window of ten words is hashed and probes a
broadcast table of the benchmark's windows, and only a window with an equal hash is compared word by word. Windows that
match leave the map side; the rest never moves. The documents themselves are not shuffled to find hits.

Defined results: a null or empty text has no words, no hits and is clean. An item without words never matches; an item
shorter than the window is one window of its own length. Rows that repeat an id and its text each get their own equal
result row; rows that share only the id are judged apart. A null item id marks words but is not counted or listed.
Other columns of either table are ignored. Empty tables give empty or all-clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ID, KEY, lean, plain_words, stored, text_key, text_of

WINDOW = 10
#: Windows of the benchmark that are broadcast at most (about 250 bytes each); with more, hashes are joined by a shuffle.
MAX_BROADCAST = 200_000


def benchmark_windows(items: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(gram_id, h, gram, width) of every distinct window, and (gram_id, item_id) of the items that have it."""
    w = lean(items, "item_id", "text").select("item_id", plain_words(text_of()).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.lit(n), F.size("w"))
    grams = w.select("item_id", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.slice("w", i + 1, width))).alias("gram"))
    # written once, so that the generated ids are the same wherever they are read
    named = stored(grams.select("gram").distinct().select(F.monotonically_increasing_id().alias("gram_id"), F.xxhash64("gram").alias("h"), "gram", F.size("gram").alias("width")), "windows")
    owners = grams.join(named.select("gram_id", "gram"), "gram").select("gram_id", "item_id").distinct()
    return named, owners


def _split(docs: DataFrame) -> DataFrame:
    return lean(docs, ID, "text").select(ID, text_key().alias(KEY), plain_words(text_of()).alias("w"))


def _probes(words: DataFrame, widths: list[int]) -> DataFrame:
    """One row per window and, at position 0, one row for the document itself: pos, h and from them start and width."""
    size = F.size("w")
    count = {k: F.greatest(size - (k - 1), F.lit(0)) for k in widths}

    def hashes_of(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), size - k), lambda i: F.xxhash64(F.slice("w", i + 1, k)))
        return F.when(size >= k, each).otherwise(F.array().cast("array<bigint>"))

    laid = words.select("*", size.cast("long").alias("n_words"), F.concat(F.array(F.lit(None).cast("long")), *[hashes_of(k) for k in widths]).alias("hs"))
    # the outer form: the plain one adds a filter on its array, which would be computed a second time, from the text, for each window
    rows = laid.select(ID, KEY, "w", "n_words", F.posexplode_outer("hs").alias("pos", "h"))
    start, width, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for k in widths:
        inside = (F.col("pos") >= before) & (F.col("pos") < before + count[k])
        start, width = F.when(inside, F.col("pos") - before).otherwise(start), F.when(inside, F.lit(k)).otherwise(width)
        before = before + count[k]
    return rows.select(ID, KEY, "w", "n_words", "pos", "h", start.alias("start"), width.alias("width"))


def find(docs: DataFrame, windows: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, key, n_words, start, width, gram_id): verified hits, and for every document one row with a null start."""
    stats = windows.agg(F.collect_set("width").alias("w"), F.count("*").alias("n")).first()  # at most WINDOW widths
    widths = sorted(stats["w"] or [], reverse=True)
    words = _split(docs)
    rows = _probes(words, widths)
    known = windows.select("gram_id", F.col("h").alias("known_h"), "gram", F.col("width").alias("known_width"))
    out = [ID, KEY, "n_words", "start", "width", "gram_id"]
    if stats["n"] <= max_broadcast:
        probed = rows.join(F.broadcast(known), F.col("h") == F.col("known_h"), "left")
        # the words are compared for equal hashes only: as part of the join key they would be copied for every window
        return probed.filter((F.col("pos") == 0) | (F.col("gram") == F.slice("w", F.col("start") + 1, F.col("width")))).select(*out)
    # too many for a broadcast: move hashes only, then fetch the words of the documents that have candidates
    found = rows.filter("pos > 0").select(ID, KEY, "n_words", "start", "width", "h").join(known, (F.col("h") == F.col("known_h")) & (F.col("width") == F.col("known_width")))
    again = words.dropDuplicates([ID, KEY]).select(F.col(ID).alias("__id"), F.col(KEY).alias("__key"), "w")
    hits = found.join(again, F.col(ID).eqNullSafe(F.col("__id")) & (F.col(KEY) == F.col("__key"))).filter(F.col("gram") == F.slice("w", F.col("start") + 1, F.col("width")))
    alone = words.select(ID, KEY, F.size("w").cast("long").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("long").alias("gram_id"))
    return alone.unionByName(hits.select(*out))


def _union(spans: Column) -> Column:
    """Merged (first, last) word ranges of sorted spans with a start and a width; last is exclusive."""
    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        end = x["start"] + x["width"]
        return F.when((F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["last"] >= x["start"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], end).alias("last"))))
                      ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("first"), end.alias("last")))))

    return F.aggregate(spans, F.array().cast("array<struct<first:int,last:int>>"), add)


def _covered(spans: Column) -> Column:
    """Number of words inside at least one span; the spans are sorted."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["start"] + x["width"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], x["start"])).alias("n"), end.alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"].cast("long"))


def report(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items_sha256, contaminated, the merged hit ranges and the text key."""
    windows, owners = benchmark_windows(items, n)
    hits = find(docs, windows, max_broadcast)
    per_doc = hits.groupBy(ID, KEY).agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("start").isNull(), 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "width")))).alias("spans"),
        F.collect_set("gram_id").alias("grams"),
    )
    per_doc = stored(per_doc, "hits")
    item_rows = per_doc.filter(F.size("grams") > 0).select(ID, KEY, F.explode("grams").alias("gram_id")).join(owners, "gram_id").select(F.col(ID).alias("__id"), F.col(KEY).alias("__key"), F.col("item_id").cast("string").alias("item"))
    named = item_rows.groupBy("__id", "__key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = per_doc.join(named, F.col(ID).eqNullSafe(F.col("__id")) & (F.col(KEY) == F.col("__key")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = _covered(F.col("spans"))
    full = joined.select(
        ID, KEY, "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        _union(F.col("spans")).alias("ranges"), "copies",
    )
    return full.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def remove_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents without any hit, columns as they came."""
    bad = report(docs, items, n).filter("contaminated").select(F.col(ID).alias("__id"), F.col(KEY).alias("__key")).distinct()
    return docs.join(bad, F.col(ID).eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """All documents; words inside a hit are cut out together with what stands before them up to the last word."""
    bad = report(docs, items, n).filter("contaminated").groupBy(F.col(ID).alias("__id"), F.col(KEY).alias("__key")).agg(F.first("ranges").alias("__ranges"))
    joined = docs.join(bad, F.col(ID).eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(text_of(), F.lit(gap + word), F.lit(0))
    tail = F.regexp_extract(text_of(), gap + r"\z", 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists("__ranges", lambda r: (i >= r["first"]) & (i < r["last"])))
    return joined.withColumn("text", F.when(F.col("__ranges").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))).select(*[f"`{c}`" for c in docs.columns])
