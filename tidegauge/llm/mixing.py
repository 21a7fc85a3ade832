"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end; the stream is cut into blocks of equal words and may
be read twice. A source gives its target, rounded to whole words and one word at least: so many blocks that they cover it,
the last one cut where the target ends. Golden-ratio points are mapped through the cumulative block counts of the sources,
and the rank of a point among those of its source is the number of the block that it takes, until every source has all its
blocks. Any stretch of the schedule then holds every source close to its share, and the amounts are exact. The mix is the
join of slots with blocks.

Targets: sources ordered by code point, null last, weigh 5, 2, 1 in turn and share 150 % of all words; a target stops at
twice its source's words, and what is left over is shared again by weight. This is min(cap, level * weight) for the one
level that uses all words up, found by sorting sources by cap / weight.

Ranks and running sums inside a source are taken in buckets (``functions.ordered``), so a source with a third of all
rows is spread over many tasks. The table of sources (one row each) is the only thing handled as a whole.

Defined results: a null text has size 0; null is a source of its own; sources without words have target 0; empty tables
give empty results; every row counts, also repeats of an id: the row number among equal rows tells them apart, and rows
that agree in id and text are interchangeable. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions import ordered
from tidegauge.llm.common import ID, KEY, append, lean, stored, text_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
BLOCK_WORDS = 512
GOLDEN = 0.6180339887498949
_SLOTS_PER_BUCKET = 65_536
_STRETCH = 4096
_PART = 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, size) of every row: one pass over the texts."""
    def count(texts: list) -> dict:
        return {"size": [len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]}

    counted = append(lean(docs, ID, "text", "source").withColumn(KEY, text_key()), count, "size long")
    return counted.select(ID, KEY, "source", "size")


def targets(sized: DataFrame) -> DataFrame:
    """(source_no, source, source_size, target) for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("source_no", number - 1).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * PASSES).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * SHARE - below) / open_weight)
    per = per.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), F.col("level").alias("l")))).over(everything)["l"])
    per = per.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
    return per.select("source_no", "source", "source_size", "target")


def golden_point(i: Column) -> Column:
    """frac(i * golden ratio). High and low part of i are multiplied apart, so that large numbers keep their fraction."""
    high, low = F.floor(i / _PART), i % _PART
    point = high * F.lit(_PART * GOLDEN % 1.0)
    point = point - F.floor(point) + low * F.lit(GOLDEN)
    return point - F.floor(point)


def schedule(named: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source_no, block, words): the block of each slot and how many of its words the mix takes.

    Point i is frac(i * golden); the source whose stretch of the cumulative block counts holds it gets the next block.
    Points go on until every source has all its blocks; points of sources that are done by then are left out and slots
    numbered anew. No gap between 2 n points is as long as 1 / n, so 2 n points do for n blocks; this is looked up, not
    trusted. Block numbers run on into the second reading. The words of a source add up to its rounded target.
    """
    open_ = named.filter("target > 0").select("source_no", F.greatest(F.round("target"), F.lit(1.0)).cast("long").alias("quota"))
    open_ = open_.withColumn("n_blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    # one row for each source: the only ordering of a whole table
    open_ = open_.withColumn("first_cell", F.sum("n_blocks").over(Window.orderBy("source_no")) - F.col("n_blocks"))
    n = open_.agg(F.sum("n_blocks")).first()[0] or 0
    parts = max(1, min(n // _SLOTS_PER_BUCKET + 1, 10_000))
    # the unit interval is n cells, each of one source; stretches of cells are dealt out before they become rows
    stretch = open_.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1, F.lit(_STRETCH).cast("long")))).repartition(parts)
    inside = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + _STRETCH, F.col("n_blocks")) - 1))
    cells = stretch.select("source_no", "quota", "n_blocks", "first_cell", inside.alias("nth")).withColumn("cell", F.col("first_cell") + F.col("nth")).drop("first_cell", "nth")
    spark = named.sparkSession
    last = 2 * n + 64 if n else 0
    while True:
        points = spark.range(1, last + 1, numPartitions=parts).withColumnRenamed("id", "i")
        points = points.withColumn("cell", F.least(F.floor(golden_point(F.col("i")) * n), F.lit(n - 1)).cast("long"))
        # cells are as many as blocks, but come from the few rows of open_: left to sizes, they would go through the driver
        placed = points.join(cells.hint("merge"), "cell").withColumn("bucket", F.floor(F.col("i") / _SLOTS_PER_BUCKET))
        placed = stored(placed.select("i", "bucket", "source_no", "quota", "n_blocks"), "placed")
        reached = placed.groupBy("source_no", "n_blocks").agg(F.count("*").alias("hits")).filter("hits >= n_blocks").count() if n else 0
        if reached == open_.count():
            break
        last *= 2
    ranks = ordered.ranked(placed, ["source_no"], ["bucket"], [F.col("i")], "nth").filter(F.col("nth") <= F.col("n_blocks"))
    blocks = ranks.select("i", "bucket", "source_no", "quota", (F.col("nth") - 1).cast("long").alias("block"))
    blocks = blocks.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("quota") - F.col("block") * block_words))
    slots = ordered.ranked(blocks, [], ["bucket"], [F.col("i")], "rank")
    return slots.select((F.col("rank") - 1).alias("slot"), "source_no", "block", "words", "i")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The pieces of the mix (slot, doc_id, key, first word, words) in schedule order, and one row for each document.

    A document row has doc_id, key, source, size, source_size, target and taken, the words that the mix takes of it.
    """
    sized = stored(sizes(docs), "sizes")
    named = stored(targets(sized), "targets")
    plan = stored(schedule(named, block_words), "schedule")
    h = ordered.hash60(ID, KEY, seed=seed)
    rows = sized.withColumn("h", h)
    grouped = rows.groupBy("source", "h", ID, KEY).agg(F.count("*").alias("copies"), F.first("size").alias("size"))
    single = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    keyed = single.join(named.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    keyed = keyed.withColumn("bucket", F.shiftright("h", 48).cast("long"))
    laid = stored(ordered.running_sums(keyed, ["source_no"], ["bucket"], [F.col("h"), F.col(ID), F.col(KEY), F.col("copy")], {"end": "size"}).withColumn("begin", F.col("end") - F.col("size")), "laid")
    # every reading of the stream: word b of reading p stands at p * source_size + b, and blocks run over the seam
    readings = laid.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))).withColumn("from", F.col("pass") * F.col("source_size") + F.col("begin"))
    first, last = F.floor(F.col("from") / block_words), F.floor((F.col("from") + F.col("size") - 1) / block_words)
    cut = readings.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest("from", F.col("block") * block_words)
    hi = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block_words)
    cut = cut.select("source_no", "block", ID, KEY, "h", "copy", "pass", (lo - F.col("from")).alias("first_word"), (lo - F.col("block") * block_words).alias("at"), (hi - lo).alias("n_words"))
    pieces = cut.join(plan, ["source_no", "block"]).withColumn("n_words", F.least("n_words", F.col("words") - F.col("at"))).filter("n_words > 0")
    taken = pieces.groupBy(*[F.col(c).alias(f"__{c}") for c in ("source_no", "h", ID, KEY, "copy")]).agg(F.sum("n_words").alias("taken"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("source_no", "h", ID, KEY, "copy")])
    per_doc = laid.join(taken, same, "left").select(ID, KEY, "source", "copy", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return pieces.select("slot", ID, KEY, "copy", "first_word", "n_words"), per_doc


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken besides their own columns.

    Of documents that repeat an id and text, each copy has its row, numbered by the order of the join. Own columns named
    size, source_size, target or taken give way to those of the mix.
    """
    per = mix(docs)[1].filter("taken > 0")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    numbered = docs.select(*own, text_key().alias(KEY)).withColumn("__nth", F.row_number().over(Window.partitionBy(ID, KEY, "source").orderBy(F.lit(1))))
    other = per.select(F.col(ID).alias("__id"), F.col(KEY).alias("__key"), F.col("source").alias("__source"), F.col("copy").alias("__copy"), "size", "source_size", "target", "taken")
    on = F.col(ID).eqNullSafe(F.col("__id")) & (F.col(KEY) == F.col("__key")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__nth") == F.col("__copy"))
    return numbered.join(other, on).select(*own, "size", "source_size", "target", "taken")
