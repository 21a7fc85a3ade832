"""Line dedup: a suffix array over sequences of line ids, built by distributed prefix doubling.

The lines with words of each document, in order, are one sequence of line ids. Lines that occur once in the corpus can
be in no repeated run; they end the stretches that are sorted. Doubling: the rank of a suffix by its first 2k lines is
the place of the pair (rank by k lines, rank by k lines k further on) among all sorted pairs; ranks come from counts of
distinct pairs summed along their order in buckets, so no task sorts everything and a very common line is spread out.

An interval of the suffix array with a longest common prefix of r lines holds exactly the suffixes that agree in r
lines, and two ranks at depth 2^k <= r that cover the r lines name it. For every line the shortest run that begins there
and the shortest that ends there with at least ``min_words`` words are looked up: if the earliest member of its interval
stands before, the run is a later copy. The union of these runs is the union of all maximal repeated runs with that many
words, without their first copies. A run of ``min_words`` words has at most that many lines, which bounds the doubling.

Earlier means a smaller doc_id (null first), then a smaller text key, then the line number. Every deleted line has an
equal line that stays earlier.

Defined results: null and empty texts have no lines with words and stay as they are; blank lines are neither compared
nor deleted; lines are compared exactly but for white space at their ends; rows that repeat an id and its text are
copies of one sequence and all get that sequence's result; a repeated run may overlap its own first copy. Extra columns
are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions import ordered
from tidegauge.llm.common import ID, KEY, SPACED_WORD, lean, stored, text_key, text_of

MIN_WORDS = 50
_DOC = [ID, KEY]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line, h, words): the lines with words of each distinct row."""
    parts = F.transform(F.split(text_of(), "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")))
    # the outer form: the plain one would add a filter that splits every text a second time
    rows = lean(docs, ID, "text").select(ID, text_key().alias(KEY), F.posexplode_outer(parts).alias("line", "value"))
    words = F.size(F.regexp_extract_all("value", F.lit(SPACED_WORD), F.lit(0)))
    return rows.filter(F.length("value") > 0).select(ID, KEY, "line", F.xxhash64("value", F.length("value")).alias("h"), words.alias("words"))


def _places(counts: DataFrame, by: list[str], levels: list[Column]) -> DataFrame:
    """Adds ``rank``: 1 and the number of suffixes whose key sorts before; ``counts`` has one row for each key and n."""
    named = counts.select("*", *[c.alias(f"__l{i}") for i, c in enumerate(levels)])
    order = [F.col(c) for c in by]
    summed = ordered.running_sums(named, [], [f"__l{i}" for i in range(len(levels))], order, {"upto": "n"})
    return summed.select(*by, (F.col("upto") - F.col("n") + 1).alias("rank"))


def _within(stretch: list[str]):
    return Window.partitionBy(*stretch).orderBy("i")


def suffix_ranks(docs: DataFrame, depth: int) -> DataFrame:
    """Rows of repeated lines: doc_id, key, stretch, i (place in the sequence), line, words, r0, r1, ... by 2^level lines.

    The suffixes of a stretch end with it. ``depth``: the number of lines up to which runs are told apart.
    """
    lines = stored(_lines(docs).dropDuplicates([*_DOC, "line"]), "lines")
    counts = lines.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    first = _places(counts, ["h"], [F.shiftright("h", 48)])
    order = Window.partitionBy(*_DOC).orderBy("line")
    # numbered before the unique lines go, so that a step in i - number marks where one stood
    numbered = lines.withColumn("i", F.row_number().over(order)).join(first.withColumnRenamed("rank", "r0"), "h").drop("h")
    numbered = numbered.withColumn("stretch", F.col("i") - F.row_number().over(order))
    ranks = stored(numbered, "ranks")
    level, names = 0, [*_DOC, "stretch"]
    while 2 << level <= depth:
        pair = ranks.withColumn("next", F.coalesce(F.lead(f"r{level}", 1 << level).over(_within(names)), F.lit(0).cast("long")))
        counts = pair.groupBy(f"r{level}", "next").agg(F.count("*").alias("n"))
        placed = _places(counts, [f"r{level}", "next"], [F.shiftright(f"r{level}", 12), F.shiftright("next", 12)])
        ranks = stored(pair.join(placed.withColumnRenamed("rank", f"r{level + 1}"), [f"r{level}", "next"]).drop("next"), "ranks")
        level += 1
    return ranks


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, first, last): runs of lines with at least ``min_words`` words that occur earlier; ends inclusive."""
    ranks = suffix_ranks(docs, min_words)
    top = max(int(c[1:]) for c in ranks.columns if c[0] == "r" and c[1:].isdigit())
    names = [*_DOC, "stretch"]
    here = _within(names)
    total = F.sum("words").over(here.rowsBetween(Window.unboundedPreceding, 0))
    rows = ranks.select(*names, "i", "line", "words", *[f"r{k}" for k in range(top + 1)], total.alias("upto"))
    # a run of min_words words has at most min_words lines: the frame holds its other end
    ahead = here.rowsBetween(0, min_words - 1)
    behind = here.rowsBetween(-(min_words - 1), 0)
    sums = rows.withColumn("ahead", F.collect_list("upto").over(ahead)).withColumn("before", F.collect_list(F.col("upto") - F.col("words")).over(behind))
    forward = F.size(F.filter("ahead", lambda u: u - F.col("upto") + F.col("words") < min_words)) + 1
    backward = F.size(F.filter("before", lambda u: F.col("upto") - u < min_words)) + 1
    sums = sums.withColumn("f", F.when(forward <= F.size("ahead"), forward)).withColumn("b", F.when(backward <= F.size("before"), backward))
    ends = sums.select(*names, "i", F.explode(F.array(F.struct(F.col("i").alias("s"), F.col("f").alias("r")), F.struct((F.col("i") - F.col("b") + 1).alias("s"), F.col("b").alias("r")))).alias("x"))
    runs = ends.filter("x.r is not null").select(*names, "x.s", "x.r").distinct()
    runs = runs.withColumn("k", F.floor(F.log2(F.col("r").cast("double")) + 1e-9).cast("int"))
    at = F.array(*[f"r{k}" for k in range(top + 1)])
    named = ranks.select(*names, "i", "line", at.alias("rs"))
    start = named.select(*names, F.col("i").alias("s"), F.col("line").alias("first"), F.col("rs").alias("rs1"))
    second = named.select(*names, F.col("i").alias("m"), F.col("rs").alias("rs2"))
    final = named.select(*names, F.col("i").alias("e"), F.col("line").alias("last"))
    power = F.pow(F.lit(2.0), F.col("k")).cast("int")
    runs = runs.withColumn("m", F.col("s") + F.col("r") - power).withColumn("e", F.col("s") + F.col("r") - 1)
    on = lambda left, right, c: _match(left, right, names, c)
    found = on(on(on(runs, start, "s"), second, "m"), final, "e")
    found = found.select(*_DOC, "first", "last", "r", F.element_at("rs1", F.col("k") + 1).alias("x"), F.element_at("rs2", F.col("k") + 1).alias("y"))
    earliest = found.groupBy("r", "x", "y").agg(F.min(F.struct(ID, KEY, "first")).alias("origin"), F.count("*").alias("members")).filter("members > 1").drop("members")
    later = found.join(earliest, ["r", "x", "y"]).filter(F.struct(ID, KEY, "first") != F.col("origin"))
    return later.select(*_DOC, "first", "last").distinct()


def _match(left: DataFrame, right: DataFrame, names: list[str], place: str) -> DataFrame:
    """Join on document, stretch and place, where a null id equals a null id."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in (*names, place) else F.col(c) for c in right.columns])
    on = F.col(ID).eqNullSafe(F.col(f"__{ID}"))
    for c in [*names[1:], place]:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return left.join(renamed, on).drop(*[f"__{c}" for c in (*names, place)])


def remove_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, the text without later copies, and ``__deleted``, the numbers of the lines cut out."""
    lines = repeated_runs(docs, min_words).select(*_DOC, F.explode(F.sequence("first", "last")).alias("line")).distinct()
    per = lines.groupBy(F.col(ID).alias("__id"), F.col(KEY).alias("__key")).agg(F.array_sort(F.collect_list("line")).alias("__deleted"))
    joined = docs.join(per, F.col(ID).eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left")
    parts = F.split(F.col("text"), "\n")
    # a run goes from its first to its last line; blank lines between them are not part of it
    goes = lambda x, i: F.array_contains("__deleted", i) & (F.length(F.trim(x, F.lit(" \t\r\x0b\x0c"))) > 0)
    kept = F.array_join(F.filter(parts, lambda x, i: ~goes(x, i)), "\n")
    full = F.array_compact(F.transform(parts, lambda x, i: F.when(goes(x, i), i)))
    own = [f"`{c}`" for c in docs.columns if c != "text"]
    out = joined.select(*own, F.when(F.col("__deleted").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("__deleted").isNull(), F.array().cast("array<int>")).otherwise(full).alias("__deleted"))
    return out.select(*[f"`{c}`" for c in docs.columns], "__deleted")
