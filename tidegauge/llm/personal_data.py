"""Personal data by candidate gradient boosting.

Generators propose spans with much recall: for each kind (email, ip, card, phone) a strict pattern, whose matches are
checked by rule (octets, Luhn, number of digits), loose patterns (spelled-out addresses, national phone numbers, IPv6),
and windows: all stretches of whole digit groups inside a refused card or phone match, and of four groups inside a longer
dotted run, that pass the rule of their kind by themselves, overlapping ones too. Matches that pass the rule are the base
spans and always stay; a strict match or window that the rule refuses is refused for good. Loose candidates and windows
are decided by boosted trees over format and context: lengths, kinds of characters, groups, the words and characters around.
What the rules themselves look at (check digit, octet range, plus sign, the at sign) is not a feature; the trees learn
from candidates that the rules have judged, which makes them a second view, and they then judge those the rules cannot.
A threshold for each kind is calibrated on candidates kept out of the fit: the lowest score from which on the rules
agree with at least ``PRECISION``. Added spans never overlap base spans or better added ones.

Positions are code points, ends exclusive. Everything on the way is Spark SQL and Spark's own tree learner; a text's
matches and the pieces between them give all positions inside the row, without a shuffle. Patterns are possessive where
that changes nothing, so that long runs of digits or letters cost no backtracking or stack.

Defined results: null and empty texts have no spans; rows that repeat an id and its text get equal results; overlapping
spans of different kinds are all kept if base; without judged candidates of both sorts nothing is added. Other columns
are ignored (``redact`` carries them along).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.common import ID, KEY, lean, stored, text_key, text_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
MIN_CALIBRATION = 20
TREES, DEPTH = 10, 4

# Strict patterns (kind, quick test, pattern): the fixed base patterns, with possessive repeats.
STRICT = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"(?:[0-9][ -]?){12}[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
)
LOOSE = (
    ("email", r"(?i)[\[(]at[\])]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[a-z0-9-]++)++"),
    ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("phone", r"[0-9][) .-]+[0-9]{3}", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"),
)
# Windows (kind, quick test, pattern of the runs, digits, most groups): stretches of digit groups inside runs. Strict matches
# of card and phone are runs; for ip the runs are those that go on after four groups.
RUNS = (
    ("card", STRICT[2][1], STRICT[2][2], (13, 19), 19),
    ("phone", STRICT[3][1], STRICT[3][2], (9, 15), 15),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){4,}+", (4, 12), 4),
)
CONTEXT = {
    "near_mail": r"(?i)mail|contact|write|@", "near_phone": r"(?i)phone|tel|call|mobile|fax|cell", "near_card": r"(?i)card|visa|master|credit|debit|pay",
    "near_net": r"(?i)\bip\b|server|host|address|http|login", "near_version": r"(?i)version|\bv$|release|chapter|section|isbn|order|no\.? ?$",
}
FORMAT = ("n_chars", "n_digits", "n_letters", "n_spaces", "n_dots", "n_hyphens", "n_parens", "n_groups", "longest_group", "left_letter", "left_digit", "right_letter", "right_digit", "right_open")
FEATURES = (*FORMAT, *CONTEXT, *[f"is_{k}" for k in KINDS])
_CHUNK = 64


def _running(values: Column) -> Column:
    """Sums of what stands before each element."""
    zero = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["out"], F.array(acc["t"])).alias("out")), lambda acc: acc["out"])


def _before(values: Column) -> Column:
    """As ``_running``, in chunks, since appending to one array for all elements would take the square of their number."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: F.slice(values, c * _CHUNK + 1, _CHUNK))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(_running(sums), chunks, lambda b, c: F.transform(_running(c), lambda x: x + b)))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The base rule of a kind on a match of its strict pattern."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _windows(kind: str, digits: tuple[int, int], most: int, span: Column) -> Column:
    """Spans of whole digit groups inside the span of a run, without the run itself, that pass the rule of the kind."""
    groups = F.regexp_extract_all(span["value"], F.lit("[0-9]+"), F.lit(0))
    cut = F.struct(span["value"].alias("value"), groups.alias("groups"), F.split(span["value"], "[0-9]+", -1).alias("seps"))

    def placed(c: Column) -> Column:
        pairs = F.zip_with(c["seps"], c["groups"], lambda x, y: F.struct(x.alias("sep"), F.coalesce(y, F.lit("")).alias("group")))
        ends, digit_ends = _before(F.transform(pairs, lambda p: F.length(p["sep"]) + F.length(p["group"]))), _before(F.transform(pairs, lambda p: F.length(p["group"])))
        bounds = F.zip_with(ends, digit_ends, lambda at, d: F.struct(at.alias("at"), d.alias("d")))
        return F.struct(c["value"].alias("value"), F.zip_with(pairs, bounds, lambda p, b: F.struct(p["sep"].alias("sep"), p["group"].alias("group"), (b["at"] + F.length(p["sep"])).alias("from"), (b["at"] + F.length(p["sep"]) + F.length(p["group"])).alias("to"), b["d"].alias("d"))).alias("at"))

    def text(c: Column, first: Column, number: Column) -> Column:
        """Separators and groups from ``first`` on; taken from the pieces, since cutting a long run anew takes its length."""
        return F.array_join(F.transform(F.slice(c["at"], first + 1, number), lambda g: F.concat(g["sep"], g["group"])), "")

    def inside(c: Column) -> Column:
        n = F.size(c["at"]) - 1  # after the last group stands a separator, empty or not
        plus = lambda i: F.when(i == 0, F.length(c["at"][0]["sep"])).otherwise(0) if kind == "phone" else F.lit(0)

        def starting(i: Column) -> Column:
            ends = F.filter(F.sequence(i, F.least(i + most - 1, n - 1)), lambda j: (c["at"][j + 1]["d"] - c["at"][i]["d"]).between(*digits) & (j - i < n - 1) & (j - i == 3 if kind == "ip" else F.lit(True)))
            return F.transform(ends, lambda j: F.struct(i.alias("i"), j.alias("j"), (c["at"][i]["from"] - plus(i)).alias("from"), c["at"][j]["to"].alias("to")))

        fitting = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), starting))
        made = F.transform(fitting, lambda w: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (span["start"] + w["from"]).alias("start"), (span["start"] + w["to"]).alias("end"), F.lit(False).alias("base"), F.lit(False).alias("strict"),
            F.right(text(c, w["i"], w["j"] - w["i"] + 1), w["to"] - w["from"]).alias("value"),
            F.right(F.concat(span["left"], text(c, F.greatest(w["i"] - 24, F.lit(0)), F.least(w["i"], F.lit(24))), F.when(w["i"] > 0, c["at"][w["i"]]["sep"]).otherwise("")), F.lit(24)).alias("left"),
            F.left(F.concat(text(c, w["j"] + 1, F.lit(2)), span["right"]), F.lit(2)).alias("right"),
        ))
        return F.filter(made, lambda s: passes(kind, s["value"]))

    # one-element arrays: what is bound by a lambda is computed once
    return F.flatten(F.transform(F.transform(F.array(cut), placed), inside))


def _inside(kind: str, digits: tuple[int, int], most: int):
    return lambda span: _windows(kind, digits, most, span)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, found): all candidates of each row as structs kind, start, end, base, value, left, right."""
    generators = [(f"s{i}", k, q, p, True) for i, (k, q, p) in enumerate(STRICT)] + [(f"l{i}", k, q, p, False) for i, (k, q, p) in enumerate(LOOSE)]
    generators += [("r0", k, q, p, False) for k, q, p, *_ in RUNS if k == "ip"]
    rows = lean(docs, ID, "text").select(ID, text_key().alias(KEY), text_of().alias("text"))
    none = F.array().cast("array<string>")
    # one projection after the other: each pattern runs once on a text, and the later ones only where it matched
    matched = rows.select("*", *[F.when(F.col("text").rlike(q), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{g}") for g, _, q, p, _ in generators])
    pieces = matched.select("*", *[F.when(F.size(f"m_{g}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"p_{g}") for g, _, _, p, _ in generators]).drop("text")
    lengths = pieces.select("*", *[F.when(F.size(f"m_{g}") > 0, F.zip_with(f"p_{g}", f"m_{g}", lambda x, y: F.length(x) + F.coalesce(F.length(y), F.lit(0)))).otherwise(F.array().cast("array<int>")).alias(f"n_{g}") for g, *_ in generators])
    begins = lengths.select("*", *[F.when(F.size(f"m_{g}") > 0, _before(F.col(f"n_{g}"))).otherwise(F.array().cast("array<int>")).alias(f"b_{g}") for g, *_ in generators])

    def spans(g: str, kind: str, strict: bool) -> Column:
        def one(value: Column, i: Column) -> Column:
            piece, after = F.element_at(f"p_{g}", i + 1), F.element_at(f"p_{g}", i + 2)
            start = F.element_at(f"b_{g}", i + 1) + F.length(piece)
            base = passes(kind, value) if strict else F.lit(False)
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), base.alias("base"), F.lit(strict).alias("strict"), value.alias("value"), F.right(piece, F.lit(24)).alias("left"), F.left(after, F.lit(2)).alias("right"))

        return F.transform(f"m_{g}", one)

    parts = {g: spans(g, k, strict) for g, k, _, _, strict in generators}
    runs = {k: F.filter(parts[f"s{KINDS.index(k)}"], lambda s: ~s["base"]) for k in ("card", "phone")} | {"ip": parts.pop("r0")}
    inner = [F.flatten(F.transform(runs[k], _inside(k, d, m))) for k, _, _, d, m in RUNS]
    # single digits and short numbers are no candidates for a card
    every = F.concat(*parts.values(), *inner)
    useful = F.filter(every, lambda s: s["base"] | (F.length(F.regexp_replace(s["value"], "[^0-9A-Za-z]", "")) >= 7))
    return begins.select(ID, KEY, useful.alias("found"))


def _featured(rows: DataFrame) -> DataFrame:
    """One row for each candidate struct ``s`` with the columns of FEATURES."""
    v, left, right = F.col("s.value"), F.col("s.left"), F.col("s.right")
    groups = F.filter(F.split(v, "[^0-9A-Za-z]+"), lambda g: F.length(g) > 0)
    made = {
        "n_chars": F.length(v), "n_digits": _count(v, "[0-9]"), "n_letters": _count(v, "[A-Za-z]"), "n_spaces": _count(v, " "), "n_dots": _count(v, r"\."), "n_hyphens": _count(v, "-"), "n_parens": _count(v, "[()]"),
        "n_groups": F.size(groups), "longest_group": F.array_max(F.transform(groups, lambda g: F.length(g))), "left_letter": left.rlike("[A-Za-z]$").cast("int"), "left_digit": left.rlike("[0-9]$").cast("int"),
        "right_letter": right.rlike("^[A-Za-z]").cast("int"), "right_digit": right.rlike("^[0-9]").cast("int"), "right_open": right.rlike("^[-.:/][0-9A-Za-z]").cast("int"),
    }
    made |= {n: left.rlike(p).cast("int") for n, p in CONTEXT.items()} | {f"is_{k}": (F.col("s.kind") == i).cast("int") for i, k in enumerate(KINDS)}
    return rows.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in made.items()])


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_featured(rows))


def fit(found: DataFrame) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """Trees and a threshold for each kind, from all candidates of strict patterns; None if the rules judged all alike."""
    judged = found.select(F.explode_outer("found").alias("s")).filter("s.strict").select("s", F.col("s.base").cast("double").alias("label"))
    order = F.xxhash64("s.value", "s.left", "s.kind")
    every = stored(_assembled(judged.withColumn("h", order)).select("h", F.col("s.kind").alias("kind"), "label", "features"), "judged")
    training, kept = every.filter(F.pmod("h", F.lit(4)) != 0), every.filter(F.pmod("h", F.lit(4)) == 0)
    if training.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32).fit(training)
    p = vector_to_array("probability")[1]
    graded = model.transform(kept).select("kind", F.floor(p * 100).alias("grade"), "label").groupBy("kind", "grade").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    from_top = Window.partitionBy("kind").orderBy(F.col("grade").desc())  # at most 101 grades of a kind
    run = graded.select("kind", "grade", F.sum("good").over(from_top).alias("good"), F.sum("n").over(from_top).alias("n"))
    fine = run.filter((F.col("good") >= PRECISION * F.col("n")) & (F.col("n") >= MIN_CALIBRATION)).groupBy("kind").agg((F.min("grade") / 100).alias("threshold"))
    return model, {r["kind"]: r["threshold"] for r in fine.collect()}


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans): base spans and all spans of each row as sorted structs kind, start, end."""
    found = stored(candidates(docs), "candidates")
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda s: s["base"]), plain))
    own = found.select(ID, KEY, base.alias("base"))
    fitted = fit(found)
    if fitted is None or not fitted[1]:
        return own.withColumn("spans", F.col("base"))
    model, thresholds = fitted
    # judged already and overlapping ones go; loose candidates and windows are scored
    apart = lambda s: ~F.exists(F.filter("found", lambda b: b["base"]), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    open_ = found.select(ID, KEY, F.explode_outer(F.filter("found", lambda s: ~s["base"] & apart(s))).alias("s")).filter("s is not null")
    limit = F.element_at(F.array(*[F.lit(float(thresholds.get(i, 2.0))) for i in range(len(KINDS))]), F.col("s.kind") + 1)
    # a strict match that its rule refuses by number (octets, check digit) is refused for good
    scored = model.transform(_assembled(open_.filter("not s.strict"))).select(ID, KEY, "s", vector_to_array("probability")[1].alias("p")).filter(F.col("p") >= limit)
    chosen = scored.groupBy(F.col(ID).alias("__id"), F.col(KEY).alias("__key")).agg(F.sort_array(F.collect_set(F.struct("p", F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))), asc=False).alias("more"))
    clear = F.aggregate("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"), lambda acc, s: F.when(F.exists(acc, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), acc).otherwise(F.concat(acc, F.array(plain(s)))))
    joined = own.join(chosen, F.col(ID).eqNullSafe(F.col("__id")) & (F.col(KEY) == F.col("__key")), "left")
    return joined.select(ID, KEY, "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", clear))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, every span of the text replaced by its kind in brackets."""
    spans = detect(docs).filter(F.size("spans") > 0).groupBy(F.col(ID).alias("__id"), F.col(KEY).alias("__key")).agg(F.first("spans").alias("__spans"))
    joined = docs.join(spans, F.col(ID).eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    by_start = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    name = lambda s: F.element_at(F.array(*[F.lit(f"[{k}]") for k in KINDS]), s["kind"] + 1)
    def cut(acc: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], between, F.when(s["start"] >= acc["at"], name(s)).otherwise("")).alias("out"))

    text = F.aggregate(by_start, zero, cut, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text)).select(*[f"`{c}`" for c in docs.columns])
