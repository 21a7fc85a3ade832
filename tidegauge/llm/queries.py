"""The registered queries of the corpus operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import byte_repeats, class_model, decontaminate, licences, line_labels, line_runs, mixing, near_duplicates, periodic_runs, personal_data, quality_classifier, source_divergence, toxicity
from tidegauge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS gram
      FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, p.k, item_id FROM p JOIN g ON p.gram = g.gram AND p.k = g.k),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query(OP1_SQL)
def op1_decontaminate(spark, sf):
    r = decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query()
def op4_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf, "labels")))


@query()
def op10_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


# Words after lower-casing A-Z, sets of five-word shingles, all pairs at the threshold, and the smallest id reachable.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + k], ' ') AS g
      FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM e JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""


@query(OP6_SQL)
def op6_near_duplicates(spark, sf):
    return near_duplicates.classes(table(spark, sf, "documents"))


@query()
def op9_line_rules(spark, sf):
    docs = table(spark, sf, "documents")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    return line_labels.judge(docs.select("doc_id", "text"), line_labels.fit(docs)).select(*names)


@query()
def op8_mix_sources(spark, sf):
    per_doc = mixing.mix(table(spark, sf, "documents"))[1]
    return per_doc.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_line_runs(spark, sf):
    cleaned = line_runs.remove_runs(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.size("__deleted").cast("long").alias("n_deleted"), F.array_join("__deleted", ",").alias("deleted_lines"), "text")


def _canonical_sql(c: str) -> str:
    out = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace(regexp_replace({out}, '{licences.COPYRIGHT_LINE}', ' ', 'g'), '{licences.PUNCTUATION}', ' ', 'g')".replace("\\u00a9", "\u00a9")
    for spelling, to in licences.SPELLINGS:
        out = f"replace({out}, '{spelling}', '{to}')"
    return f"trim(regexp_replace({out}, '{licences.VERSION}', '\\1version \\2', 'g'), ' ')"


def _op5_sql() -> str:
    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licences.KNOWN.items())
    return f"""
WITH k AS (SELECT digest, string_agg(licence, ',' ORDER BY licence) AS licence FROM (SELECT DISTINCT sha256({_canonical_sql("text")}) AS digest, licence FROM (VALUES {known}) AS v(licence, text)) GROUP BY digest),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, {_canonical_sql("text")} AS form FROM d),
l AS (SELECT doc_id, {_canonical_sql("line")} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d WHERE contains(text, chr(10)))),
h AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ';' ORDER BY licence) AS names FROM l JOIN k ON sha256(form) = digest AND form <> '' GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, k.licence, coalesce(n, 0) AS n_licence_lines, coalesce(names, '') AS line_licences
FROM w LEFT JOIN k ON form <> '' AND sha256(form) = k.digest LEFT JOIN h USING (doc_id)
"""


@query(_op5_sql())
def op5_licences(spark, sf):
    return licences.scan(table(spark, sf, "documents"), licences.known_digests(spark))


@query()
def op2_personal_data(spark, sf):
    found = personal_data.detect(table(spark, sf, "documents"))
    base = F.col("base.kind")
    counts = [(F.size(base) - F.size(F.array_remove(base, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(personal_data.KINDS)]
    return found.select("doc_id", *counts, F.sha2(personal_data.written(F.col("base")), 256).alias("base_sha256"), personal_data.written(F.col("spans")).alias("spans"))


@query()
def op3_class_model(spark, sf):
    docs = table(spark, sf, "documents")
    return class_model.score(docs, *class_model.fit(docs))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_ JOIN v USING (lang)),
ql AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM ql JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
val AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN val USING (lang, source, item)
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 10
"""


@query(OP12_SQL)
def op12_source_divergence(spark, sf):
    return source_divergence.audit(table(spark, sf, "documents"))


@query()
def op13_periodic_runs(spark, sf):
    found = periodic_runs.find_runs(table(spark, sf, "documents").select("doc_id", "text"), periodic_runs.loop_of_id)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    written = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.call_function("div", F.lit(1000) * F.col("strongest.length"), F.col("strongest.period"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli.cast("long").alias("exponent_milli"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op11_byte_repeats(spark, sf):
    cleaned = byte_repeats.remove_repeats(table(spark, sf, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return cleaned.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
