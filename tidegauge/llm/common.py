"""Helpers that the corpus operators share: exact lower-casing, words, token hashes, row identity."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import materialize, new_path, shared_dir

stored = materialize

# The white space that separates words, and the characters of plain words: fixed values of the contracts.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ID = "doc_id"
KEY = "__text_key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables of one operator, below one folder of the work folder, that can be removed before the end.

    A table goes when what was made of it is written too, so a lost executor never needs one that is gone.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, new_path(spark, name)
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._rows: dict[int, int | None] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = (back, path)
        self._rows[id(back)] = seen.get.get("n")
        return back

    def count(self, table: DataFrame) -> int:
        """Rows of a table that is still there, as counted while it was written, without a job of its own."""
        n = self._rows[id(table)]
        return table.count() if n is None else n

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self._paths:
                _, path = self._paths.pop(id(t))
                self._rows.pop(id(t))
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def drop_all(self, but: DataFrame) -> None:
        self.drop(*[t for t, _ in list(self._paths.values()) if t is not but])


def text_of(c: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. A text of single bytes takes the fast way, which does the same for it."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def plain_words(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(c), F.lit(PLAIN_WORD), F.lit(0))


def text_key(c: str | Column = "text") -> Column:
    """Tells apart rows that carry one id and different texts; together with the id it names a row or its exact repeats."""
    c = F.col(c) if isinstance(c, str) else c
    return F.xxhash64(text_of(c), c.isNull())


def crc_mod(n: int, c: str | Column = ID) -> Column:
    """crc32 of the id written as text, modulo ``n``. A null id counts as an empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def lean(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns can neither clash nor travel."""
    return df.select(*[F.col(f"`{n}`") for n in names])


# ---- vectorised text work inside tasks -------------------------------------------------------------------------------

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """Powers of the odd multiplier (or of its inverse) modulo 2^64, grown as texts need them."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = np.full(size, _MULTIPLIER if which == "up" else _INVERSE, dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if size > 1 << 22:  # one enormous text must not leave its table behind
            return have
        _powers[which] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64-bit values, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs without white space."""
    edge = np.diff(_IS_SPACE[raw].astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def token_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for every word of a text, in order; equal words have equal hashes anywhere.

    The hash is a polynomial over the word's bytes modulo 2^64, taken as a difference of prefix sums, then mixed.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    start, end = token_spans(raw)
    if lower:
        raw = _LOWER[raw]
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", len(raw))[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", len(raw))[start] ^ (end - start).astype(np.uint64))


def shingle_hashes(tokens: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; a shorter text is one run, an empty one has none."""
    n = len(tokens)
    if n == 0:
        return tokens
    k = min(k, n)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + tokens[i : n - k + 1 + i]
    return np.unique(mix(h + np.uint64(k)))


def map_texts(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``fn`` over column batches (name to list) of each partition; Arrow moves them in both directions."""
    target = pa_schema(schema)

    def run(batches):
        for out in fn({n: b.column(n) for n in b.schema.names} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name] for f in target], schema=target)

    return df.mapInArrow(run, schema)


def pa_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def work_path(spark: SparkSession) -> str:
    return shared_dir(spark)


def append(df: DataFrame, fn: Callable[[list], dict], schema: str, column: str = "text") -> DataFrame:
    """All columns of ``df`` as they are, and further ones that ``fn`` makes from the values of one column.

    ``fn`` gets a list (nulls are None) and returns name to list or array. One pass, no shuffle; Arrow batches.
    """
    extra = T.StructType.fromDDL(schema)
    clash = {f.name for f in extra} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    target = pa_schema(schema)
    whole = T.StructType([*df.schema.fields, *extra.fields])

    def run(batches):
        for b in batches:
            out = fn(b.column(column).to_pylist())
            new = [pa.array(out[f.name], type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *target.names])

    return df.mapInArrow(run, whole)
