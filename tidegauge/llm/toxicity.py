"""Toxicity: a linear classifier over character n-gram indicators scaled by naive Bayes log-count ratios (see ``nbsvm``).

Features of a text: its runs of three, four and five characters, A-Z lower-cased, as indicators in hash buckets. Neither
the id nor any other column is a feature.

Defined results: as for the quality classifier: null and empty texts get the score of the bias, repeated rows equal
scores, and without labelled rows of both classes every score is the smoothed class frequency.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import nbsvm
from tidegauge.llm.common import ID, crc_mod, lean

LENGTHS = (3, 4, 5)


def featurise(text: str) -> np.ndarray:
    codes = nbsvm.code_points(text)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    return nbsvm.distinct(np.concatenate([nbsvm.character_ngrams(codes, n) for n in LENGTHS]))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = nbsvm.MAX_TRAIN) -> nbsvm.Model:
    return nbsvm.fit(docs, labels, "toxic", crc_mod(5) != 0, featurise, max_train)


def score(docs: DataFrame, model: nbsvm.Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = nbsvm.score(lean(docs, ID, "text"), model, featurise)
    return scored.select(ID, (crc_mod(5) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
