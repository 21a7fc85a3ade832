"""Quality classifier: naive Bayes support vectors over word and character n-gram indicators (see ``nbsvm``).

Features of a text: its words and word pairs (A-Z lower-cased), whether a word follows itself, and its runs of three
characters, all as indicators in hash buckets. Neither the id nor any other column is a feature.

Defined results: null and empty texts have no indicators and get the score of the bias; repeated rows get equal scores;
labels other than 0 and 1 are ignored, and of conflicting labels of one id the larger counts; without labelled rows of
both classes every score is the smoothed class frequency (0.5 without any label). Other columns stay untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import nbsvm
from tidegauge.llm.common import ID, crc_mod, lean, mix, token_hashes


def featurise(text: str) -> np.ndarray:
    tokens = token_hashes(text)
    parts = [nbsvm.character_ngrams(nbsvm.code_points(text), 3), nbsvm.buckets(tokens)]
    if len(tokens) > 1:
        parts.append(nbsvm.buckets(mix(tokens[:-1] * np.uint64(3) + tokens[1:])))
        if (tokens[:-1] == tokens[1:]).any():
            parts.append(np.zeros(1, dtype=np.int32))
    return nbsvm.distinct(np.concatenate(parts))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = nbsvm.MAX_TRAIN) -> nbsvm.Model:
    return nbsvm.fit(docs, labels, "quality", crc_mod(3) != 1, featurise, max_train)


def score(docs: DataFrame, model: nbsvm.Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = nbsvm.score(lean(docs, ID, "text"), model, featurise)
    return scored.select(ID, (crc_mod(3) == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: nbsvm.Model) -> DataFrame:
    """The documents whose predicted label is 1, columns as they came."""
    return nbsvm.score(docs, model, featurise).filter("__score >= 0.5").drop("__score")
