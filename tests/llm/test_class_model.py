"""Every word of the class model has a class of its own, in the head and outside of it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import session
from tidegauge.llm import class_model
from tidegauge.llm.common import table


@pytest.fixture(scope="module", autouse=True)
def work_dir(spark):
    session.local_work_dir(spark)


def test_rare_words_with_one_ending_are_told_apart(spark, sf):
    m, counts = class_model.fit(table(spark, sf, "documents"))
    rare = counts.filter("tie >= 0").orderBy(F.col("n").desc(), "h").offset(4096).toPandas()
    units = class_model.units_of(rare["h"].to_numpy().view(np.uint64), rare["tie"].to_numpy(), m.words, m.word_unit)
    assert len(rare) > 10_000 and rare.assign(c=m.classes[units]).groupby("tie")["c"].nunique().mean() > 3


def test_words_move_to_the_class_that_fits_their_neighbours():
    table_, word = np.full((class_model.WIDTH, class_model.WIDTH), 5.0), np.zeros((2, class_model.WIDTH))
    for before, mine, after in ((1, 2, 3), (4, 6, 7)):
        table_[before, mine] = table_[mine, after] = 500
    left, right = word.copy(), word.copy()
    left[0, 1] = right[0, 3] = left[1, 4] = right[1, 7] = 2
    assert class_model.best_classes(table_, np.array([9, 9]), left, right).tolist() == [2, 6]
    assert class_model.best_classes(table_, np.array([2, 6]), left, right).tolist() == [2, 6]


@pytest.mark.parametrize("head", [class_model.HEAD, 300])
def test_score_is_the_sum_over_all_words(spark, sf, monkeypatch, head):
    monkeypatch.setattr(class_model, "HEAD", head)
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    m, counts = class_model.fit(docs)
    n = {r["h"]: r["n"] for r in counts.filter("tie >= 0").collect()}
    tails = {} if m.tails is None else {r["h"]: r["c"] for r in m.tails.collect()}
    assert len(tails) == max(0, len(n) - len(m.words)) and (head < 301) == bool(tails)
    ties = m.classes[class_model.LEXICON : class_model.LEXICON + class_model.TIED]
    room = m.room.copy()
    of = {int(np.int64(h.view(np.int64))): int(m.classes[u]) for h, u in zip(m.words, m.word_unit)} | tails
    # one for each word and each tie: all probabilities of a class add up to one
    every = np.bincount(ties, minlength=class_model.WIDTH) + np.bincount([of[h] for h in n], weights=[n[h] + 1 for h in n], minlength=class_model.WIDTH)
    assert np.allclose(every[:-1], room[:-1])
    for r in class_model.score(docs, m, counts).collect():
        h, tie = class_model.read(texts[r.doc_id])
        cls = [of.get(x, int(ties[t])) for x, t in zip(h.view(np.int64).tolist(), tie)]
        around = [class_model.END_CLASS, *cls, class_model.END_CLASS]
        want = sum(m.move[a, b] for a, b in zip(around, around[1:])) + sum(math.log10((n.get(x, 0) + 1) / room[c]) for x, c in zip(h.view(np.int64).tolist(), cls))
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.n_tokens == len(h) + 1
