"""Quality rules by line sequence labelling: a linear-chain conditional random field decoded by Viterbi.

Every line of a text is described by twelve yes/no features. The field has two labels, content and boilerplate, weights
for each feature and label, and weights for each pair of neighbouring labels. It is trained on stretches of lines from a
bounded sample of documents whose lines carry weak labels (cues: repeated lines, symbols, capitals, words that follow
themselves, menus); the transitions let the surroundings of a line outvote a weak cue. A document stays when at least
half of its words stand in lines that the decoding marks as content, and the base rules do not fail it.

Defined results: null and empty texts have no words and fail the base rule; a text without line breaks is one line;
repeated rows get equal results; other columns are ignored. Without any document to learn from, the weights are zero
but for the cues of ``PRIOR``, so that the decoding is defined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ID, _IS_SPACE, append, lean, mix, text_of, token_hashes, token_spans

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
CONTENT_SHARE = 0.5
#: Stretches of at most STRETCH lines from which the field is trained, one for each sampled document.
MAX_STRETCHES = 3_000
STRETCH = 64
FEATURES = ("always", "has a word", "eight words", "ends a sentence", "some symbols", "many symbols", "capitals", "digits", "words follow themselves", "earlier line again", "under three words", "menu bar", "marks in a row")
CUES = (5, 6, 8, 9, 11)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
PRIOR = np.array([-1.0 if i == 0 else 2.0 if i in CUES else 0.0 for i in range(len(FEATURES))])


def repeat_words(tokens: np.ndarray) -> int:
    """Words inside three-word windows that the text has at least twice."""
    n = len(tokens) - 2
    if n < 2:
        return 0
    h = mix((tokens[:n] * np.uint64(3) + tokens[1 : n + 1]) * np.uint64(0xD6E8FEB86659FD93) + tokens[2:])
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == h)
    mark = np.zeros(len(tokens), dtype=bool)
    for i in range(3):
        mark[hit + i] = True
    return int(mark.sum())


def describe(text: str) -> tuple[dict, np.ndarray, np.ndarray]:
    """Base counts, a bit set of features for each line, and the words of each line."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    lines = text.split("\n")
    if not len(raw):
        return {"n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0}, np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int64)
    tokens = token_hashes(text, lower=False)
    starts, _ = token_spans(raw)
    breaks = np.flatnonzero(raw == 10)
    begin = np.concatenate(([0], breaks + 1))
    end = np.concatenate((breaks, [len(raw)]))

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[end] - sums[begin]

    words = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    follows = np.zeros(len(raw), dtype=bool)
    if len(tokens) > 1:
        follows[starts[1:][tokens[1:] == tokens[:-1]]] = True
    letters, symbols, size = per_line(_LETTER[raw]), per_line(_SYMBOL[raw]), np.maximum(end - begin, 1)
    row = np.zeros(len(raw), dtype=bool)
    row[1:] = (raw[1:] == raw[:-1]) & ~_LETTER[raw[1:]] & ~_DIGIT[raw[1:]] & ~_IS_SPACE[raw[1:]]
    seen, again, n_dup = set(), np.zeros(len(lines), dtype=bool), 0
    for i, line in enumerate(lines):
        if words[i]:
            if line in seen:
                again[i] = True
                n_dup += 1
            seen.add(line)
    last = raw[np.maximum(end - 1, 0)]
    bits = (
        np.ones(len(lines), dtype=bool), words > 0, words >= 8, np.isin(last, [33, 46, 63]) & (end > begin), symbols > 0.03 * size, symbols > 0.1 * size,
        (per_line(_UPPER[raw]) > 0.5 * np.maximum(letters, 1)) & (words > 2), per_line(_DIGIT[raw]) > 0.3 * size, (per_line(follows) > 0.3 * words) & (words > 2), again, words < 3,
        per_line(raw == 124) > 0.15 * words, per_line(row) > 0.3 * np.maximum(words, 1),
    )
    packed = sum(b.astype(np.int32) << i for i, b in enumerate(bits))
    counts = {"n_words": len(tokens), "word_chars": len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r"), "n_symbols": int(_SYMBOL[raw].sum()), "n_dup_lines": n_dup, "n_repeat_words": repeat_words(tokens)}
    return counts, packed, words


def unpack(bits: np.ndarray) -> np.ndarray:
    return ((bits[..., None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


def train(stretches: list[np.ndarray], steps: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights for boilerplate against content, and a 2 x 2 table of transition weights.

    The penalised likelihood of the weakly labelled stretches is climbed by Adagrad; its gradient is the observed minus
    the expected counts, which forward and backward sums give for all stretches at once.
    """
    if not stretches:
        return PRIOR.copy(), np.array([[0.5, 0.0], [0.0, 0.5]])
    n, length = len(stretches), max(map(len, stretches))
    bits, there = np.zeros((n, length), dtype=np.int64), np.zeros((n, length), dtype=bool)
    for i, s in enumerate(stretches):
        bits[i, : len(s)], there[i, : len(s)] = s, True
    x = unpack(bits)
    cue = sum(1 << c for c in CUES)
    y = (bits & cue > 0) | (bits & 2 == 0)
    both = there[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (False, True)] for a in (False, True)], dtype=float)
    e, t = PRIOR.copy(), np.zeros((2, 2))
    ge, gt = np.full(len(e), 1e-6), np.full((2, 2), 1e-6)
    total = there.sum()
    for _ in range(steps):
        emit = np.stack([np.zeros((n, length)), x @ e], axis=2)
        emit[~there] = 0
        move = np.exp(t - t.max())
        pot = np.exp(emit - emit.max(axis=2, keepdims=True))
        f, b = np.empty((n, length, 2)), np.ones((n, length, 2))
        f[:, 0] = pot[:, 0] / pot[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, length):
            step = (f[:, i - 1] @ move) * pot[:, i]
            f[:, i] = np.where(there[:, i, None], step / step.sum(axis=1, keepdims=True), f[:, i - 1])
        for i in range(length - 2, -1, -1):
            back = (pot[:, i + 1] * b[:, i + 1]) @ move.T
            b[:, i] = np.where(there[:, i + 1, None], back / back.sum(axis=1, keepdims=True), 1.0)
        p = f * b
        p /= p.sum(axis=2, keepdims=True)
        pair = f[:, :-1, :, None] * move[None, None] * (pot[:, 1:] * b[:, 1:])[:, :, None, :]
        pair = pair / pair.sum(axis=(2, 3), keepdims=True) * both[:, :, None, None]
        de = ((y - p[:, :, 1]) * there).reshape(-1) @ x.reshape(-1, x.shape[2]) / total - ridge * e
        dt = (seen - pair.sum(axis=(0, 1))) / total - ridge * t
        ge, gt = ge + de**2, gt + dt**2
        e, t = e + rate * de / np.sqrt(ge), t + rate * dt / np.sqrt(gt)
    return e, t


def decode(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest labels (True: boilerplate) for emission weights of boilerplate against content."""
    (cc, cb), (bc, bb) = move.tolist()
    c, b, back = 0.0, float(emit[0]), []
    for w in emit[1:].tolist():
        to_c, to_b = (c + cc, 0) if c + cc >= b + bc else (b + bc, 1), (c + cb, 0) if c + cb > b + bb else (b + bb, 1)
        back.append((to_c[1], to_b[1]))
        c, b = to_c[0], to_b[0] + w
    out, state = [0] * len(emit), int(b > c)
    for i in range(len(emit) - 1, -1, -1):
        out[i] = state
        if i:
            state = back[i - 1][state]
    return np.array(out, dtype=bool)


def fit(docs: DataFrame, max_stretches: int = MAX_STRETCHES) -> tuple[np.ndarray, np.ndarray]:
    """Weights from one stretch of lines of each sampled document, chosen by a hash."""
    picked = lean(docs, ID, "text").select(F.xxhash64(F.lit("stretch"), ID, text_of()).alias("h"), ID).orderBy("h", ID).limit(max_stretches)
    chosen = lean(docs, ID, "text").join(F.broadcast(picked.select(F.col(ID).alias("__id"), "h")), F.col(ID).eqNullSafe(F.col("__id")) & (F.xxhash64(F.lit("stretch"), ID, text_of()) == F.col("h")))

    def extract(batches):
        for b in batches:
            rows = []
            for h, text in zip(b["h"], b["text"]):
                bits = describe(text)[1]
                at = h % max(1, len(bits) - STRETCH + 1)
                rows.append(bits[at : at + STRETCH].tolist())
            yield pd.DataFrame({"h": b["h"], "bits": rows})

    rows = chosen.select("h", text_of().alias("text")).mapInPandas(extract, "h long, bits array<int>").dropDuplicates(["h"]).toPandas()  # MAX_STRETCHES rows of STRETCH numbers
    return train([np.array(b) for b in rows.sort_values("h")["bits"]])


def judge(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` and the base counts, base_failed, content_share, the boilerplate lines, and kept."""
    e, t = weights

    def run(texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "boilerplate_lines", "kept")}
        for text in texts:
            counts, bits, words = describe(text or "")
            marked = decode(unpack(bits) @ e, t)
            share = float(words[~marked].sum() / counts["n_words"]) if counts["n_words"] else 0.0
            failed = counts["n_words"] < MIN_WORDS or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
            for k, v in (counts | {"base_failed": failed, "content_share": share, "boilerplate_lines": np.flatnonzero(marked).tolist(), "kept": not failed and share >= CONTENT_SHARE}).items():
                out[k].append(v)
        return out

    return append(docs, run, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, boilerplate_lines array<int>, kept boolean")
