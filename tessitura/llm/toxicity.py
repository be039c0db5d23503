"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts shared three-letter subsequences, gaps allowed, each weighted by DECAY to its
span, cosine-normalised; so "id.iot", "idxiot" and "i d i o t" stay close to "idiot". Its feature
space is small (48 letter classes cubed), so k(word, landmark) is a dot product and, once
the SVM over Nyström features is fitted, its whole decision function folds into one weight per
subsequence: scoring a word costs a few lookups, however many landmarks there are.

Training (one task on an executor, bounded): at most ``max_toxic`` and ``max_clean`` labelled documents of at most
``max_bytes`` each, by hash order; held-out rows (crc32(doc_id) mod 5 = 0) are never read. Labels are those of documents; the
units that the kernel compares are words (runs of one-letter words are one), not whole sentences. A document
is toxic through some of its words, so fitting alternates: the SVM is fitted on words, then each toxic
document keeps only the words that speak for it most (multiple-instance learning). A document's score
is a logistic function of its strongest words' decision values.

Scoring: whole texts, in Arrow batches, distinct words once per batch; no shuffle. Null and empty texts
score the calibrated value of a text without words. Only text is an input of a score. Rows that repeat
are scored alike; of the labels of one doc_id the largest holds, of its texts one is learned. Without usable labels every
document scores under 0.02. Columns of the caller are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_each, pieces, run_hashes, text_buffer, words

LETTERS, DECAY, SPAN = 48, 0.6, 6
DIM = LETTERS**3
TOP = 3  # strongest words that a document's score looks at

_CLASS = np.zeros(256, np.uint8)  # 0: not a letter, dropped
for _b in range(256):
    _c = chr(_b).lower()
    if _b < 128 and _c.isalpha():
        _CLASS[_b] = ord(_c) - 96
    elif _b >= 128:
        _CLASS[_b] = 27 + (_b - 128) % 21 if _b < 192 else 0  # lead bytes say little, the rest tell letters apart
_LETTER = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, LETTERS, dtype=np.uint64) | np.uint64(1)
for _b, _c in zip(b"0134578@$!|", "oieastbasii"):
    _CLASS[_b] = ord(_c) - 96


@dataclass
class Words:
    """Letter classes of words end to end, each followed by SPAN zeros; ``begin`` and ``size`` find a word."""

    letters: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> Words:
        size = self.size[at]
        total = size + SPAN
        begin = np.cumsum(total) - total
        out = np.zeros(int(total.sum()) if len(at) else 0, np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + inside] = self.letters[np.repeat(self.begin[at], size) + inside]
        return Words(out, begin, size)


def read_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts and their hashes; then for every word of a text its place among them and its text's number.

    A word is its letters: other characters are dropped, digits that look like letters are read as such.
    Runs of one-letter words are read as one word. Words without letters are left out.
    """
    lower = raw
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.zeros(0, int)
    up = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E)]  # accented capitals
    if len(up):
        lower = raw.copy()
        lower[up] += 0x20
    starts, ends, first = words(raw, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    cls = _CLASS[lower]
    solid = cls > 0
    upto = np.concatenate([[0], np.cumsum(solid)])
    n = upto[ends] - upto[starts]
    keep = n > 0
    starts, n, text = starts[keep], n[keep], text[keep]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none), np.zeros(0, np.uint64), none, none
    new = np.ones(len(starts), bool)
    new[1:] = ~((n[1:] == 1) & (n[:-1] == 1) & (text[1:] == text[:-1]))
    head = np.flatnonzero(new)
    size, text, begin = np.add.reduceat(n, head), text[head], upto[starts[head]]
    flat = cls[solid]
    key = run_hashes(_LETTER[flat], begin, size)
    key, at, back = np.unique(key, return_index=True, return_inverse=True)
    return Words(flat, begin, size).take(at), key, back, text


def vocabulary(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Distinct words of the texts; then (word, text) for each word that a text holds, once. Read piece by piece."""
    few, keys, held, docs = [], [], [], []
    for a, b in pieces(offsets, 1 << 19):
        part = offsets[a : b + 1]
        own, key, back, text = read_words(raw[part[0] : part[-1]], part - part[0])
        pair = np.unique(back * np.int64(len(offsets)) + text + a)
        few.append(own)
        keys.append(key)
        held.append(key[pair // len(offsets)])
        docs.append(pair % len(offsets))
    if not few:
        few, keys, held, docs = [Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    skip = np.cumsum([0, *[len(w.letters) for w in few]])
    every = Words(np.concatenate([w.letters for w in few]), np.concatenate([w.begin + n for w, n in zip(few, skip)]), np.concatenate([w.size for w in few]))
    key, at = np.unique(np.concatenate(keys), return_index=True)
    return every.take(at), np.searchsorted(key, np.concatenate(held)), np.concatenate(docs)


_GAPS = [(i, j) for i in range(1, SPAN) for j in range(i + 1, SPAN + 1)]


def _norm(size: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector, each subsequence counted apart: it depends on the word's length alone."""
    total = np.full(len(size), 1e-9)
    for _, j in _GAPS:
        total += np.maximum(0, size - j) * DECAY ** (2 * (j - 2))
    return np.sqrt(total)


def _features(w: Words):
    """For each pair of gaps: the feature number at every letter, and the weight. Features that end in no letter are unused."""
    n = len(w.letters) - SPAN
    a = w.letters[:n].astype(np.int32) * (LETTERS * LETTERS)
    b = w.letters.astype(np.int32) * LETTERS
    c = w.letters.astype(np.int32)
    for i, j in _GAPS:
        yield a + b[i : i + n] + c[j : j + n], DECAY ** (j - 2)


_USED = np.zeros((LETTERS, LETTERS, LETTERS), bool)
_USED[1:, 1:, 1:] = True
_USED = _USED.reshape(-1)


def decide(w: Words, weights: np.ndarray) -> np.ndarray:
    """Decision value of each word: <weights, features> over the features' length."""
    if not len(w.size):
        return np.zeros(0)
    weights = np.where(_USED, weights, 0).astype(np.float32)
    total = np.zeros(len(w.letters), np.float32)
    for feature, decay in _features(w):
        total[: len(feature)] += np.float32(decay) * weights[feature]
    return np.add.reduceat(total, w.begin) / _norm(w.size)


def columns_of(w: Words) -> np.ndarray:
    """Numbers of the features that some of the words have."""
    seen = np.zeros(DIM, bool)
    for feature, _ in _features(w):
        seen[feature] = True
    return np.flatnonzero(seen & _USED)


def embed(w: Words, columns: np.ndarray) -> np.ndarray:
    """The features ``columns`` of a few words (landmarks, training blocks) in ``decide``'s scale, dense."""
    place = np.full(DIM, -1, np.int32)
    place[columns] = np.arange(len(columns), dtype=np.int32)
    out = np.zeros((len(w.size), len(columns)), np.float32)
    row = np.repeat(np.arange(len(w.size)), w.size + SPAN)
    for feature, decay in _features(w):
        at = place[feature]
        on = np.flatnonzero(at >= 0)
        np.add.at(out, (row[on], at[on]), np.float32(decay))
    return out / _norm(w.size)[:, None].astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # float32[DIM]
    calibration: np.ndarray  # of 1 and the top decision values

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(features(raw, offsets, self.weights) @ self.calibration)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """1, the largest word decisions of each text (0 where it has fewer words) and the share of its words above 1/2."""
    n = len(offsets) - 1
    out = np.zeros((n, TOP + 2))
    out[:, 0] = 1
    few, _, back, text = read_words(raw, offsets)
    if len(text):
        value = decide(few, weights)[back]
        rest = value.copy()
        head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        for k in range(TOP):
            best = np.maximum.reduceat(rest, head)
            out[text[head], k + 1] = np.maximum(best, 0)
            # the first word at the maximum leaves the race
            hit = np.flatnonzero(rest == np.repeat(best, np.diff(np.r_[head, len(text)])))
            rest[hit[np.unique(text[hit], return_index=True)[1]]] = -np.inf
        count = np.bincount(text, minlength=n)
        out[:, TOP + 1] = np.bincount(text, value > 0.5, n) / np.maximum(count, 1) * 10
    return out


def _svm(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float, rounds: int = 60) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last column of x is the bias."""
    beta = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    for _ in range(rounds):
        slack = 1 - y * (x @ beta)
        on = slack > 0
        xo, wo = x[on], w[on]
        grad = reg * beta - xo.T @ (wo * y[on] * slack[on])
        hess = np.diag(reg)
        for i in range(0, len(xo), 2048):  # a block at a time: no second copy of x
            hess += (xo[i : i + 2048] * wo[i : i + 2048, None]).T @ xo[i : i + 2048]
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-5:
            break
    return beta


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        grad = x.T @ (p - y) / len(y) + l2 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-7:
            break
    return beta


def fit(texts, toxic: np.ndarray, landmarks: int = 256, rounds: int = 4, seed: int = 5) -> Model:
    """Fits on whole texts (a list or an Arrow array) with labels 0/1."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    toxic = np.asarray(toxic, int)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        prior = np.zeros(TOP + 2)
        prior[0] = -4 if not len(toxic) or toxic[0] == 0 else 4
        return Model(np.zeros(DIM), prior)
    raw, offsets = text_buffer(texts)
    few, word, doc = vocabulary(raw, offsets)
    df1 = np.bincount(word, toxic[doc] == 1, len(few.size))
    df0 = np.bincount(word, toxic[doc] == 0, len(few.size))
    n1, n0 = (toxic == 1).sum(), (toxic == 0).sum()
    # Landmarks: the words that speak most for and against, then a spread of frequent ones.
    pull = df1 / n1 - df0 / n0
    z = (pull) / np.sqrt((df1 + df0 + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
    rng = np.random.Generator(np.random.PCG64(seed))
    strong = np.argsort(-z)[: landmarks // 2]
    common = np.argsort(-(df0 + df1))[: landmarks * 8]
    rest = rng.permutation(np.setdiff1d(common, strong))[: landmarks - len(strong)]
    marks = few.take(np.concatenate([strong, rest]))
    columns = columns_of(marks)  # a landmark's kernel sees no others
    mark = embed(marks, columns)
    gram = mark @ mark.T
    value, vec = np.linalg.eigh(gram.astype(np.float64))
    value = np.where(value > 1e-6 * value.max(), value, np.inf)
    root = (vec / np.sqrt(value)) @ vec.T
    # Training words: what toxic documents hold, and as many of the clean ones by frequency and at random.
    pool = np.unique(np.concatenate([np.flatnonzero(df1 >= 2), common, np.argsort(-z)[:4000], rng.permutation(len(few.size))[:6000]]))
    pos = np.full(len(few.size), -1)
    pos[pool] = np.arange(len(pool))
    x = np.empty((len(pool), len(mark) + 1))
    for i in range(0, len(pool), 100):
        x[i : i + 100, :-1] = embed(few.take(pool[i : i + 100]), columns) @ mark.T @ root
    x[:, -1] = 1
    inside = pos[word] >= 0
    word, doc = pos[word[inside]], doc[inside]
    up = np.maximum(0, z[pool] - 3)
    for turn in range(rounds):
        # A word stands for the toxic documents whose witness it is, and against every clean document that has it.
        value = up if turn == 0 else x @ beta
        held = toxic[doc] == 1
        w1, d1 = word[held], doc[held]
        order = np.lexsort((-value[w1], d1))
        place = np.arange(len(order)) - np.searchsorted(d1[order], d1[order])
        top = order[(place < TOP) & (value[w1[order]] > 0)]
        wit = np.bincount(w1[top], minlength=len(pool)) / n1
        con = np.bincount(word[toxic[doc] == 0], minlength=len(pool)) / n0
        # df of a witness in clean documents weighs against it in full; others share what is left.
        y = np.where(wit > con, 1.0, -1.0)
        weight = np.abs(wit - con) * 400 + np.where(wit > con, 0, 0.05)
        beta = _svm(x, y, weight, 1.0)
    # The SVM's bias is left to the calibration.
    folded = np.zeros(DIM, np.float32)
    folded[columns] = mark.T @ (root @ beta[:-1]).astype(np.float32)
    model = Model(folded, np.zeros(TOP + 2))
    feats = np.concatenate([features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.weights) for a, b in pieces(offsets, 1 << 19)])
    model.calibration = _logistic(feats, toxic.astype(float))
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_bytes: int) -> DataFrame:
    """(doc_id, text, toxic) of at most max_toxic + max_clean labelled documents outside the held-out fold, by hash order."""
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = lambda t, n: usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = draw(1, max_toxic).unionByName(draw(0, max_clean))
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), "doc_id")
    return one_row_each(rows, ["doc_id"])


def _fit(batches):
    rows = pa.Table.from_batches(list(batches))
    if not rows.num_rows:
        return
    rows = rows.sort_by("doc_id").combine_chunks()
    model = fit(rows["text"].combine_chunks(), rows["toxic"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.calibration.astype(np.float64).tobytes()], pa.binary())], ["weights", "calibration"])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 3000, max_bytes: int = 1 << 16) -> Model:
    """Fitted in one task over the sample, so texts never come to the driver: it gets the weights (DIM numbers)."""
    rows = sample(docs, labels, max_toxic, max_clean, max_bytes).repartition(1)
    got = rows.mapInArrow(_fit, "weights binary, calibration binary").collect()  # one row at most
    if not got:
        return fit([], np.zeros(0, int))
    return Model(np.frombuffer(got[0]["weights"], np.float32), np.frombuffer(got[0]["calibration"], np.float64))


def _score(model: Model, column: str):
    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(batch.schema.names.index("text")))
            got = [np.zeros(0)]
            for a, b in pieces(offsets, 1 << 20):
                part = offsets[a : b + 1]
                got.append(model.score(raw[part[0] : part[-1]], part - part[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got))], [*batch.schema.names, column])

    return run


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a further column, 0 to 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    if column in docs.columns:
        raise ValueError(f"documents have a column {column!r}; name another for the score")
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(_score(model, column), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    got = score(docs.select("doc_id", "text"), train(docs, labels))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``; columns unchanged, also one named score."""
    columns, own = docs.columns, "__toxicity"
    while own in columns:
        own += "_"
    return score(docs, train(docs, labels), own).where(F.col(own) < threshold).select(*columns)
