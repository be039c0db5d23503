"""Quality classifier by co-training.

Two views of a document are classified apart: what it says (word and byte-class trigram hashes of the text alone)
and what surrounds it (page metadata alone: source, language, the stated length and their pairs). Each view has a
multinomial naive Bayes classifier, whose whole state is a sum of feature counts per class, so any number of documents can
teach it. In each round both classifiers score every unlabelled document; those that one view is sure of teach
the other, at a lower weight than labelled ones. Then each view is calibrated apart (a logistic curve on labelled
documents kept out of fitting) and a logistic combination of the calibrated views scores every document.

Labelled documents: at most ``max_labelled`` by hash order, outside the held-out fold (crc32(doc_id) mod 5 = 0). Unlabelled
ones: all others outside that fold, in every round (labels beyond the sample aren't looked at); a round is one pass of Arrow batches whose tasks return one row of sums
each (2 x (TEXT_DIM + META_DIM) numbers), added up in a tree of groups. Scoring is one more such pass. Texts are read whole.

Null text is empty; null metadata is a value of its own. Empty texts get a score like any other. Of clashing labels of one
doc_id the least holds. A doc_id that repeats teaches with each of its texts if it is unlabelled, with one if it is labelled.
Rows without doc_id are scored and don't teach. Without labels of both kinds every document scores 0.5. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_each, pieces, text_buffer, mix, word_hashes, words
from .toxicity import _logistic, _sigmoid, held_out

TEXT_DIM, META_DIM = 4096, 512
SURE, LENT = 0.95, 0.2  # a pseudo-label's least probability, and its weight against a label's
_CLASS = np.zeros(256, np.uint8)
for _i in range(256):
    _CLASS[_i] = (
        1 if 97 <= _i <= 122 else 2 if 65 <= _i <= 90 else 3 if 48 <= _i <= 57 else 4 if _i in (32, 9, 11, 12, 13) else 5 if _i == 10 else 6 if _i >= 128 else 7 + _i % 9
    )
_GRAM = (np.arange(4096) * np.int64(2654435761) % (TEXT_DIM // 2)).astype(np.int32)


def text_view(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Root frequencies of byte-class trigrams, hashed words and words said twice running; one row a text.

    Each half of a row is scaled to the same total, so a long text counts as much as a short one.
    """
    n, half = len(offsets) - 1, TEXT_DIM // 2
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    cls = _CLASS[raw]
    starts, ends, first = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    seen = np.zeros((n, TEXT_DIM), np.float32)
    if len(raw) > 2:
        wide = cls.astype(np.int32)
        gram = _GRAM[(wide[:-2] << 8) + (wide[1:-1] << 4) + wide[2:]] + row[2:] * half
        seen[:, :half] = np.bincount(gram, minlength=n * half).reshape(n, half)
        # Those that reach over a text's border belong to no text.
        over = np.unique(np.concatenate([offsets[1:-1] - 2, offsets[1:-1] - 1]))
        over = over[(over >= 0) & (over < len(gram))]
        over = over[row[over] != row[over + 2]]
        np.subtract.at(seen.reshape(-1), (gram[over] // half) * TEXT_DIM + gram[over] % half, 1)
    if len(h):
        # Runs of one word pile up in the last bucket.
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        bucket = np.where(again, half - 1, (mix(h) % np.uint64(half - 1)).astype(np.int64))
        seen[:, half:] = np.bincount(text * half + bucket, minlength=n * half).reshape(n, half)
    np.sqrt(seen, out=seen)
    for part in (seen[:, :half], seen[:, half:]):
        part *= 32 / np.maximum(part.sum(1, keepdims=True), 1e-9)
    return seen


def meta_view(source: list, lang: list, length: list) -> np.ndarray:
    """Numbers of each document's features: source, language, length to a factor of 1.4, and pairs of these."""
    code = lambda *x: zlib.crc32(repr(x).encode()) % META_DIM
    out = np.zeros((len(source), 6), np.int32)
    for i, (s, g, c) in enumerate(zip(source, lang, length)):
        size = None if c is None else int(np.log2(max(int(c), 0) + 1) * 2)
        out[i] = code("s", s), code("g", g), code("c", size), code("sg", s, g), code("sc", s, size), code("gc", g, size)
    return out


def _zeros(dim: int):
    return field(default_factory=lambda: np.zeros((2, dim)))


@dataclass
class Model:
    """Feature sums by class (0, 1) of either view, from labels and from the other view's pseudo-labels; then the calibrations."""

    text: np.ndarray = _zeros(TEXT_DIM)
    meta: np.ndarray = _zeros(META_DIM)
    lent_text: np.ndarray = _zeros(TEXT_DIM)
    lent_meta: np.ndarray = _zeros(META_DIM)
    each: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # offset and slope of each view
    both: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds per feature."""

        def odds(own, lent):
            total = own + lent
            p = (total + 1) / (total + 1).sum(1, keepdims=True)
            return np.log(p[1] / p[0])

        return odds(self.text, self.lent_text).astype(np.float32), odds(self.meta, self.lent_meta).astype(np.float32)

    def margins(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        t, m = self.weights()
        return np.stack([text @ t, m[meta].sum(1)], 1).astype(float)

    def views(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated log odds of the two views."""
        return np.clip(self.margins(text, meta) * self.each[:, 1] + self.each[:, 0], -30, 30)

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        v = self.views(text, meta)
        return _sigmoid(self.both[0] + v @ self.both[1:])

    def calibrate(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray) -> None:
        m, y = self.margins(text, meta), label.astype(float)
        for i in (0, 1):
            scale = m[:, i].std() or 1.0
            b = _logistic(np.stack([np.ones(len(y)), m[:, i] / scale], 1), y, 1e-2)
            self.each[i] = b[0], b[1] / scale
        v = np.clip(m * self.each[:, 1] + self.each[:, 0], -30, 30)
        self.both = _logistic(np.concatenate([np.ones((len(y), 1)), v], 1), y, 1e-2)


def _views(batch: pa.RecordBatch):
    raw, offsets = text_buffer(batch.column("text"))
    source, lang, length = (batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))
    for a, b in pieces(offsets, 1 << 20):
        for first in range(a, b, 1000):
            last = min(b, first + 1000)
            part = offsets[first : last + 1]
            yield first, last, text_view(raw[part[0] : part[-1]], part - part[0]), meta_view(source[first:last], lang[first:last], length[first:last])


def _export(batches):
    for batch in batches:
        for first, last, text, meta in _views(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), batch.column("label").slice(first, last - first), pa.array([x.astype(np.float16).tobytes() for x in text]), pa.array([x.tobytes() for x in meta])], ["doc_id", "label", "text", "meta"]
            )


def _teach(model: Model):
    """One row a task: what its unlabelled documents teach either view."""

    def run(batches):
        text_sum, meta_sum, told = np.zeros((2, TEXT_DIM)), np.zeros((2, META_DIM)), np.zeros(4)
        for batch in batches:
            for _, _, text, meta in _views(batch):
                p = _sigmoid(model.views(text, meta))
                for label in (0, 1):
                    by_text, by_meta = ((q >= SURE) if label else (q <= 1 - SURE) for q in (p[:, 0], p[:, 1]))
                    text_sum[label] += LENT * text[by_meta].sum(0)
                    meta_sum[label] += LENT * np.bincount(meta[by_text].ravel(), minlength=META_DIM)
                    told[label] += by_text.sum()
                    told[2 + label] += by_meta.sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([text_sum.ravel(), meta_sum.ravel(), told]).tobytes()])], ["sums"])

    return run


def _add(batches):
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            x = np.frombuffer(x.as_buffer(), np.float64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])


def _lean(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), length.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, rounds: int = 2) -> tuple[Model, np.ndarray]:
    """The model and, per round, how many documents each view taught (text view: 0, 1; metadata view: 0, 1)."""
    rows = _lean(docs)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    ids = usable.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = one_row_each(rows.join(F.broadcast(ids), "doc_id"), ["doc_id"]).select("doc_id", "label", "text", "source", "lang", "n_chars")
    got = known.mapInArrow(_export, "doc_id long, label int, text binary, meta binary").orderBy("doc_id").toArrow()  # max_labelled rows of fixed size at most
    label = got["label"].to_numpy()
    model, told = Model(), []
    if not len(label) or label.min() == label.max():
        return model, np.zeros((0, 4))
    text = np.frombuffer(b"".join(got["text"].to_pylist()), np.float16).reshape(-1, TEXT_DIM)
    meta = np.frombuffer(b"".join(got["meta"].to_pylist()), np.int32).reshape(len(label), -1)
    aside = np.arange(len(label)) % 4 == 0  # for calibration only
    for c in (0, 1):
        mine = ~aside & (label == c)
        model.text[c], model.meta[c] = text[mine].sum(0, dtype=np.float64), np.bincount(meta[mine].ravel(), minlength=META_DIM)
    spare = text[aside].astype(np.float32), meta[aside], label[aside]
    if len(set(spare[2])) < 2:
        spare = text.astype(np.float32), meta, label
    model.calibrate(*spare)
    # At most max_labelled ids: a broadcast of bounded size, so no text moves.
    free = rows.where(F.col("doc_id").isNotNull() & ~held_out()).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_anti")
    for _ in range(rounds):
        sums = free.mapInArrow(_teach(model), "sums binary").repartition(16).mapInArrow(_add, "sums binary").collect()  # 16 rows at most
        if not sums:
            break
        total = sum(np.frombuffer(r["sums"], np.float64) for r in sums)
        model.lent_text, model.lent_meta = total[: 2 * TEXT_DIM].reshape(2, -1), total[2 * TEXT_DIM : -4].reshape(2, -1)
        told.append(total[-4:])
        model.calibrate(*spare)
    return model, np.array(told)


def _score(model: Model):
    def run(batches):
        for batch in batches:
            got = [np.zeros(0)]
            for _, _, text, meta in _views(batch):
                got.append(model.score(text, meta))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(got))], ["doc_id", "quality"])

    return run


def report(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, held_out, quality (0 to 1), kept for every document."""
    model, _ = train(docs, labels)
    got = _lean(docs).mapInArrow(_score(model), "doc_id long, quality double")
    return got.select("doc_id", held_out().alias("held_out"), "quality", (F.col("quality") >= keep_at).alias("kept"))
