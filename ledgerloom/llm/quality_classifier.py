"""Quality classifier: random-indexing word vectors, pooled, then a small network.

1. *Random indexing over all documents.*  Every word has a fixed sparse random
   index vector (two signed places of ``DIM``, from its whole name).  The context
   vector of a word is the sum of the index vectors of its neighbours up to
   ``REACH`` words away, over the whole corpus.  Words share ``BUCKETS`` context
   rows by hash, so that matrix has one size however large the corpus: tasks
   sum their part in whole numbers, Spark adds the parts, and only the finished
   matrix reaches the driver.
2. *Pooling.*  A document's features are the mean of its words' context vectors
   (each scaled to length one), the mean of its words' index vectors, and its
   coherence: how well the vectors of words up to ``REACH`` apart agree (mean
   products of their index and of their context vectors).  Whole texts always.
3. *Network.*  Two layers in numpy, fitted on a bounded sample of labelled rows
   (``MAX_TRAIN``, the only sampled step, as a fit may be), then one temperature
   on rows kept aside from the fit, so that scores are calibrated.

Defined results: null or empty text has features zero and still gets a score;
rows that repeat an id are scored row by row, and so are ties: equal texts have
equal scores; with no labelled rows or only one class the score is the share of
label 1 (0.5 without any); an empty table gives no rows; other columns are
ignored.  Labels, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import list_array, texts_of
from .words import chunks, mix, split_words

BUCKETS = 1 << 15
DIM = 64
REACH = 2
#: Labelled rows the network is fitted on, at most.
MAX_TRAIN = 20_000
HIDDEN = 24
FEATURES = 2 * DIM + 2 * REACH
_SLICES = 32

_U = np.uint64


def _places(names: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """The index vectors of words: (places, signs) of their first and of their second entry."""
    h = mix(names + _U(0xA5A5A5A5))
    sign = lambda bit: ((h >> _U(bit)) & _U(1)).astype(np.int8) * 2 - 1
    return ((h % _U(DIM)).astype(np.int64), sign(40)), (((h >> _U(20)) % _U(DIM)).astype(np.int64), sign(41))


def context_sums(docs: DataFrame) -> np.ndarray:
    """Context vectors [BUCKETS, DIM] summed over all rows of ``docs(id, text)``, in whole numbers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM, dtype=np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks([len(t) for t in texts]):
                w = split_words(texts[a:b])
                row = (w.names % _U(BUCKETS)).astype(np.int64) * DIM
                doc = w.docs()
                at, what = [], []
                for away in range(1, REACH + 1):
                    left = np.flatnonzero(doc[away:] == doc[:-away])
                    for place, sign in _places(w.names):
                        at += [row[left] + place[left + away], row[left + away] + place[left]]
                        what += [sign[left + away], sign[left]]
                total += np.bincount(np.concatenate(at), weights=np.concatenate(what), minlength=len(total)).astype(np.int64)
        parts = total.reshape(_SLICES, -1)
        small = np.abs(parts).max(initial=0) < 1 << 31
        packed = [p.astype("<i4" if small else "<i8").tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        size = BUCKETS // _SLICES * DIM
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = part.as_py()
                got = np.frombuffer(part, dtype="<i4" if len(part) == 4 * size else "<i8").astype(np.int64)
                sums[k] = sums[k] + got if k in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "sums"])

    # every slice has one fixed size; a task holds the slices it was dealt and nothing else
    parts = docs.select("text").mapInArrow(gather, "slice int, sums binary")
    added = parts.repartition(_SLICES, "slice").mapInArrow(add, "slice int, sums binary").collect()
    out = np.zeros((_SLICES, BUCKETS // _SLICES * DIM), dtype=np.int64)
    for k, part in added:
        out[k] = np.frombuffer(part, dtype=np.int64)
    return out.reshape(BUCKETS, DIM)


def context_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors of length one (or zero)."""
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Features [documents, FEATURES] from context vectors of length one."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for a, b in chunks([len(t) for t in texts], 1 << 19):
        w = split_words(texts[a:b])
        has = np.flatnonzero(w.counts)
        if not len(has):
            continue
        n, doc = np.maximum(w.counts, 1), w.docs()
        context = vectors[(w.names % _U(BUCKETS)).astype(np.int64)]
        out[a + has, :DIM] = np.add.reduceat(context, w.offsets[:-1][has], axis=0) / n[has, None]
        entries = _places(w.names)
        index = sum(np.bincount(doc * DIM + place, weights=sign, minlength=(b - a) * DIM) for place, sign in entries)
        out[a:b, DIM : 2 * DIM] = index.reshape(-1, DIM) / n[:, None]
        for away in range(1, REACH + 1):
            left = np.flatnonzero(doc[away:] == doc[:-away])
            right = left + away
            agree = sum((p[left] == q[right]) * (s[left] * t[right]) for p, s in entries for q, t in entries) / 2
            close = np.einsum("ij,ij->i", context[left], context[right])
            for k, product in enumerate((agree, close)):
                out[a:b, 2 * DIM + 2 * (away - 1) + k] = np.bincount(doc[left], weights=product, minlength=b - a) / np.maximum(w.counts - away, 1)
    return out


class Network:
    """Two layers: tanh, then a logistic output divided by a temperature."""

    def __init__(self, constant: float = 0.5):
        self.constant, self.layers, self.temperature = constant, None, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7, rounds: int = 60) -> Network:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        draw = np.random.default_rng(seed)
        order = draw.permutation(len(y))
        aside, own = order[: len(y) // 5], order[len(y) // 5 :]
        w1, b1 = draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        w2, b2 = draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.layers = [w1, b1, w2, b2]
        m = [np.zeros_like(p) for p in self.layers]
        v = [np.zeros_like(p) for p in self.layers]
        step, size = 0, 128
        for _ in range(rounds if len(own) > 2000 else 3 * rounds):
            own = draw.permutation(own)
            for i in range(0, len(own), size):
                at = own[i : i + size]
                h = np.tanh(x[at] @ w1 + b1)
                gap = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - y[at]) / len(at)
                back = gap[:, None] * w2 * (1 - h * h)
                grads = [x[at].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ gap + 1e-4 * w2, gap.sum(keepdims=True)]
                step += 1
                for k, (p, g) in enumerate(zip(self.layers, grads, strict=True)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if len(aside) >= 50:
            z, t = self._logit(x[aside]), y[aside]
            grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
            loss = [np.logaddexp(0, np.where(t == 1, -z, z) / k).mean() for k in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        z = self._logit(np.clip((x - self.mean) / self.scale, -8, 8)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """What scoring needs, on the executors: word vectors and the network."""

    def __init__(self, vectors, net: Network):
        self.vectors, self.net = vectors, net

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.net.score(pooled(texts, self.vectors.value).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Word vectors from all of ``docs``, the network from labelled rows.

    ``labels`` (id, label) must hold only rows that may be learned from.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(context_vectors(context_sums(own)))  # BUCKETS x DIM floats, one size always

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(texts_of(batch.column(1)), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), list_array(x.ravel(), np.arange(len(x) + 1) * FEATURES, pa.float32())], names=["id", "y", "x"])

    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(MAX_TRAIN)  # the documented sample of the fit
    rows = own.join(F.broadcast(chosen), "id").select("id", "text", "y")
    id_type = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(featurise, f"id {id_type}, y int, x array<float>")
    train = found.orderBy(F.xxhash64("id"), "id", "y", "x").limit(2 * MAX_TRAIN).toArrow().combine_chunks()
    x = pa.concat_arrays([c.flatten() for c in train["x"].chunks] or [pa.array([], pa.float32())]).to_numpy(zero_copy_only=False).astype(np.float64)
    return Model(sent, Network().fit(x.reshape(train.num_rows, FEATURES), train["y"].to_numpy().astype(np.float64)))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id and ``score``, the calibrated probability of label 1."""
    model = fit(docs, labels, id_col, text_col, label_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(texts_of(batch.column(1))), pa.float64())], names=["id", "score"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(judge, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``; no shuffle of texts."""
    model = fit(docs, labels, id_col, text_col, label_col)
    text_at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(texts_of(batch.column(text_at))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
