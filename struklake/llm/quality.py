"""Quality classifier: random-indexing word vectors, pooled per document, then a small network.

1. Word vectors. Every word has a sparse ternary index vector; a word's vector is the sum of the
   index vectors of its neighbours within WINDOW words over all documents (Kanerva et al., 2000).
   Words share BUCKETS hashed rows of DIM counts, so a task holds one fixed matrix, the matrices
   merge by addition and what is broadcast (BUCKETS * DIM numbers) has a fixed size.
2. Pooling. A document is the mean and the spread of its words' unit vectors, the mean step from
   each word to the next (small where words repeat), and the logarithm of its length.
3. Network. One hidden layer in numpy, fitted on the driver on at most SAMPLE labelled documents,
   chosen by a hash; a temperature fitted on a fold of its own calibrates the probabilities.

Learning uses rows whose crc32(doc_id as text) mod 5 is not 0. Labels, language, source and id are
never inputs of a score. Tokens are runs of letters, runs of digits, and single other signs, in
their own case.

Defined results: null and empty texts pool to zeros and are scored like any other; repeated rows
score alike; without usable labels of both kinds every score is the smoothed share of good ones;
an empty table gives an empty result; null labels are not learnt from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from struklake.llm.common import materialise

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]")
#: Hashed rows, numbers in a vector, signs in an index vector, neighbours on each side.
BUCKETS, DIM, SIGNS, WINDOW = 1 << 15, 32, 2, 2
#: Rows of the matrix that travel in one record.
ROWS = 32
#: Tokens gathered before they are added to the matrix, and words whose vectors are held at a time.
TOKENS, POOL = 500_000, 1 << 16
#: Most labelled documents that the network is fitted on.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 48, 40, 2e-3, 1e-4, 17
#: A document is kept from this score on.
KEEP = 0.3
#: Distinct tokens remembered by a task.
MEMO = 300_000


class Buckets:
    """Hashed row of every token of a text."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = zlib.crc32(t) % BUCKETS
        return np.fromiter(map(memo.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of every bucket."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, SIGNS)), rng.choice([-1, 1], (BUCKETS, SIGNS))


def add_contexts(matrix: np.ndarray, words: np.ndarray, document: np.ndarray,
                 places: np.ndarray, signs: np.ndarray, seen: int = 0) -> None:
    """Add to each word's row the index vectors of its neighbours in the same document. Of the first
    `seen` words only pairs with later ones are added, as those among them were before."""
    for gap in range(1, WINDOW + 1):
        start = max(gap, seen)
        left, right = words[start - gap : max(0, len(words) - gap)], words[start:]
        same = document[start - gap : max(0, len(words) - gap)] == document[start:]
        left, right = left[same], right[same]
        for word, other in ((left, right), (right, left)):
            for s in range(SIGNS):
                matrix += np.bincount(
                    word * DIM + places[other, s], weights=signs[other, s], minlength=BUCKETS * DIM
                ).astype(np.int64)


def _count_contexts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    bucket, (places, signs) = Buckets(), index_vectors()
    matrix = np.zeros(BUCKETS * DIM, dtype=np.int64)
    held: list[np.ndarray] = []
    n = 0

    def flush() -> None:
        words = np.concatenate(held)
        document = np.repeat(np.arange(len(held)), [len(h) for h in held])
        for i in range(0, len(words), most):  # a long text is cut, with the window's overlap
            first, end = max(0, i - WINDOW), i + most
            add_contexts(matrix, words[first:end], document[first:end], places, signs, i - first)

    for batch in batches:
        for text in batch["text"]:
            held.append(bucket(text.as_py()))
            n += len(held[-1])
            if n >= most:
                flush()
                held, n = [], 0
    if n:
        flush()
    rows = matrix.reshape(-1, ROWS * DIM)
    full = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array([rows[i].tobytes() for i in full], pa.binary())],
        names=["part", "counts"],
    )


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            row = np.frombuffer(counts, dtype=np.int64)
            total[part] = total[part] + row if part in total else row
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        names=["part", "counts"],
    )


def word_vectors(docs: DataFrame, most: int = TOKENS) -> np.ndarray:
    """Unit context vectors of all buckets, counted over all documents, `most` tokens at a time."""
    schema = "part int, counts binary"
    parts = (
        docs.select("text").mapInArrow(partial(_count_contexts, most=most), schema)
        .repartition("part").mapInArrow(_add_parts, schema).collect()
    )
    matrix = np.zeros((BUCKETS, DIM))
    for part, counts in parts:
        matrix[part * ROWS : (part + 1) * ROWS] = np.frombuffer(counts, dtype=np.int64).reshape(ROWS, DIM)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return (matrix / np.maximum(norm, 1)).astype(np.float32)


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and mean step of the words' vectors, and the logarithm of their number."""
    out = np.zeros(3 * DIM + 1, dtype=np.float32)
    n = len(words)
    if n:
        total, squares, steps = np.zeros((3, DIM))
        for i in range(0, n, POOL):
            v = vectors[words[max(0, i - 1) : i + POOL]]  # the word before, for the step to the first
            steps += np.abs(v[1:] - v[:-1]).sum(axis=0, dtype=np.float64)
            v = v[1:] if i else v
            total += v.sum(axis=0, dtype=np.float64)
            squares += np.square(v, dtype=np.float64).sum(axis=0)
        mean = total / n
        out[:DIM] = mean
        out[DIM : 2 * DIM] = np.sqrt(np.maximum(squares / n - mean * mean, 0))
        out[2 * DIM : 3 * DIM] = steps / max(1, n - 1)
    out[-1] = np.log1p(n)
    return out


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and pooled features (float32 bytes) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("binary")
    def pool(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket = Buckets()
        for texts in series:
            yield pd.Series([pooled(bucket(t), shared.value).tobytes() for t in texts], dtype=object)

    return docs.select(*[c for c in docs.columns if c != "text"], pool(F.col("text")).alias("pooled"))


class Network:
    """Standardised inputs, one hidden layer of rectified units, one logit, one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibration: np.ndarray):
        fit = ~calibration
        good = (y.sum() + 1) / (len(y) + 2)
        self.prior = float(np.log(good / (1 - good)))
        self.layers = None
        if len(set(y[fit].tolist())) < 2:
            return
        self.middle, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        self._train((x[fit] - self.middle) / self.scale, y[fit].astype(np.float64))
        self.temperature = 1.0
        if len(set(y[calibration].tolist())) == 2:
            z, t = self.logits(x[calibration]), y[calibration]
            choices = np.exp(np.linspace(np.log(0.3), np.log(10), 100))
            loss = [np.logaddexp(0, -np.where(t == 1, z, -z) / c).mean() for c in choices]
            self.temperature = float(choices[int(np.argmin(loss))])

    def _train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        n, d = x.shape
        w = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(self.prior)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for i in range(0, n, 128):
                a, t = x[order[i : i + 128]], y[order[i : i + 128]]
                h = np.maximum(a @ w[0] + w[1], 0)
                e = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - t) / len(t)
                back = np.outer(e, w[2]) * (h > 0)
                grad = [a.T @ back + DECAY * w[0], back.sum(0), h.T @ e + DECAY * w[2], e.sum()]
                step += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.layers = w

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.layers
        return np.maximum((x - self.middle) / self.scale @ w[0] + w[1], 0) @ w[2] + w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature if self.layers else np.full(len(x), self.prior)
        # matrix products differ in their last bits with the number of rows in a batch
        return np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 9)


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def learnable(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Column]:
    """Labels to learn from, and the condition on doc_id that holds their number to about
    `sample`; documents can be filtered by it before their features are computed."""
    known = labels.filter("quality is not null and doc_id is not null").filter(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    cut = int(2**32 * min(1, sample / max(1, known.count())))
    chosen = (F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < cut) & (fold() != 0)
    return known.filter(chosen), chosen


def fitted(pooled_docs: DataFrame, known: DataFrame) -> Network:
    """Network fitted on the pooled documents that have a label in `known`."""
    rows = (
        pooled_docs.join(known, "doc_id").groupBy("doc_id", "quality")
        .agg(F.min("pooled").alias("pooled")).withColumn("fold", fold()).collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["pooled"], dtype=np.float32) for r in rows]).reshape(len(rows), 3 * DIM + 1)
    y = np.array([r["quality"] for r in rows], dtype=np.int64)
    return Network(x, y, np.array([r["fold"] == 1 for r in rows], dtype=bool))


def score(pooled_docs: DataFrame, network: Network) -> DataFrame:
    shared = pooled_docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), 3 * DIM + 1)
        return pd.Series(shared.value.scores(x))

    return pooled_docs.withColumn("score", scored(F.col("pooled"))).drop("pooled")


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    texts = docs.select("doc_id", "text")
    pooled_docs = materialise(features(texts, word_vectors(texts)))
    known, chosen = learnable(labels.select("doc_id", "quality"))
    network = fitted(pooled_docs.filter(chosen), known)
    return score(pooled_docs, network).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    vectors = word_vectors(docs)
    known, chosen = learnable(labels.select("doc_id", "quality"))
    network = fitted(features(docs.select("doc_id", "text").filter(chosen), vectors), known)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((vectors, network))

    @F.pandas_udf("boolean")
    def good(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket = Buckets()
        table, net = shared.value
        for texts in series:
            x = np.array([pooled(bucket(t), table) for t in texts]).reshape(len(texts), 3 * DIM + 1)
            yield pd.Series(net.scores(x) >= keep)

    return docs.filter(good(F.col("text")))
