"""Quality from random-indexing word vectors and a small network."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakelake.llm.common import bounded_batches, own_columns, whole
from quakelake.llm.registry import query

#: Labelled rows that the network is fitted on at most, in hash order.
FIT_ROWS = 20_000
#: Rows of the vector table: words share buckets by hash, shapes have a range of their own.
WORD_BUCKETS = 8_192
SHAPE_BUCKETS = 512
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
DIMENSIONS = 32
#: Non-zero entries of an index vector.
ENTRIES = 4
HIDDEN = 32
THRESHOLD = 0.7
#: Words a task remembers the buckets of.
MEMORY = 500_000
#: Words worked on at once.
STRETCH = 1 << 18

#: Letters, digits and other signs seen as a shape.
KINDS = bytes(
    ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)
RUNS = re.compile(rb"(.)\1+", re.S)


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 per bucket, the same everywhere."""
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for row in out:
        row[rng.choice(DIMENSIONS, ENTRIES, replace=False)] = rng.choice([-1.0, 1.0], ENTRIES)
    return out


class Buckets:
    """Word and shape bucket of each word of a text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.shapes: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        known = self.known
        if len(known) > MEMORY:
            known.clear()
            self.shapes.clear()
        for w in set(words).difference(known):
            kinds = w.translate(KINDS)
            shape = self.shapes.get(kinds)
            if shape is None:
                shape = self.shapes[kinds] = zlib.crc32(RUNS.sub(rb"\1", kinds)) % SHAPE_BUCKETS
            known[w] = zlib.crc32(w.lower()) % WORD_BUCKETS * SHAPE_BUCKETS + shape
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return both // SHAPE_BUCKETS, both % SHAPE_BUCKETS + WORD_BUCKETS


def add_contexts(total: np.ndarray, words: np.ndarray, shapes: np.ndarray, index: np.ndarray) -> None:
    """Add to each word's and shape's vector the index vectors of the words and shapes beside it."""
    if len(words) < 2:
        return
    beside = index[words] + index[shapes]
    near = np.zeros_like(beside)
    near[1:] += beside[:-1]
    near[:-1] += beside[1:]
    for at in (words, shapes):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        total[at[order][first]] += np.add.reduceat(near[order], first, axis=0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, 0 for buckets never seen."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(size > 0, vectors / np.maximum(size, 1e-12), 0).astype(np.float32)


def pooled(words: np.ndarray, shapes: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A document's vector: means and spreads of its word vectors and shape vectors, how alike
    neighbours are, and its length."""
    n = len(words)
    if not n:
        return np.zeros(5 * DIMENSIONS + 3)
    sums = np.zeros((3, DIMENSIONS))
    squares = np.zeros((2, DIMENSIONS))
    alike = same = 0.0
    for at in range(0, n, STRETCH):
        w, s = vectors[words[at : at + STRETCH + 1]], vectors[shapes[at : at + STRETCH]]
        if len(w) > 1:
            alike += float(np.einsum("ij,ij->", w[1:], w[:-1], dtype=np.float64))
            pair = words[at : at + STRETCH + 1]
            same += float((pair[1:] == pair[:-1]).sum())
        w = w[: len(s)]
        for k, x in enumerate((w, s)):
            sums[k] += x.sum(axis=0, dtype=np.float64)
            squares[k] += (x.astype(np.float64) ** 2).sum(axis=0)
        sums[2] += index[shapes[at : at + STRETCH]].sum(axis=0, dtype=np.float64)
    mean = sums / n
    spread = np.sqrt(np.maximum(squares / n - mean[:2] ** 2, 0))
    return np.concatenate([mean.ravel(), spread.ravel(), [alike / max(n - 1, 1), same / max(n - 1, 1), np.log1p(n)]])


@dataclass
class Network:
    """Two layers over standardised inputs, with the temperature of its probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean())


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Fit by Adam on four fifths of the rows; the temperature is fitted on the others."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5) if len(x) >= 10 else 0
    held, used = order[:cut], order[cut:]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    z = (x - mean) / scale
    parts = [net.w1, net.b1, net.w2, np.array([0.0])]
    m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(epochs):
        shuffled = rng.permutation(used)
        for at in range(0, len(shuffled), 256):
            rows = shuffled[at : at + 256]
            h = np.tanh(z[rows] @ parts[0] + parts[1])
            d = (1 / (1 + np.exp(-(h @ parts[2] + parts[3][0]))) - y[rows]) / len(rows)
            back = d[:, None] * parts[2] * (1 - h * h)
            grads = [z[rows].T @ back + decay * parts[0], back.sum(axis=0), h.T @ d + decay * parts[2], np.array([d.sum()])]
            step += 1
            for p, g, a, b in zip(parts, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(parts[3][0])
    if cut:
        logits = net.logits(x[held])
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(logits / t, y[held])))
    return net


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors over all texts of ``docs (id, text)``, as one table of fixed size.

    Every task adds up its own table; rows of the tables are summed by ranges of buckets.
    """

    def gather(batches):
        buckets, index = Buckets(), index_vectors()
        total = np.zeros((BUCKETS, DIMENSIONS), np.float64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words, shapes = buckets(text)
                for at in range(0, len(words), STRETCH):
                    # One word of overlap: every pair of neighbours is seen once.
                    part = slice(at, at + STRETCH + 1)
                    add_contexts(total, words[part], shapes[part], index)
        at = np.flatnonzero(total.any(axis=1))
        values = pa.array(total[at].ravel(), pa.float64())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * DIMENSIONS, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), rows], names=["bucket", "vector"])

    def add(key, part):
        at, where = np.unique(part["bucket"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(at), DIMENSIONS))
        np.add.at(sums, where, np.stack(part["vector"].to_numpy()))
        return pd.DataFrame({"bucket": at, "vector": list(sums)})

    schema = "bucket long, vector array<double>"
    texts = docs.select(F.encode(whole("text"), "UTF-8").alias("text"))
    partial = texts.mapInArrow(gather, schema)
    out = np.zeros((BUCKETS, DIMENSIONS))
    for r in partial.groupBy(F.floor(F.col("bucket") / 64).alias("range")).applyInPandas(add, schema).collect():
        # Whole numbers: sums do not depend on the order of the parts.
        out[r["bucket"]] = r["vector"]
    return unit_rows(out)


def document_vectors(docs: DataFrame, vectors: np.ndarray, network: Network | None = None) -> DataFrame:
    """``docs`` without its text, with ``score`` if a network is given, else with the pooled ``vector``."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    others = [c for c in docs.columns if c != "text"]
    base = docs.select(*others, F.encode(whole("text"), "UTF-8").alias("__text"))
    kind = T.ArrayType(T.DoubleType()) if network is None else T.DoubleType()
    name = "vector" if network is None else "score"

    def run(batches):
        vectors, network = shared.value
        buckets, index = Buckets(), index_vectors()
        for batch in batches:
            rows = [pooled(*buckets(t), vectors, index) for t in batch.column(batch.num_columns - 1).to_pylist()]
            if network is None:
                value = pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))
            else:
                # Row by row: a score does not depend on the rows beside it.
                value = pa.array([float(network.probability(r)) for r in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], value], names=[*others, name])

    schema = base.select(*others).schema.add(name, kind)
    return base.mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network | None:
    """Fit on at most ``FIT_ROWS`` rows of ``labels (id, quality)``; None without labelled texts."""
    marked = labels.filter("id is not null and quality is not null").groupBy("id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    rows = document_vectors(docs.join(F.broadcast(chosen), "id"), vectors).orderBy("id").toPandas()
    if not len(rows):
        return None
    return fit_network(np.stack(rows["vector"].to_numpy()), rows["quality"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, score)`` for every row of ``docs (id, text)``: the probability of label 1.

    Word vectors come from all texts, the network from a bounded sample of ``labels``. Null and
    empty texts have the zero vector and get its score; texts are read whole; repeated rows are
    scored each. Without labels every score is 0.5; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("id", "text")
    vectors = word_vectors(docs)
    network = fit_quality(docs, labels, vectors)
    if network is None:
        return docs.select("id", F.lit(0.5).alias("score"))
    return document_vectors(docs, vectors, network)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    labels = own_columns(spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id", "quality"])
    learnt = labels.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "quality")
    scored = score_quality(docs.select(F.col("doc_id").alias("id"), "text"), learnt)
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
