"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakelake.llm.common import add_by_arrow, bounded_batches, own_columns, whole
from quakelake.llm.registry import query

#: Confirmed toxic texts and unlabelled texts that the classifier is fitted on at most.
FIT_POSITIVE = 8_000
FIT_UNLABELLED = 24_000
#: Features of the fitted positives that are counted in the corpus, and those the classifier keeps.
CANDIDATES = 50_000
FEATURES = 1_024
LEAST_TEXTS = 4
#: How many times likelier a feature must be in toxic texts than in all others.
LIFT = 3.0
#: Standard deviations that its count in toxic texts must be above what the other texts suggest.
SURE = 8.0
THRESHOLD = 0.7
#: Bytes at the edges of a word that do not belong to it.
EDGES = b".,;:!?\"'()[]{}<>*#$%&|/\\-_~+="
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5)


def features_of(text: bytes) -> set[bytes]:
    """Distinct words, lower-cased without punctuation at their edges, and their beginnings."""
    found = {w.strip(EDGES) for w in set(text.lower().split())}
    found.discard(b"")
    for n in STEMS:
        found.update([w[:n] + b"~" for w in found if len(w) > n and w[-1:] != b"~"])
    return found


@dataclass
class Classifier:
    """Features and their weights; scores are probabilities."""

    index: dict[bytes, int]
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        hits = self.index.keys() & features_of(text)
        # A fixed order: sums do not depend on how sets are laid out.
        at = sorted(self.index[f] for f in hits)
        return float(1 / (1 + np.exp(-(self.bias + self.weights[at].sum()))))


def fit_non_negative(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, epochs: int = 200, rate: float = 0.05, decay: float = 1e-6):
    """Weights and bias of a logistic classifier under the non-negative PU risk.

    Risk: prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]). Where the second
    part, the risk on negatives, falls below zero on a batch, it counts as zero and only the first
    part is followed, so that the classifier cannot win by driving it down without end.
    """
    rng = np.random.default_rng(7)
    w, b = np.zeros(x_pos.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    batches = max(1, -(-len(x_unl) // 2048))
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(x_pos)), rng.permutation(len(x_unl))
        for p, u in zip(np.array_split(p_order, batches), np.array_split(u_order, batches)):
            if not len(p) or not len(u):
                continue
            xp, xu = x_pos[p].astype(np.float64), x_unl[u].astype(np.float64)
            zp, zu = xp @ w + b, xu @ w + b
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            grad_pos = prior * (sp - 1) / len(p)
            grad_neg_p, grad_neg_u = -prior * sp / len(p), su / len(u)
            if negative >= 0:
                gp, gu = grad_pos + grad_neg_p, grad_neg_u
            else:
                gp, gu = grad_pos, np.zeros(len(u))
            g = np.append(xp.T @ gp + xu.T @ gu + decay * w, gp.sum() + gu.sum())
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            # Features are signs of toxicity: none speaks against it.
            w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, b


def _texts(df: DataFrame) -> DataFrame:
    return df.select("id", F.encode(whole("text"), "UTF-8").alias("text"))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.uint8)
    for i, r in enumerate(rows):
        out[i, r["at"]] = 1
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on ``docs (id, text)`` and ``labels (id, toxic)``, labels that may be learnt from only.

    Confirmed toxic texts, at most ``FIT_POSITIVE`` of them in hash order, give the candidate
    features; how many texts of the whole corpus hold each is counted in one pass, and those most
    over-represented in toxic texts are kept. The class prior is the toxic share of all labels
    given. Without a toxic label every score is 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = labels.filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = marked.agg(F.avg("toxic"), F.sum("toxic")).head()
    if not share[1]:
        return Classifier({}, np.zeros(0), -np.inf)
    prior = min(max(float(share[0]), 1e-3), 0.5)
    chosen = marked.filter("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(FIT_POSITIVE).select("id")
    positive = _texts(docs.join(F.broadcast(chosen), "id"))

    def counted(batches):
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(1).to_pylist():
                seen.update(features_of(t))
            seen[b""] = batch.num_rows  # no feature is empty
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"]
            )

    by_feature = positive.mapInArrow(counted, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    top = by_feature.orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()
    n_pos = next((r["n"] for r in top if not r["feature"]), 0)
    top = [r for r in top if r["feature"]]
    if not top:
        return Classifier({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    names = [bytes(r["feature"]) for r in top]
    shared = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def in_corpus(batches):
        index, total = shared.value, np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for t in batch.column(1).to_pylist():
                total[[index[f] for f in index.keys() & features_of(t)]] += 1
            total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    corpus = np.zeros(len(names) + 1)
    for r in _texts(docs).mapInArrow(in_corpus, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        corpus[r["at"]] = r["n"]
    in_p = np.array([r["n"] for r in top], float)
    rest = np.maximum(corpus[:-1] - in_p, 0)
    p_rate, u_rate = (in_p + 0.5) / (n_pos + 1), (rest + 0.5) / (max(corpus[-1] - n_pos, 0) + 1)
    sure = in_p - n_pos * u_rate > SURE * np.sqrt(n_pos * u_rate)
    gain = np.where(sure & (p_rate > LIFT * u_rate), p_rate * np.log(p_rate / u_rate), -np.inf)
    kept = [i for i in np.argsort(-gain, kind="stable")[:FEATURES] if gain[i] > 0]
    index = {names[i]: k for k, i in enumerate(kept)}
    shared_index = spark.sparkContext.broadcast(index)

    def sparse(batches):
        index = shared_index.value
        for batch in batches:
            hits = [sorted(index[f] for f in index.keys() & features_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32()))], names=["at"])

    pos_rows = positive.mapInArrow(sparse, "at array<int>").collect()
    parts = 1 << 20
    bound = int(min(parts, parts * FIT_UNLABELLED / max(corpus[-1], 1)))
    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) < bound)
    unl_rows = _texts(some).mapInArrow(sparse, "at array<int>").limit(2 * FIT_UNLABELLED).collect()
    if not pos_rows or not unl_rows:
        return Classifier({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    w, b = fit_non_negative(_matrix(pos_rows, len(index)), _matrix(unl_rows, len(index)), prior)
    return Classifier(index, w, b)


def score_toxicity(docs: DataFrame, model: Classifier, name: str = "score") -> DataFrame:
    """Add the probability that each text of ``docs`` is toxic; ``docs`` keeps its columns.

    The classifier's size is fixed by ``FEATURES``. Null and empty texts have no feature and get
    the base score; texts are read whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda column: pa.array([shared.value.score(t) for t in column.to_pylist()], pa.float64())

    return add_by_arrow(docs, F.encode(whole("text"), "UTF-8"), name, T.DoubleType(), make)


def held_out(doc_id: Column) -> Column:
    """A third of the documents, whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_on_tables(docs: DataFrame, sf_dir: str) -> Classifier:
    """Fit on ``doc_id`` and ``text`` of the given documents and the labels of all but a third."""
    labels = own_columns(docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id", "toxic"])
    learnt = labels.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "toxic")
    corpus = docs.select(F.col("doc_id").alias("id"), "text").filter(~held_out(F.col("id")))
    return fit(corpus, learnt)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    scored = score_toxicity(docs, fit_on_tables(docs, sf_dir))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
