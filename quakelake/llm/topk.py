"""Exact inner-product search over vectors grouped by length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelake.llm.common import own_columns, stored
from quakelake.llm.registry import query

#: Values of one block of queries or vectors, and of one tile of scores.
BLOCK_VALUES = 1 << 20
TILE_VALUES = 1 << 22
#: Longest vectors whose products give each query its first lower bound.
SEEDS = 4096
#: Length buckets per doubling.
PER_DOUBLING = 8
#: Largest coordinates of a query that are tested before its full products.
FOCUS = 3
#: Share of a block above which one matrix product is cheaper than picking rows.
DENSE = 0.25


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; doubles hold them while they stay below 2^53."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * max(1, a.shape[1]) >= 2.0**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a @ b.T


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _lower_bounds(ids, q, seed_ids, seeds, k):
    """k-th best product with a seed other than the query itself; -inf where there are fewer."""
    scores = _products(q, seeds).astype(np.float64)
    scores[ids[:, None] == seed_ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(q), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _feasible(q_unit: np.ndarray, t: float, units: np.ndarray) -> np.ndarray:
    """Rows whose cosine with the query can reach ``t``, judged by its largest coordinates.

    Two unit vectors at an angle of at most acos(t) have coordinates within the band that the
    angles to the axis allow.
    """
    ok = np.ones(len(units), bool)
    for f in np.argsort(-np.abs(q_unit))[:FOCUS]:
        c = q_unit[f]
        width = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c)))
        if c > -t:
            ok &= units[:, f] >= c * t - width - 1e-9
        if c < t:
            ok &= units[:, f] <= c * t + width + 1e-9
    return ok


def _best(q_ids, v_ids, rows, cols, scores, k):
    """The k best of each query among (row, col, score) hits, equal scores to the smaller id."""
    order = np.lexsort((v_ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    first = np.searchsorted(rows, rows, "left")
    top = np.arange(len(rows)) - first < k
    return pd.DataFrame(
        {"query_id": q_ids[rows[top]], "vec_id": v_ids[cols[top]], "score": scores[top].astype(np.int64)}
    )


def search_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best hits of one block of queries in one block of vectors of like length."""
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    if not len(queries) or not len(vectors):
        return none
    q_ids, v_ids = queries["query_id"].to_numpy(np.int64), vectors["vec_id"].to_numpy(np.int64)
    q, v = _matrix(queries["vector"]), _matrix(vectors["vector"])
    bound = queries["bound"].to_numpy(np.float64)
    q_len, v_len = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    longest = v_len.max()
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(np.isfinite(bound) & (bound > 0), bound / (q_len * longest), -1.0)
    alive = np.flatnonzero(~(cosine > 1 + 1e-9))  # length: no vector here can reach the bound
    units = v / np.maximum(v_len, 1e-300)[:, None]
    found, dense = [], []
    for i in alive:
        t = min(cosine[i], 1.0)
        if t <= 0:
            dense.append(i)
            continue
        ok = _feasible(q[i] / q_len[i], t, units) & (v_len * q_len[i] >= bound[i] - 1e-6 * abs(bound[i]))
        if ok.mean() > DENSE:
            dense.append(i)
            continue
        cols = np.flatnonzero(ok)
        scores = _products(q[i : i + 1], v[cols])[0]
        good = (scores >= bound[i]) & (v_ids[cols] != q_ids[i])
        found.append((np.full(good.sum(), i), cols[good], scores[good]))
    step = max(1, TILE_VALUES // len(v))
    for at in range(0, len(dense), step):
        part = np.array(dense[at : at + step])
        scores = _products(q[part], v)
        least = bound[part]
        if not np.isfinite(least).all() and len(v) > k + 1:
            # One more than k: the query's own row may be among the best.
            kth = np.partition(scores, len(v) - k - 1, axis=1)[:, len(v) - k - 1]
            least = np.maximum(least, kth)
        good = (scores >= least[:, None]) & (v_ids[None, :] != q_ids[part][:, None])
        rows, cols = np.nonzero(good)
        found.append((part[rows], cols, scores[rows, cols]))
    if not found:
        return none
    rows, cols, scores = (np.concatenate(x) for x in zip(*found))
    return _best(q_ids, v_ids, rows, cols, scores, k)


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of every query.

    ``queries (query_id, vector)`` and ``vectors (vec_id, vector)`` hold integer vectors. Vectors
    are grouped by length and groups cut into blocks of bounded size, so one common length is many
    blocks. A query's bound is its k-th best product with the longest vectors, at most ``SEEDS`` of
    them; in every block it gives a local cosine threshold. Above 1 the block is skipped; else
    either the band of the query's largest coordinates or the lengths leave few rows to verify, or
    the whole block is multiplied. Blocks keep ``k`` rows per query before the last ranking. Both
    sides may grow: each block of queries meets each block of vectors in a task of its own.

    A vector is never its own partner; equal scores go to the smaller id; vectors of another
    dimension are no partners. Rows with a null id or vector take no part. A vector row that
    repeats is listed as often as it occurs; of repeated query ids the smallest vector is asked. An
    empty side gives no rows.
    """
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = vectors.filter("vec_id is not null and vector is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), "vector", F.size("vector").alias("dim"), length.alias("length")
    )
    bucket = F.floor(F.log2(F.col("length") + 1) * PER_DOUBLING).cast("int")
    v = stored(v.withColumn("bucket", bucket), "vectors")
    q = queries.filter("query_id is not null and vector is not null").groupBy(F.col("query_id").cast("long").alias("query_id"))
    q = q.agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))

    seeds = v.orderBy(F.desc("length"), "vec_id").limit(SEEDS).select("vec_id", "vector", "dim").toPandas()
    by_dim = {
        int(dim): (part["vec_id"].to_numpy(np.int64), _matrix(part["vector"])) for dim, part in seeds.groupby("dim")
    }
    shared = spark.sparkContext.broadcast(by_dim)

    def bounded(batches):
        for batch in batches:
            bounds = np.full(len(batch), -np.inf)
            for dim, rows in batch.groupby("dim").indices.items():
                if (got := shared.value.get(int(dim))) is not None and dim:
                    part = batch.iloc[rows]
                    for at in range(0, len(rows), 512):
                        one = part.iloc[at : at + 512]
                        bounds[rows[at : at + 512]] = _lower_bounds(
                            one["query_id"].to_numpy(np.int64), _matrix(one["vector"]), *got, k
                        )
            yield batch.assign(bound=bounds)

    kind = q.schema["vector"].dataType.simpleString()
    q = stored(q.mapInPandas(bounded, f"query_id long, vector {kind}, dim int, bound double"), "queries")

    # Counts per (dimension, bucket): few rows, whatever the input.
    sizes = v.groupBy("dim", "bucket").count().withColumn(
        "blocks", F.ceil(F.col("count") / F.greatest(F.lit(64), F.floor(F.lit(BLOCK_VALUES) / F.greatest("dim", F.lit(1)))))
    )
    asked = q.groupBy("dim").count().select(
        "dim",
        F.ceil(F.col("count") / F.greatest(F.lit(64), F.floor(F.lit(BLOCK_VALUES) / F.greatest("dim", F.lit(1))))).alias("q_blocks"),
    )
    grid = stored(sizes.join(asked, "dim"), "grid")
    v_side = (
        v.join(F.broadcast(grid.drop("count")), ["dim", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select("dim", "bucket", "block", "q_block", "vec_id", "vector")
    )
    q_side = (
        q.join(F.broadcast(grid.drop("count")), "dim")
        .withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "bucket", "block", "q_block", "query_id", "vector", "bound")
    )
    cell = ["dim", "bucket", "block", "q_block"]
    hits = (
        q_side.groupBy(*cell)
        .cogroup(v_side.groupBy(*cell))
        .applyInPandas(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op6_topk", OP6_SQL)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best partners of every vector whose id is divisible by 100."""
    table = own_columns(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id", "embedding"])
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ints = table.filter(sound).select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * 1024)).alias("vector"))
    asked = ints.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return exact_top_k(asked, ints)
