"""Hard negatives: Hilbert-ordered blocks of candidates with zone maps, read where score intervals allow."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelake.llm.common import bounded_batches, numbered, own_columns, stored
from quakelake.llm.registry import query
from quakelake.llm.topk import _products as products

#: Coordinates of greatest variance that the curve runs through, and bits of each.
AXES, BITS = 12, 5
#: Bits of the number of rows in a block, of blocks in a page of zone maps, of anchors in a group.
BLOCK_BITS, PAGE_BITS, GROUP_BITS = 10, 11, 11
#: Scores held at once.
TILE_VALUES = 1 << 20


# --- the curve ----------------------------------------------------------------------------------


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every cell (row of coordinates below ``2**bits``) on the Hilbert curve.

    The coordinates are turned into the curve's own by undoing its rotations from the highest bit
    down, then by Gray coding; their bits, taken in turns, are the place.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in x:
            high = axis >> bit & 1 == 1
            swap = np.where(high, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(high, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = reduce(np.bitwise_xor, [np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0) for bit in range(1, bits)], np.zeros(x.shape[1], np.int64))
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | axis >> bit & 1
    return place


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch, vectors: int, dims: int):
    """(dimension, row numbers, matrix) of a batch."""
    sizes = batch.column(dims).to_numpy()
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, _matrix(batch.column(vectors).take(pa.array(rows)), int(dim))


def _spread(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of every coordinate, per dimension of the vectors: a few numbers in all."""

    def partial(batches):
        for batch in batches:
            for dim, _, x in _by_dim(batch, 0, 1):
                n = np.full(dim, len(x), np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (np.full(dim, dim), np.arange(dim), n, x.sum(0), (x * x).sum(0))], names=["dim", "place", "n", "s", "q"]
                )

    found = rows.select("x", "dim").mapInArrow(partial, "dim long, place long, n double, s double, q double")
    sums = found.groupBy("dim", "place").agg(*[F.sum(c).alias(c) for c in "nsq"]).orderBy("dim", "place").toPandas()
    out = {}
    for dim, part in sums.groupby("dim"):
        mean = (part["s"] / part["n"]).to_numpy()
        out[int(dim)] = mean, np.sqrt(np.maximum((part["q"] / part["n"]).to_numpy() - mean * mean, 0))
    return out


def _places(rows: DataFrame) -> DataFrame:
    """Add ``place``, the position on the curve through the cells of the widest coordinates."""
    spread = _spread(rows)

    def run(batches):
        for batch in batches:
            place = np.zeros(batch.num_rows, np.int64)
            for dim, at, x in _by_dim(batch, 2, 3):
                if dim:
                    mean, deviation = spread[dim]
                    axes = np.argsort(-deviation, kind="stable")[:AXES]
                    scaled = (x[:, axes] - mean[axes]) / np.maximum(deviation[axes], 1e-300)
                    cells = np.clip((scaled + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                    place[at] = hilbert(cells, BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(run, "id long, label long, x array<bigint>, dim int, place long")


# --- zone maps ----------------------------------------------------------------------------------


def _zones(blocks: DataFrame) -> DataFrame:
    """``(block, dim, lo, hi, labels)``: least and greatest value per coordinate, and the labels.

    Each task maps what it reads of a block; the few parts of one block are merged after it.
    """
    zone_type = "block long, dim int, lo array<double>, hi array<double>, labels array<bigint>"
    lists = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]

    def partial(batches):
        for batch in batches:
            number = batch.column(0).to_numpy()
            labels = batch.column(1).to_numpy()
            out = []
            for dim, at, x in _by_dim(batch, 2, 3):
                for b in np.unique(number[at]):
                    mine = number[at] == b
                    out.append((b, dim, x[mine].min(0), x[mine].max(0), np.unique(labels[at][mine])))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.int32(), *lists])], names=["block", "dim", "lo", "hi", "labels"]
            )

    parts = blocks.select("block", "label", "x", "dim").mapInArrow(partial, zone_type)

    def each(name: str, pick) -> Column:
        return F.reduce(F.slice(name, 2, F.size(name)), F.element_at(name, 1), lambda a, b: F.zip_with(a, b, pick))

    found = parts.groupBy("block", "dim").agg(*[F.collect_list(c).alias(c) for c in ("lo", "hi", "labels")])
    return found.select("block", "dim", each("lo", lambda a, b: F.least(a, b)).alias("lo"), each("hi", lambda a, b: F.greatest(a, b)).alias("hi"), F.array_distinct(F.flatten("labels")).alias("labels"))


def bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: least and greatest product of every vector with any point of every box.

    They are widened by more than the rounding of doubles, so no reachable score is outside.
    """
    plus, minus = np.maximum(x, 0), np.minimum(x, 0)
    least, most = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
    slack = 1e-9 * (np.abs(x) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1e-6
    return least - slack, most + slack


def reachable(x, label, lows, highs, zone_lo, zone_hi, zone_labels, same: bool) -> np.ndarray:
    """Which anchors (rows) need which blocks (columns): some window meets the block's interval and
    the block holds a label that counts."""
    least, most = bounds(x, zone_lo, zone_hi)
    need = np.zeros(least.shape, bool)
    for j in range(lows.shape[1]):
        need |= (most >= lows[:, j, None]) & (least <= highs[:, j, None])
    for column, labels in enumerate(zone_labels):
        if same:
            need[:, column] &= np.isin(label, labels)
        elif len(labels) == 1:
            need[:, column] &= label != labels[0]
    return need


# --- scores of anchors in blocks ----------------------------------------------------------------


def best_in_block(rows, x, label, lows, highs, v_rows, v, v_ids, v_labels, k: int, same: bool):
    """The k best hits of every anchor and window among the rows of a block.

    Gives (anchor number, window, row of the block, score) as four arrays.
    """
    found = []
    step = max(1, TILE_VALUES // max(1, len(v)))
    for at in range(0, len(x), step):
        scores = products(x[at : at + step], v)
        fit = (label[at : at + step, None] == v_labels[None, :]) == same
        fit &= rows[at : at + step, None] != v_rows[None, :]
        for j in range(lows.shape[1]):
            ok = fit & (scores >= lows[at : at + step, j, None]) & (scores <= highs[at : at + step, j, None])
            if len(v) > k:
                held = np.where(ok, scores, np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf)
                ok &= scores >= np.partition(held, len(v) - k, axis=1)[:, len(v) - k, None]
            i, c = np.nonzero(ok)
            s = scores[i, c]
            order = np.lexsort((v_ids[c], -s, i))
            i, c, s = i[order], c[order], s[order]
            top = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
            found.append((i[top] + at, np.full(top.sum(), j), c[top], s[top].astype(np.int64)))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def _windows(table: pa.Table | pa.RecordBatch, name: str, n: int, fill: float) -> np.ndarray:
    """Lists of window ends as a matrix of ``n`` columns; missing ones are ``fill``, an empty window."""
    out = np.full((table.num_rows, n), fill)
    for i, ends in enumerate(table[name].to_pylist()):
        out[i, : len(ends)] = ends
    return out


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _scored(asked: DataFrame, cells: DataFrame, blocks: DataFrame, k: int, windows: int, same: bool) -> DataFrame:
    """``(anchor_row, win, other_row, other, score)``: the k best of every window over all wanted cells.

    ``cells (block, group, dim, wanted)`` names the anchors of a group that need a block.
    """

    def hits(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["anchor_row", "win", "other_row", "other", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        wanted = np.isin(left["anchor_row"].to_numpy(), np.array(left["wanted"][0].as_py(), np.int64))
        left = left.filter(pa.array(wanted))
        dim = right["dim"][0].as_py()
        rows, v_rows, v_ids = left["anchor_row"].to_numpy(), right["row"].to_numpy(), right["id"].to_numpy()
        i, win, c, s = best_in_block(
            rows,
            _matrix(_whole(left["x"]), dim),
            left["label"].to_numpy(),
            _windows(left, "lows", windows, np.inf),
            _windows(left, "highs", windows, -np.inf),
            v_rows,
            _matrix(_whole(right["x"]), dim),
            v_ids,
            right["label"].to_numpy(),
            k,
            same,
        )
        return pa.table([pa.array(a, t) for a, t in zip((rows[i], win, v_rows[c], v_ids[c], s), types)], names=names)

    left = cells.join(asked, ["group", "dim"]).select("block", "group", "dim", "wanted", "anchor_row", "label", "x", "lows", "highs")
    right = cells.select("block", "group", "dim").join(blocks, ["block", "dim"]).select("block", "group", "dim", "row", "id", "label", "x")
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same cells
    cell = ["block", "group", "dim"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(hits, "anchor_row long, win int, other_row long, other long, score long")
    best = Window.partitionBy("anchor_row", "win").orderBy(F.desc("score"), "other", "other_row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _cells(asked: DataFrame, groups: int, zones: DataFrame, pages: int, windows: int, same: bool) -> DataFrame:
    """The cells (block, group of anchors) whose score interval meets a window of some anchor.

    Pages of zone maps meet groups of anchors; blocks themselves are not touched.
    """

    def need(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dim, group = left["dim"][0].as_py(), left["group"][0].as_py()
            x, label, rows = _matrix(_whole(left["x"]), dim), left["label"].to_numpy(), left["anchor_row"].to_numpy()
            lows, highs = _windows(left, "lows", windows, np.inf), _windows(left, "highs", windows, -np.inf)
            number = right["block"].to_numpy()
            lo, hi = (_matrix(_whole(right[n]), dim) for n in ("lo", "hi"))
            labels = [np.array(part) for part in right["labels"].to_pylist()]
            step = max(1, TILE_VALUES // len(x))
            for at in range(0, len(lo), step):
                wanted = reachable(x, label, lows, highs, lo[at : at + step], hi[at : at + step], labels[at : at + step], same)
                out += [(number[at + c], group, dim, rows[wanted[:, c]]) for c in np.flatnonzero(wanted.any(axis=0))]
        columns = list(zip(*out)) or [[]] * 4
        types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=["block", "group", "dim", "wanted"])

    left = asked.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
    right = zones.withColumn("page", F.shiftright("block", PAGE_BITS)).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    cell = ["group", "page", "dim"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(need, "block long, group long, dim int, wanted array<bigint>")
    return stored(found, "cells")


def _first_bounds(blocks: DataFrame, anchor: Column, k: int) -> DataFrame:
    """Anchors with the k-th best score of their label in what one task reads of their own block.

    Any rows give a valid lower bound; those that the curve puts beside an anchor give a good one.
    """

    def run(batches):
        for batch in batches:
            number, asks = batch.column(0).to_numpy(), batch.column(6).to_numpy(zero_copy_only=False)
            ids, labels, rows = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(1).to_numpy()
            bound = np.full(batch.num_rows, -np.inf)
            for _, at, x in _by_dim(batch, 4, 5):
                for b in np.unique(number[at][asks[at]]):
                    mine = np.flatnonzero(number[at] == b)
                    who = mine[asks[at][mine]]
                    ends = np.full((len(who), 1), np.inf)
                    i, _, _, s = best_in_block(rows[at][who], x[who], labels[at][who], -ends, ends, rows[at][mine], x[mine], ids[at][mine], labels[at][mine], k, True)
                    full = np.bincount(i, minlength=len(who)) == k
                    last = np.searchsorted(i, np.arange(len(who)), "right") - 1
                    bound[at[who[full]]] = s[last[full]]
            keep = np.flatnonzero(asks)
            picked = batch.take(pa.array(keep))
            lows = pa.array([[b] for b in bound[keep]], pa.list_(pa.float64()))
            highs = pa.array([[np.inf]] * len(keep), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[picked.column(i) for i in (1, 2, 3, 4, 5, 0)], lows, highs], names=["anchor_row", "id", "label", "x", "dim", "own", "lows", "highs"])

    read = blocks.select("block", "row", "id", "label", "x", "dim", F.coalesce(anchor, F.lit(False)).alias("asks"))
    return read.mapInArrow(run, "anchor_row long, id long, label long, x array<bigint>, dim int, own long, lows array<double>, highs array<double>")


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "vector",
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vector_col`` holds integer vectors; scores are inner products. ``anchor`` is a condition over
    the column ``id``. An anchor's positives are its best other rows of the same label; for each, the
    best rows of another label are listed whose score lies between the two percentages of the
    positive's. Higher scores come first, equal ones by smaller id.

    Candidates are written as Parquet in the order of a Hilbert curve, in blocks with a zone map: the
    least and greatest value of each coordinate and the labels. Interval arithmetic gives the range
    of scores that an anchor can have in a block, and only blocks whose range meets a window are read.
    The windows start from bounds found in the anchor's own block: the score of its k-th best row
    there. Zone maps meet anchors in pages and groups of bounded size, blocks meet groups likewise, so
    neither side is sent anywhere whole. Results are exact whatever the boxes; on vectors without
    clusters the boxes are wide and most blocks are read.

    Rows with a null id, label or vector, or a null in the vector take no part. Rows that share an id
    are rows of their own: each other's partners, and listed as often as they occur. Vectors of
    another dimension are no partners. Fewer partners than wanted: all. An empty table, and one
    without anchors, gives no rows; other columns are ignored.
    """
    bounded_batches(df.sparkSession)
    names = [F.col(f"`{c}`") for c in (id_col, label_col, vector_col)]
    rows = df.select(names[0].cast("long").alias("id"), names[1].cast("long").alias("label"), names[2].cast("array<bigint>").alias("x"))
    sound = rows.dropna().filter(~F.exists("x", lambda e: e.isNull())).withColumn("dim", F.size("x"))
    blocks, total = numbered(_places(sound), ["dim", "place", "id"], "vectors", "row")
    blocks = blocks.withColumn("block", F.shiftright("row", BLOCK_BITS))
    zones = stored(_zones(blocks), "zones")
    pages = max(1, -(-total // (1 << BLOCK_BITS + PAGE_BITS)))

    asked, count = numbered(_first_bounds(blocks, anchor, positives), ["anchor_row"], "anchors", "n")
    groups = max(1, -(-count // (1 << GROUP_BITS)))
    asked = asked.withColumn("group", F.shiftright("n", GROUP_BITS)).drop("n")
    alike = stored(_scored(asked, _cells(asked, groups, zones, pages, 1, True), blocks, positives, 1, True), "positives")

    def down(percent: int) -> Column:
        return F.expr(f"({percent} * score - pmod({percent} * score, 100)) div 100")

    def up(percent: int) -> Column:
        return F.expr(f"({percent} * score + pmod(-{percent} * score, 100)) div 100")

    ends = alike.select("anchor_row", "rank", up(least_percent).cast("double").alias("low"), down(most_percent).cast("double").alias("high"))
    listed = ends.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    lows, highs = F.transform("w", lambda x: x["low"]), F.transform("w", lambda x: x["high"])
    windows = asked.drop("lows", "highs").join(listed, "anchor_row").select("*", lows.alias("lows"), highs.alias("highs")).drop("w")
    windows = stored(windows, "windows")
    own = windows.groupBy(F.col("own").alias("block"), "group", "dim").agg(F.collect_list("anchor_row").alias("wanted"))
    near = _scored(windows, own, blocks, negatives, positives, False)
    kth = near.groupBy("anchor_row", "win").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == negatives)
    raised = kth.groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("win", "kth"))).alias("at_least"))
    higher = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.element_at("at_least", i).cast("double"), x)))
    windows = windows.join(raised, "anchor_row", "left").withColumn("lows", higher).drop("at_least")
    windows = stored(windows, "windows")
    unlike = _scored(windows, _cells(windows, groups, zones, pages, positives, False), blocks, negatives, positives, False)

    pos = alike.select("anchor_row", (F.col("rank") - 1).alias("win"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = unlike.select("anchor_row", "win", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asked.select("anchor_row", F.col("id").alias("anchor_id"))
    return neg.join(pos, ["anchor_row", "win"]).join(ids, "anchor_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS a, a.vec_id AS anchor_id, c.k AS c, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.k <> c.k AND len(a.e) = len(c.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for five positives of every vector whose id is divisible by 100."""
    table = own_columns(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id", "label", "embedding"])
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ints = table.filter(sound).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform(x, lambda e: F.floor(e.cast("double") * 256)).alias("vector"),
    )
    return hard_negatives(ints, F.col("id") % 100 == 0)
