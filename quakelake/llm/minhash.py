"""Near-duplicates: an LSH forest proposes classes, full shingle sets confirm them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.llm.common import bounded_batches, discard, key_filter, may_hold, own_columns, stored, whole
from quakelake.llm.graph import connected_components
from quakelake.llm.registry import query

#: Sorted signature orders, and hashes in each; trees * depth hashes in all.
TREES, DEPTH = 16, 8
#: Common prefix in an order that makes rows candidates. A pair at similarity 0.8 shares it in some
#: order with probability 1 - (1 - 0.8^3)^16 > 0.99998.
SHALLOW = 3
#: Rows of a region compared as one; of larger regions every two blocks of about that size are.
REGION = 1_024
#: Documents of a candidate class in one block; pairs of blocks are confirmed in tasks of their own.
BLOCK = 256
#: Documents up to which sets are compared pair by pair rather than as a matrix.
FEW = 16
COLUMNS = 8_192

_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_matches(similarity: float) -> int:
    """Matching hashes, judged by four bits of each, below which a pair is no candidate.

    4.5 standard deviations under what a pair at the limit has.
    """
    n, p = TREES * DEPTH, similarity + (1 - similarity) / 16
    return int(n * p - 4.5 * (n * p * (1 - p)) ** 0.5)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, lower-casing A-Z.

    A text with fewer words is one shingle, a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = (out ^ h[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set."""
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(low, ((short[None, at : at + 512] ^ masks) * factors).min(axis=1), out=low)
    return low


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    n = TREES * DEPTH
    factors = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32)


def _rows(batches, width: int):
    factors, masks = _functions()
    factors = factors[:, None]
    for batch in batches:
        n, a, b, keys, marks = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, width)
            n.append(len(s))
            digest = xxhash.xxh3_128_digest(s.tobytes())
            a.append(int.from_bytes(digest[:8], "big", signed=True))
            b.append(int.from_bytes(digest[8:], "big", signed=True))
            low = signature(s, factors, masks)
            keys.append(low.astype(">u4").tobytes())
            four = (low >> np.uint32(7)).astype(np.uint8) & 15
            marks.append((four[0::2] * 16 + four[1::2]).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())],
            names=["id", "n", "fa", "fb", "keys", "marks"],
        )


# --- candidates: regions of equal prefix ---------------------------------------------------

_NIBBLES = np.uint64(0x1111111111111111)


def _matches(mark: np.ndarray, marks: np.ndarray) -> np.ndarray:
    x = marks ^ mark
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return TREES * DEPTH - np.bitwise_count(x & _NIBBLES).sum(axis=1, dtype=np.int64)


def _linked(nodes: np.ndarray, marks: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that connect the rows of a region whose sketches agree well enough, a forest of them."""
    edges, open_ = [], np.arange(len(nodes))
    while len(open_) > 1:
        frontier, open_ = [open_[0]], open_[1:]
        while frontier and len(open_):
            i = frontier.pop()
            near = _matches(marks[i], marks[open_]) >= least
            hit = open_[near]
            edges += [(int(nodes[i]), int(nodes[j])) for j in hit]
            frontier += hit.tolist()
            open_ = open_[~near]
    return edges


def region_edges(keys: np.ndarray, nodes: np.ndarray, marks: np.ndarray, least: int, depth: int = SHALLOW) -> list[tuple[int, int]]:
    """Candidate edges among rows sorted by key; rows that share their first ``depth`` values are compared wholly."""
    cuts = np.flatnonzero((keys[1:, :depth] != keys[:-1, :depth]).any(axis=1)) + 1
    edges = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(nodes)]):
        if b - a > 1:
            edges += _linked(nodes[a:b], marks[a:b], least)
    return edges


def _regions(batches, least: int):
    """Walk a sorted partition, unit by unit; the last one is carried to the next batch."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            unit = [batch.column(i).to_numpy().astype(np.int64)[:, None] for i in range(3)]
            prefix = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(-1, SHALLOW).astype(np.int64)
            marks = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(len(prefix), -1)
            rows = (np.hstack([*unit, prefix]), batch.column(5).to_numpy(), marks)
            held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows))
        if held is None or not len(held[1]):
            continue
        keys, nodes, marks = held
        last = len(nodes)
        if batch is not None:
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
        edges = region_edges(keys[:last], nodes[:last], marks[:last], least, keys.shape[1])
        held = (keys[last:], nodes[last:], marks[last:])
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


# --- confirmation on full sets ------------------------------------------------------------------


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= FEW:
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(shared.sum())
    for at in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((m, min(COLUMNS, total - at)), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def confirm(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join the rows of a block which exact links connect."""
    size = np.array([len(s) for s in sets], np.int64)
    shared = _overlaps(sets)
    link = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (shared > 0)
    np.fill_diagonal(link, True)
    label = np.arange(len(nodes))
    while True:
        following = np.where(link, label[None, :], len(nodes)).min(axis=1)
        following = np.minimum(following, following[following])
        if (following == label).all():
            break
        label = following
    return [(int(nodes[i]), int(nodes[k])) for i, k in enumerate(label) if i != k]


UNIT = ["tree", "x", "y", "prefix"]


def _units(trees: DataFrame) -> DataFrame:
    """Deal every region of ``tree`` and ``prefix`` to units that together compare all its pairs.

    A region up to ``REGION`` rows is one unit. A crowded one is cut into blocks by the hash of the
    id, and each two blocks are a unit, which also compares the pairs inside them.
    """
    regions = trees.groupBy("tree", "prefix").count().filter(F.col("count") > REGION)
    crowded = stored(regions.select("tree", "prefix", F.ceil(F.col("count") / REGION).cast("int").alias("blocks")), "crowded")
    salted = trees.join(crowded, ["tree", "prefix"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != F.col("own")) | (F.col("blocks") == 1))
    paired = salted.withColumn("own", own).withColumn("other", F.explode(others))
    return paired.select("tree", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "prefix", "marks", "id")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of distinct
    ``width``-word shingles; a component is named by its smallest id and keeps that document.

    Equal sets become one node first. Every node's signature is laid out in several orders. Rows
    with a common prefix of ``SHALLOW`` hashes in an order form a region, whose pairs are all
    compared; crowded regions are cut into pairs of blocks, so that no prefix, however common, is one
    task. Sketches decide which nodes belong to one candidate class. The classes are then confirmed on
    full sets: each class is cut into blocks, every pair of blocks is compared wholly, and the exact
    links give the components. Sets travel once per block pair of their own class; only forests of
    edges leave a task.

    Null and empty texts, and texts without words, have no shingle and are linked with nothing.
    Rows with a null id take part as texts; a component of such rows alone has a null id and keeps
    them. Rows that repeat an id are one document. An empty table gives no rows; other columns are
    ignored.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.encode(whole(f"`{text_col}`"), "UTF-8").alias("text"))
    rows = stored(
        docs.mapInArrow(lambda b: _rows(b, width), "id long, n long, fa long, fb long, keys binary, marks binary"), "signatures"
    )
    filled = rows.filter("n > 0")
    reps = stored(filled.groupBy("fa", "fb").agg(F.min("id").alias("rep"), F.max("n").alias("n")).filter("rep is not null"), "nodes")
    nodes = filled.join(reps.select("fa", "fb", F.col("rep").alias("id")), ["fa", "fb", "id"], "left_semi")

    trees = nodes.select("id", "keys", "marks", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree", F.substring("keys", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * SHALLOW)).alias("prefix"), "marks", "id"
    )
    least = least_matches(percent / 100)
    forest = _units(trees).repartition(*UNIT).sortWithinPartitions(*UNIT)
    candidates = stored(forest.mapInArrow(lambda b: _regions(b, least), "a long, b long").filter("a <> b").distinct(), "candidates")
    classes = stored(connected_components(candidates, "a", "b"), "classes")
    discard(candidates)

    blocks = classes.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = classes.join(blocks, "component")
    wanted = key_filter(classes, F.col("node"))
    maybe = may_hold(docs.filter("id is not null"), wanted, "__maybe", F.col("id")).filter("__maybe").select("id", "text")

    def sets(batches):
        for batch in batches:
            held = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.large_binary()).cast(pa.binary())], names=["id", "shingles"])

    full = maybe.mapInArrow(sets, "id long, shingles binary").filter(F.length("shingles") > 0)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        full.join(placed.withColumnRenamed("node", "id"), "id")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "shingles")
    )

    def check(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        arrays = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
        return pd.DataFrame(confirm(part["id"].to_numpy(), arrays, percent), columns=["a", "b"]).astype("int64")

    links = dealt.groupBy("component", "x", "y").applyInPandas(check, "a long, b long")
    found = stored(connected_components(links, "a", "b"), "components")

    labels = reps.join(found, F.col("rep") == F.col("node"), "left").select("fa", "fb", F.coalesce("component", "rep").alias("component_id"))
    joined = filled.select("id", "n", "fa", "fb").join(labels, ["fa", "fb"], "left").select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(x) < 4 THEN array_to_string(x, ' ') ELSE array_to_string(x[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 2, 2))) AS i FROM w WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


@query("op3_minhash", OP3_SQL)
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share four fifths of their four-word shingles."""
    docs = own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    return near_duplicates(docs, width=4)
