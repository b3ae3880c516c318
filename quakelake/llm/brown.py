"""Class-based n-gram scores: words in classes by exchange clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.llm.common import bounded_batches, discard, own_columns, stored, whole
from quakelake.llm.registry import query

#: Most frequent words, whose exchange sees every move; all others are exchanged in rounds.
CORE = 600
CLASSES = 48
SWEEPS = 6
#: Rounds in which every other word takes the class that fits its neighbours best.
ROUNDS = 1
#: Classes of what may stand beside a word: the bound of texts, and words without a class as yet.
BOUND, OTHER = CLASSES, CLASSES + 1
SIDES = CLASSES + 2
#: Words, and bytes of each, whose classes and counts are sent to every task; all others are joined.
FREQUENT = 200_000
LONGEST = 64
#: Words that a task gathers before it hands on their counts.
HELD = 1_000_000
#: Weight of the class frequencies in a transition.
PRIOR = 8.0
#: What is taken off a word's own neighbours, and how many usual ones it gets.
DISCOUNT = 0.75
USUAL = 1.0
#: A token whose class a join tells, in a text's sequence of classes.
HOLE = 255


def text_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All words of ``texts``, A-Z lower-cased, one after the other, and the text that each is in."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    row, words = pc.list_parent_indices(split), split.flatten()
    # White space at an end of a text leaves an empty word there.
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full, min_count=0).as_py():
        row, words = row.filter(full), words.filter(full)
    return row.to_numpy(), words.view(pa.binary())


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of every word in ``known``, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of the numbers up to each of ``ends``."""
    offsets = np.append(0, ends * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(cells: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary values one after the other, and the row that each is in."""
    wide = np.dtype(kind).itemsize
    if not len(cells):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, ends, held = cells.buffers()
    ends = np.frombuffer(ends, np.int32)[cells.offset : cells.offset + len(cells) + 1]
    values = np.frombuffer(held or b"", kind, (ends[-1] - ends[0]) // wide, ends[0])
    return values, np.repeat(np.arange(len(cells)), np.diff(ends) // wide)


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts of ``docs (text)``, A-Z lower-cased."""

    def count(batches):
        held, size = [], 0

        def flush():
            found = pa.chunked_array(held, pa.binary()).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays(found.flatten(), names=["word", "n"])

        for batch in batches:
            _, words = text_words(batch.column(0))
            held.append(words)
            size += len(words)
            if size > HELD:
                yield flush()
                size = 0
        yield flush()

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> pd.DataFrame:
    """The most frequent words in order, at most ``most``: those above a count that a histogram gives.

    The histogram has a few hundred rows, sixteen to a doubling of the count, so no task gathers the
    top words of all others.
    """
    step = F.floor(F.log2("n") * 16)
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    top = counts.filter(step >= least if least is not None else F.lit(False)).toPandas()
    return top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def unit_bigrams(docs: DataFrame, unit_of: dict[bytes, int], units: int) -> np.ndarray:
    """How often each unit follows each other one: a matrix of fixed size.

    The last two units are the bound of texts and all words without a unit.
    """
    bound, other = units - 2, units - 1
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(list(unit_of), pa.binary()), np.array([*unit_of.values(), other], np.int64)))

    def count(batches):
        known, unit = shared.value
        total = np.zeros(units * units, np.int64)
        for batch in batches:
            row, words = text_words(batch.column(0))
            total += _steps(chain(unit[_places(words, known)], row, batch.num_rows, bound)[0], units)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    return _matrix(docs.mapInArrow(count, "at long, n long"), units)


def chain(values: np.ndarray, row: np.ndarray, rows: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of all texts one after the other, a bound before, between and after texts; the place of each."""
    place = np.arange(len(values)) + row + 1
    out = np.full(len(values) + rows + 1, bound, np.int64)
    out[place] = values
    return out, place


def _steps(at: np.ndarray, size: int) -> np.ndarray:
    """How often each value below ``size`` follows each other one."""
    return np.bincount(at[:-1] * size + at[1:], minlength=size * size)


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    """A square matrix of fixed size from counts ``(at, n)`` of its cells."""
    out = np.zeros(size * size)
    counts = cells.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[counts["at"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, fixed: int = 1) -> np.ndarray:
    """Class of every unit; the last ``fixed`` units keep classes of their own.

    Units start in the order of frequency, dealt to the classes in turn. Each sweep takes every unit
    out of its class and puts it where the likelihood of the class bigrams grows most, until no unit
    moves. The work depends on the number of units and classes only.
    """
    n = len(pairs)
    order = [u for u in np.argsort(-pairs.sum(axis=1), kind="stable") if u < n - fixed]
    of = np.arange(n) - (n - fixed) + classes
    of[order] = np.arange(len(order)) % classes
    member = np.zeros((n, classes + fixed))
    member[np.arange(n), of] = 1
    between = member.T @ pairs @ member
    right_of = pairs @ member  # unit to following class
    left_of = pairs.T @ member  # unit to preceding class
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, r, l, s = of[u], right_of[u].copy(), left_of[u].copy(), pairs[u, u]
            if not r.sum() + l.sum():
                continue
            between[a, :] -= r
            between[:, a] -= l
            between[a, a] += s
            r[a] -= s
            l[a] -= s
            # Wherever the unit goes, the other classes get back their steps to and from it.
            rows, cols = between.sum(axis=1) + l, between.sum(axis=0) + r
            own = np.diag(between)
            gain = (_xlogx(between + r[None, :]) - _xlogx(between)).sum(axis=1) + (_xlogx(between + l[:, None]) - _xlogx(between)).sum(axis=0)
            gain -= _xlogx(own + r) + _xlogx(own + l) - 2 * _xlogx(own)
            gain += _xlogx(own + r + l + s) - _xlogx(own)
            gain -= _xlogx(rows + r.sum() + s) - _xlogx(rows) + _xlogx(cols + l.sum() + s) - _xlogx(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            between[b, :] += r
            between[:, b] += l
            between[b, b] += s
            if b != a:
                moved += 1
                of[u] = b
                right_of[:, a] -= pairs[:, u]
                right_of[:, b] += pairs[:, u]
                left_of[:, a] -= pairs[u, :]
                left_of[:, b] += pairs[u, :]
        if not moved:
            break
    return of


def neighbours(texts: DataFrame, class_of: dict[bytes, int], core: int) -> DataFrame:
    """``(word, only, sides, counts)`` for every word of ``texts (text)`` but the ``core`` first of ``class_of``.

    A side is the class before the word, times ``SIDES``, and the class after it. The distinct sides
    of a word, at most ``SIDES`` squared, and how often it has each are packed into binary values, so
    that a row is a word and not an occurrence; ``only`` is the side of a word seen once.
    """
    shared = texts.sparkSession.sparkContext.broadcast((pa.array(list(class_of), pa.binary()), np.array([*class_of.values(), OTHER], np.int64)))

    def rows(words: pa.Array, key: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        """A row for each of ``words``, from sorted keys: its place times ``SIDES`` squared, and a side."""
        ends = np.searchsorted(key, np.arange(1, len(words) + 1) * SIDES**2)
        return [words, _packed((key % SIDES**2).astype("<u2"), ends), _packed(n.astype("<i8"), ends)]

    def count(batches):
        known, classes = shared.value
        for batch in batches:
            row, words = text_words(batch.column(0))
            place = _places(words, known)
            at, here = chain(classes[place], row, batch.num_rows, BOUND)
            is_open = (place < 0) | (place >= core)
            here = here[is_open]
            held = words.filter(pa.array(is_open)).dictionary_encode()
            key, n = np.unique(held.indices.to_numpy().astype(np.int64) * SIDES**2 + at[here - 1] * SIDES + at[here + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays(rows(held.dictionary, key, n), names=["word", "sides", "counts"])

    def merge(batches):
        """Words of one hash follow each other; those of the last one may go on in the next batch."""

        def summed(parts):
            words, sides, counts = (pa.concat_arrays([p.column(k) for p in parts]) for k in (1, 2, 3))
            held = words.dictionary_encode()
            side, row = _unpacked(sides, "<u2")
            key, same = np.unique(held.indices.to_numpy().astype(np.int64)[row] * SIDES**2 + side, return_inverse=True)
            n = np.bincount(same, _unpacked(counts, "<i8")[0], len(key)).astype(np.int64)
            return held.dictionary, key, n

        def done(parts):
            words, key, n = summed(parts)
            made = rows(words, key, n)
            first = np.searchsorted(key, np.arange(len(words)) * SIDES**2)
            once = (pc.binary_length(made[1]).to_numpy() == 2) & (n[first] == 1)
            only = pa.array((key[first] % SIDES**2).astype(np.int32), mask=~once)
            return pa.RecordBatch.from_arrays([made[0], only, *made[1:]], names=["word", "only", "sides", "counts"])

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(hashes == hashes[-1])[0])
            if cut or hashes[-1] != last:
                parts = [p for p in (*held, batch.slice(0, cut)) if p.num_rows]
                if parts:
                    yield done(parts)
                held = []
            held.append(batch.slice(cut))
            last = hashes[-1]
            if len(held) > 1:
                made = rows(*summed(held))
                held = [pa.RecordBatch.from_arrays([pa.array(np.full(len(made[0]), last)), *made], schema=batch.schema)]
        if held:
            yield done(held)

    counted = texts.mapInArrow(count, "word binary, sides binary, counts binary")
    # Hashes, being numbers, sort much faster than words.
    by_word = counted.repartition("word").select(F.xxhash64("word").alias("hash"), "word", "sides", "counts").sortWithinPartitions("hash")
    return by_word.mapInArrow(merge, "word binary, only int, sides binary, counts binary")


def usual_neighbours(beside: DataFrame) -> np.ndarray:
    """Shares of the classes before and after words seen once: a matrix of fixed size."""
    once = beside.filter("only is not null").groupBy(F.col("only").alias("at")).agg(F.count("*").alias("n"))
    found = _matrix(once, SIDES)
    return found / max(found.sum(), 1)


def best_classes(beside: DataFrame, between: np.ndarray, usual: np.ndarray) -> DataFrame:
    """``(word, n, class)``: the class whose neighbours fit each word's own best, as ``between`` counts them.

    What a word adds to the likelihood of the class bigrams in class c is the sum of log N(l, c) / N(c)
    over the classes l before it and of log N(c, r) / N(c) over those after it. A word's own counts
    are discounted, as a class that fits one occurrence by chance fits no other; ``usual`` neighbours
    of rare words take the place of what is discounted.
    """
    total = between.sum()
    of = between[:, :CLASSES].sum(axis=0)
    empty = np.where(of > 0, 0.0, -np.inf) if of.any() else 0.0
    before = np.log((between[:, :CLASSES] + PRIOR * (between.sum(axis=1, keepdims=True) + 1) / (total + SIDES)) / (of + PRIOR))
    after = np.log((between[:CLASSES].T + PRIOR * (between.sum(axis=0)[:, None] + 1) / (total + SIDES)) / (of + PRIOR))
    always = USUAL * (usual.sum(axis=1) @ before + usual.sum(axis=0) @ after) + empty

    def choose(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4_096):
                part = batch.slice(first, 4_096)
                rows = part.num_rows
                side, row = _unpacked(part.column(2), "<u2")
                n, _ = _unpacked(part.column(3), "<i8")
                left = np.bincount(row * SIDES + side // SIDES, n, rows * SIDES).reshape(rows, SIDES)
                right = np.bincount(row * SIDES + side % SIDES, n, rows * SIDES).reshape(rows, SIDES)
                times = left.sum(axis=1)
                own = (left @ before + right @ after) * (1 - DISCOUNT / times)[:, None]
                best = np.argmax(np.round(own + always, 6), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(times.astype(np.int64)), pa.array(best.astype(np.int32))], names=["word", "n", "class"]
                )

    return beside.mapInArrow(choose, "word binary, n long, class int")


def word_classes(texts: DataFrame, top: pd.DataFrame) -> tuple[dict[bytes, int], DataFrame]:
    """Classes of all words of ``texts (text)``: of those in ``top`` as a dict, of all but the core also as a table.

    The core is exchanged word by word. Every other word, however rare, then takes the class that its
    own neighbours fit best, all at once in each round, as in distributed exchange: the first round
    knows the classes of the core, later ones those of all words in ``top``.
    """
    names = [bytes(w) for w in top["word"]]
    core = names[:CORE]
    pairs = unit_bigrams(texts, {w: i for i, w in enumerate(core)}, len(core) + 2)
    of = exchange(pairs, fixed=2)
    class_of = {w: int(of[i]) for i, w in enumerate(core)}
    member = np.zeros((len(pairs), SIDES))
    member[np.arange(len(pairs)), of] = 1
    between = member.T @ pairs @ member
    kind = texts.sparkSession.createDataFrame(pd.DataFrame({"word": names}), "word binary")
    for n in range(ROUNDS):
        if n:
            between = unit_bigrams(texts, class_of, SIDES)
        beside = stored(neighbours(texts, class_of, len(core)), "neighbours")
        lexicon = stored(best_classes(beside, between, usual_neighbours(beside)), "word-classes")
        discard(beside)
        found = lexicon.join(F.broadcast(kind), "word").select("word", "class").toPandas()
        got = dict(zip(map(bytes, found["word"]), found["class"].tolist()))
        class_of = {w: class_of[w] if i < len(core) else got[w] for i, w in enumerate(names)}
    return class_of, lexicon


def class_sequences(docs: DataFrame, class_of: dict[bytes, int], logs_of: np.ndarray, lexicon: DataFrame, unseen: int) -> DataFrame:
    """``(id, learnt, n_tokens, known, logs, classes)`` for every row of ``docs (id, text binary, learnt)``.

    ``classes`` has a byte per word; ``known`` words occur in learnt texts, ``logs`` is their sum of
    log10(c + 1). Words that are not in ``class_of`` meet ``lexicon`` in a join.
    """
    known = pa.array(list(class_of), pa.binary())
    shared = docs.sparkSession.sparkContext.broadcast((known, np.array([*class_of.values(), HOLE], np.uint8), np.append(logs_of, 0.0)))

    def read(batches):
        known, classes, logs_of = shared.value
        for batch in batches:
            texts, rows = batch.column(1), batch.num_rows
            row, words = text_words(texts)
            place = _places(words, known)
            sizes = np.bincount(row, minlength=rows)
            is_hole = place < 0
            # The distinct words of a text that a join tells, in the order in which they come first.
            held, of = words.filter(pa.array(is_hole)).dictionary_encode(), row[is_hole].astype(np.int64)
            wide = max(len(held.dictionary), 1)
            key, first, same = np.unique(of * wide + held.indices.to_numpy(), return_index=True, return_inverse=True)
            order = np.argsort(first)
            rank = np.empty(len(key), np.int64)
            rank[order] = np.arange(len(key))
            rare = np.bincount(key // wide, minlength=rows)
            starts = np.append(0, np.cumsum(rare))
            holes = (rank[same] - starts[of]).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([xxhash.xxh3_128_digest(t) for t in texts.to_pylist()], pa.binary()),
                    pa.array(sizes + 1, pa.int64()),
                    pa.array(sizes - np.bincount(of, minlength=rows), pa.int64()),
                    pa.array(np.bincount(row, logs_of[place], rows)),
                    _packed(classes[place], np.cumsum(sizes)),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), held.dictionary.take(pa.array(key[order] % wide))),
                    pa.array(rare, pa.int64()),
                    _packed(holes, np.cumsum(np.bincount(of, minlength=rows))),
                ],
                names=["id", "learnt", "digest", "n_tokens", "known", "logs", "classes", "words", "rare", "holes"],
            )

    def fill(batches):
        for batch in batches:
            ids, learnt, n_tokens, known, logs, classes, rare, holes, at, ns, kinds = batch.columns
            rows, rare = batch.num_rows, rare.to_numpy()
            starts = np.cumsum(rare) - rare
            n, kind = np.zeros(rare.sum(), np.int64), np.full(rare.sum(), unseen, np.uint8)
            of = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
            told = starts[of] + at.flatten().to_numpy()
            n[told], kind[told] = ns.flatten().to_numpy(), kinds.flatten().to_numpy()
            hole, row = _unpacked(holes, "<i4")
            hole = starts[row] + hole
            full, of = _unpacked(classes, "u1")
            full = full.copy()
            full[full == HOLE] = kind[hole]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    learnt,
                    n_tokens,
                    pa.array(known.to_numpy() + np.bincount(row[n[hole] > 0], minlength=rows), pa.int64()),
                    pa.array(logs.to_numpy() + np.bincount(row, np.log10(n[hole] + 1.0), rows)),
                    _packed(full, np.cumsum(np.bincount(of, minlength=rows))),
                ],
                names=["id", "learnt", "n_tokens", "known", "logs", "classes"],
            )

    own = f"id {docs.schema['id'].dataType.simpleString()}, learnt boolean"
    counts = "n_tokens long, known long, logs double, classes binary"
    first = stored(docs.select("id", "text", "learnt").mapInArrow(read, f"{own}, digest binary, {counts}, words array<binary>, rare long, holes binary"), "read-texts")
    asked = first.select("digest", F.posexplode("words").alias("at", "word"))
    # Equal texts share a digest and what is found for it.
    found = asked.join(lexicon, "word").groupBy("digest").agg(F.collect_set(F.struct("at", "n", "class")).alias("found"))
    joined = first.drop("words").join(found, "digest", "left").drop("digest")
    return joined.select("*", "found.at", "found.n", "found.class").drop("found").mapInArrow(fill, f"{own}, {counts}")


def class_scores(docs: DataFrame, learn: Column) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs (id, text)``.

    The model learns from rows where ``learn`` holds. A token's probability is that of its class
    after the class before, transitions mixed with the class frequencies, times that of the word
    within its class, (c + 1) / (N_class + V_class + 1), so that unseen words have a share in each
    class. ``base_score`` is the add-one unigram score. Both are sums of log10.

    Every word of the learnt texts has a class by its own neighbours; unseen words share the class
    of most words seen once. Counts and classes of the most frequent words, a bounded number, travel
    with the tasks; all other words meet the table of classes in a join. Only class bigrams, whose
    number is fixed, and the exchange of the core are worked on in one place.

    Null texts are empty and score their end; a null id is learnt from; rows that repeat are scored
    each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("id", F.encode(whole("text"), "UTF-8").alias("text"), F.coalesce(learn, F.lit(True)).alias("learnt"))
    texts = docs.filter("learnt").select("text")
    counts = stored(count_words(texts), "word-counts")
    n_docs = texts.count()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).head()
    n, v = (total["n"] or 0) + n_docs, total["v"] + (n_docs > 0)
    top = frequent_words(counts.filter(F.octet_length("word") <= LONGEST), FREQUENT)
    class_of, lexicon = word_classes(texts, top)

    tokens, types, once = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1), np.zeros(CLASSES)
    tokens[BOUND], types[BOUND] = n_docs, 1
    for word, c in zip(top["n"][:CORE], class_of.values()):
        tokens[c] += word
        types[c] += 1
    seen_once = F.sum((F.col("n") == 1).cast("int")).alias("once")
    for r in lexicon.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"), seen_once).collect():
        tokens[r["class"]] += r["n"]
        types[r["class"]] += r["v"]
        once[r["class"]] = r["once"]
    divisor = np.log10(tokens + types + 1)
    logs_of = np.log10(top["n"].to_numpy(np.float64) + 1)
    read = stored(class_sequences(docs, class_of, logs_of, lexicon, int(np.argmax(once))), "class-sequences")

    def steps(batches):
        total = np.zeros((CLASSES + 1) ** 2, np.int64)
        for batch in batches:
            total += _steps(chain(*_unpacked(batch.column(0), "u1"), batch.num_rows, BOUND)[0], CLASSES + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

    between = _matrix(read.filter("learnt").select("classes").mapInArrow(steps, "at long, n long"), CLASSES + 1)
    share = (between.sum(axis=0) + 1) / (between.sum() + CLASSES + 1)
    # A token's transition and what its emission is divided by.
    step = np.log10((between + PRIOR * share) / (between.sum(axis=1, keepdims=True) + PRIOR)) - divisor

    @F.pandas_udf("double")
    def class_part(classes: pd.Series) -> pd.Series:
        values, row = _unpacked(pa.array(classes, pa.binary()), "u1")
        rows = len(classes)
        at, _ = chain(values, row, rows, BOUND)
        # A text's steps end with the one to its bound.
        ends = np.cumsum(np.bincount(row, minlength=rows) + 1)
        starts = np.append(0, ends)[:-1]
        return pd.Series(np.add.reduceat(step[at[:-1], at[1:]], starts) if rows else np.zeros(0))

    logs = F.col("logs") + F.lit(float(np.log10(n_docs + 1)))
    return read.select(
        "id",
        (~F.col("learnt")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.lit(1 if n_docs else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (logs + class_part("classes")).alias("score"),
    )


@query("op5_brown")
def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class model and unigram scores of every document; one in seven is held out."""
    docs = own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    learn = F.crc32(F.col("id").cast("string")) % 7 != 2
    return class_scores(docs.withColumnRenamed("doc_id", "id"), learn).withColumnRenamed("id", "doc_id")
