"""Packing token ids into training sequences by minimum bin slack."""

from __future__ import annotations

import json
import os
import sys
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quakelake.llm.common import bounded_batches, own_columns, whole
from quakelake.llm.registry import query

CAPACITY = 4096
END = 2
#: Tokens that a task holds before it fills windows; half of them stay, so that lengths remain varied.
POOL = 1 << 20
#: Characters of a text that are encoded at once; texts are cut before blanks only.
SEGMENT = 1 << 16
#: Words whose ids a task keeps, and their greatest length.
KNOWN, LONG_WORD = 800_000, 64


# --- one window ---------------------------------------------------------------------------------


def closest_fill(lengths: Sequence[tuple[int, int]], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``room`` from below, as uses per length.

    ``lengths`` holds ``(length, count)``. Bit s of ``reach`` tells that some multiset sums to s; a
    count enters as 1, 2, 4, … copies at once. The sums known before each such step are kept, and
    the way back through them gives the uses. It ends as soon as ``room`` itself can be reached.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in lengths:
        left, copies = min(count, room // length), 1
        while left > 0 and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << (length * copies) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    uses: dict[int, int] = {}
    goal = reach.bit_length() - 1
    for length, copies, before in reversed(steps):
        if not before >> goal & 1:
            uses[length] = uses.get(length, 0) + copies
            goal -= length * copies
    return uses


class Pool:
    """Pieces that wait for a window, by length. A piece is ``(doc, doc_tokens, start, ids)``."""

    def __init__(self) -> None:
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def put(self, piece) -> None:
        n = len(piece[3])
        if n not in self.by_length:
            self.by_length[n] = []
            insort(self.lengths, n)
        self.by_length[n].append(piece)
        self.tokens += n

    def take(self, length: int):
        held = self.by_length[length]
        piece = held.pop()
        if not held:
            del self.by_length[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)
        self.tokens -= length
        return piece

    def window(self, size: int) -> list:
        """Pieces of ``size`` tokens together; the pool must hold as many.

        The longest piece that fits goes first, then the multiset that leaves the least slack. What
        no multiset fills is cut from the longest piece left.
        """
        out, room = [], size
        fits = bisect_right(self.lengths, room)
        if fits:
            first = self.take(self.lengths[fits - 1])
            out.append(first)
            room -= len(first[3])
        if room:
            fitting = self.lengths[: bisect_right(self.lengths, room)]
            for length, n in closest_fill([(x, len(self.by_length[x])) for x in reversed(fitting)], room).items():
                out += [self.take(length) for _ in range(n)]
                room -= length * n
        if room:
            doc, total, start, ids = self.take(self.lengths[-1])
            out.append((doc, total, start, ids[:room]))
            self.put((doc, total, start + room, ids[room:]))
        return out


def pack(documents: Iterator[tuple[object, np.ndarray]], capacity: int) -> Iterator[list]:
    """Windows of pieces; each is full but for the last ones, whose sizes are powers of two."""
    pool = Pool()
    for doc, ids in documents:
        whole_windows = len(ids) // capacity * capacity
        for start in range(0, whole_windows, capacity):
            yield [(doc, len(ids), start, ids[start : start + capacity])]
        if whole_windows < len(ids):
            pool.put((doc, len(ids), whole_windows, ids[whole_windows:]))
        if pool.tokens >= max(POOL, 2 * capacity):
            while pool.tokens >= max(POOL // 2, capacity):
                yield pool.window(capacity)
    while pool.tokens >= capacity:
        yield pool.window(capacity)
    while pool.tokens:
        yield pool.window(1 << pool.tokens.bit_length() - 1)


# --- token ids ----------------------------------------------------------------------------------


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Cut a text before blanks, at about ``size`` characters; one longer word stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        if cut < 0:
            cut = text.find(" ", at + size)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


#: Words of printable ASCII, but for ``<``, which may open a special token, white space, and the
#: composed letters of Latin-1: normal forms leave them as they are.
PLAIN = regex.compile(r"[!-;=-~\t-\rÀ-ÖØ-öø-ÿ]*")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it can be
    printed, otherwise the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


BYTE_SYMBOLS = byte_symbols()


class WordIds:
    """Token ids of texts, put together from those of their words.

    The vocabulary's pieces never reach over blanks, so a text has the ids of its words in a row.
    Each word is encoded when it is first met. Ids of short words are kept in two halves: a full
    younger half becomes the older one, from which words that occur again are taken back.

    Where the vocabulary lower-cases and splits by a pattern of its own, plain words are split by it
    here, and only pieces not met before go through its merges.
    """

    def __init__(self, path: str, end: int) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.end = np.array([end], "<u4").tobytes()
        with open(path, encoding="utf-8") as file:
            self.split = split_pattern(json.load(file))

    def _plain(self, word: str) -> bytes | None:
        if self.split is None or not PLAIN.fullmatch(word):
            return None
        out = b""
        for piece in self.split.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                symbols = piece if piece.isascii() else "".join(map(BYTE_SYMBOLS.__getitem__, piece.encode()))
                ids = self.pieces[piece] = _bytes([t.id for t in self.tokenizer.model.tokenize(symbols)])
            out += ids
        return out

    def _ids(self, words: list[str]) -> bytes:
        new, long = [], {}
        for word in set(words).difference(self.young):
            ids = self.old.get(word)
            if ids is None and len(word) <= LONG_WORD:
                ids = self._plain(word)
            if ids is None:
                new.append(word)
            else:
                self.young[word] = ids
        for word, coded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            (self.young if len(word) <= LONG_WORD else long)[word] = _bytes(coded.ids)
        if long:
            return b"".join([self.young[w] if w in self.young else long[w] for w in words])
        return b"".join(map(self.young.__getitem__, words))

    def of(self, text: str) -> np.ndarray:
        """Ids of a text with ``end`` behind them."""
        parts = []
        for segment in segments(text):
            if len(self.young) > KNOWN // 2:
                self.young, self.old = {}, self.young
            if len(self.pieces) > KNOWN // 2:
                self.pieces = {}
            parts.append(self._ids(segment.split(" ")))
        return np.frombuffer(b"".join([*parts, self.end]), "<u4")


def _bytes(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def split_pattern(vocabulary: dict) -> regex.Pattern | None:
    """The pattern of a vocabulary that lower-cases, splits by one pattern and maps bytes; else None."""
    steps = (vocabulary.get("normalizer") or {}).get("normalizers") or []
    cuts = (vocabulary.get("pre_tokenizer") or {}).get("pretokenizers") or []
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    known = [s for s in steps if s == blank or s["type"] in ("NFC", "Lowercase")] == steps and {"type": "Lowercase"} in steps
    if not known or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or vocabulary.get("post_processor"):
        return None
    split, level = cuts
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    return regex.compile(split["pattern"]["Regex"])


@lru_cache(1)
def word_ids(path: str, end: int) -> WordIds:
    """The vocabulary with the words it has met: one per Python worker, over all its tasks."""
    return WordIds(path, end)


def pack_documents(
    df: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """``(id, start, length, ids, doc_tokens, sequence_id, offset)``: one row per piece of a document.

    A document is its token ids and then ``end``; ``ids`` holds those of the piece as little-endian
    unsigned 32-bit numbers, ``start`` how many of its document lie before it, ``offset`` its place
    in the sequence. ``tokenizer`` is the path of a vocabulary file on every executor whose pieces do
    not reach over blanks.

    Each task packs its own partition in one pass, without a shuffle. Documents above ``capacity``
    fill windows of their own; the lengths that remain wait in a pool of at most ``POOL`` tokens and
    one document. A window takes the longest piece and then the multiset of remaining lengths that
    leaves the least slack; slack is closed by a cut. So every sequence is full, but for at most one
    of each smaller power of two at the end of a task, and nothing is padded. ``sequence_id`` is the
    partition's number times 2^33 plus a running number: the same in every run over the same files.

    Null and empty texts are one id, ``end``. Null ids, ties and repeated rows are packed row by row.
    Very long texts are encoded in segments and their ids held once. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    bounded_batches(df.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    base = df.select(F.col(f"`{id_col}`").alias("id"), whole(f"`{text_col}`").alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", base.schema["id"].dataType),
            *[T.StructField(n, T.LongType()) for n in ("start", "length")],
            T.StructField("ids", T.BinaryType()),
            *[T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")],
        ]
    )

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = word_ids(path, end)
        kind = None

        def documents():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield doc, model.of(text.as_py())

        first = TaskContext.get().partitionId() << 33
        rows, held = [], 0

        def flush():
            columns = list(zip(*rows))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)
            rows.clear()
            return out

        for number, window in enumerate(pack(documents(), capacity)):
            offset = 0
            for doc, total, start, ids in window:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, first + number, offset))
                offset += len(ids)
            held += offset
            if held >= POOL // 4:
                yield flush()
                held = 0
        if rows:
            yield flush()

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids, documents)``: the pieces of every sequence joined in place.

    A sequence is bounded by its capacity, so its pieces are a small group. ``documents`` tells the
    length of each piece, for attention that does not cross documents.
    """
    placed = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(placed.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
        F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"),
        F.transform("p", lambda x: x["length"]).alias("documents"),
    )


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    docs = own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    return pack_documents(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
