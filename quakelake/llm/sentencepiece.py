"""SentencePiece BPE encoding and decoding by matching the vocabulary against a suffix array."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakelake.llm.common import add_by_arrow, own_columns, whole
from quakelake.llm.registry import query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes matched at once; one longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Encoded segments that a task remembers.
MEMORY = 100_000
#: Segments above this many characters are relaxed one by one.
LONG = 64
#: Stand-ins inside a batch for the word mark and for the end of a segment; no UTF-8 text has them.
MARK, END = b"\xff", b"\xfe"
MARK_TEXT = "▁"
NEVER = np.int64(1) << 30


@dataclass
class Vocabulary:
    """Pieces as bytes in order (with ``MARK``), their ids, sizes and merge ranks; what ids stand for."""

    pieces: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    ranks: np.ndarray
    bytes_of: list[bytes]
    byte_ids: list[int]
    width: int
    splits: bytes
    low8: np.ndarray
    high8: np.ndarray
    last: np.ndarray


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a BPE model file on the driver; the vocabulary's size is fixed by that file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with byte fallback is needed")
    if model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix:
        raise ValueError("a model with identity normalisation and a leading word mark is needed")
    normal, bytes_of, byte_ids = [], [], [0] * 256
    for i, piece in enumerate(model.pieces):
        if piece.type == 1:
            form = piece.piece.replace(MARK_TEXT, "\0").encode().replace(b"\0", MARK)
            normal.append((form, i, piece.score))
            bytes_of.append(form)
        elif piece.type == 6:
            value = int(piece.piece[3:5], 16)
            byte_ids[value] = i
            bytes_of.append(bytes([value]))
        else:
            bytes_of.append(b"")
    if any(MARK in form.lstrip(MARK) for form, _, _ in normal):
        raise ValueError("a piece has a word mark inside")
    normal.sort()
    scores = np.array([s for _, _, s in normal])
    width = max(len(f) for f, _, _ in normal)
    if width >= 64 or len(normal) >= 1 << 20:
        raise ValueError("pieces below 64 bytes and fewer than 2^20 of them are needed")
    first8 = [f[:8] for f, _, _ in normal]
    return Vocabulary(
        low8=np.array([int.from_bytes(f.ljust(8, b"\0"), "big") for f in first8], np.uint64),
        high8=np.array([int.from_bytes(f.ljust(8, b"\xff"), "big") for f in first8], np.uint64),
        last=np.array([f.ljust(width, b"\xff") for f, _, _ in normal if len(f) > 8]),
        pieces=np.array([f for f, _, _ in normal]),
        ids=np.array([i for _, i, _ in normal], dtype=np.int32),
        sizes=np.array([len(f) for f, _, _ in normal], dtype=np.int64),
        ranks=np.unique(-scores, return_inverse=True)[1].astype(np.int64),
        bytes_of=bytes_of,
        byte_ids=byte_ids,
        width=width,
        # Characters of no piece end a segment: nothing merges across them.
        splits=bytes(c for c in b"\n\t\r" if not any(bytes([c]) in f for f, _, _ in normal)),
    )


def segments_of(text: bytes, vocab: Vocabulary, pattern: re.Pattern) -> list[bytes]:
    """Stretches that no piece reaches across: a run of word marks and what follows it."""
    if not text:
        return []
    return pattern.findall(MARK + text.replace(MARK_TEXT.encode(), MARK).replace(b" ", MARK))


def segment_pattern(vocab: Vocabulary) -> re.Pattern:
    stop = re.escape(vocab.splits)
    return re.compile(b"\xff*[^\xff" + stop + b"]+|\xff+" + (b"|[" + stop + b"]" if stop else b""))


def _words8(padded: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number in text order."""
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]
    return np.ascontiguousarray(windows).view(">u8").ravel().astype(np.uint64)


def _ranges(order: np.ndarray, low: np.ndarray, high: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the ranges ``order[low:high]`` with the name of their range."""
    count = high - low
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return order[np.repeat(low, count) + within], np.repeat(names, count)


def match_edges(data: np.ndarray, starts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of all pieces, sorted by position: ``start * 64 + size`` and the piece number.

    The suffix array orders the text's character positions by what follows; each piece's occurrences
    are one range of it, found by binary search. It is kept in two parts: by the next eight bytes,
    where all pieces up to that size are found, and, where a longer piece begins with those eight,
    as far as the longest piece reaches.
    """
    padded = np.concatenate([data, np.full(vocab.width + 8, END[0], np.uint8)])
    next8 = _words8(padded, starts)
    order = np.argsort(next8)
    sorted8 = next8[order]
    low = np.searchsorted(sorted8, vocab.low8, "left")
    high = np.searchsorted(sorted8, vocab.high8, "right")
    short = vocab.sizes <= 8
    numbers = np.arange(len(vocab.pieces))
    at, piece = _ranges(order, low[short], high[short], numbers[short])
    heads, first = np.unique(vocab.low8[~short], return_index=True)
    deep, _ = _ranges(order, low[~short][first], high[~short][first], heads)
    if len(deep):
        windows = np.lib.stride_tricks.sliding_window_view(padded, vocab.width)[starts[deep]]
        suffixes = np.ascontiguousarray(windows).view(f"S{vocab.width}").ravel()
        by_rest = np.argsort(suffixes)
        deep, suffixes = deep[by_rest], suffixes[by_rest]
        low = np.searchsorted(suffixes, vocab.pieces[~short], "left")
        high = np.searchsorted(suffixes, vocab.last, "right")
        more, named = _ranges(deep, low, high, numbers[~short])
        at, piece = np.concatenate([at, more]), np.concatenate([piece, named])
    # Position, size and piece in one number: sorting it sorts the edges.
    edges = np.sort(((starts[at] * 64 + vocab.sizes[piece]) << 20) | piece)
    return edges >> 20, edges & 0xFFFFF


def _rank(start, end, keys, pieces, vocab):
    """Merge rank of the stretches ``[start, end)``, ``NEVER`` where no piece covers one."""
    size = end - start
    key = start * 64 + size
    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = (size < 64) & (keys[i] == key)
    return np.where(hit, vocab.ranks[pieces[i]], NEVER)


def relax_short(start, end, seg, keys, pieces, vocab) -> tuple[np.ndarray, np.ndarray]:
    """Relax all segments side by side: in each round every segment takes its best merge, leftmost first."""
    done = []
    rank = np.full(len(start), NEVER)
    inner = np.flatnonzero(seg[1:] == seg[:-1])
    rank[inner] = _rank(start[inner], end[inner + 1], keys, pieces, vocab)
    while len(start):
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        best = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), first)
        sizes = np.diff(np.append(first, len(start)))
        alive = (best >> 32) < NEVER
        if not alive.all():
            gone = np.repeat(~alive, sizes)
            done.append((start[gone], end[gone]))
        at = best[alive] & 0xFFFFFFFF
        end[at] = end[at + 1]
        keep = np.repeat(alive, sizes)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        at = place[at]
        start, end, seg, rank = start[keep], end[keep], seg[keep], rank[keep]
        for left in (at - 1, at):
            ok = (left >= 0) & (left + 1 < len(start))
            pair = left[ok]
            pair_ok = seg[pair] == seg[pair + 1]
            rank[pair[~pair_ok]] = NEVER
            pair = pair[pair_ok]
            rank[pair] = _rank(start[pair], end[pair + 1], keys, pieces, vocab)
        if len(start):
            rank[-1] = NEVER
    if not done:
        return start, end
    starts, ends = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(starts)
    return starts[order], ends[order]


def relax_long(start, end, keys, pieces, vocab) -> tuple[np.ndarray, np.ndarray]:
    """Relax one long segment with a queue of merges; work grows with n log n."""
    edges = {int(k): int(vocab.ranks[p]) for k, p in zip(keys, pieces)}
    n = len(start)
    s, e = start.tolist(), end.tolist()
    before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and e[j] - s[i] < 64 and (r := edges.get(s[i] * 64 + e[j] - s[i])) is not None:
            heapq.heappush(queue, (r, s[i], e[j], i))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, a, b, i = heapq.heappop(queue)
        j = after[i]
        # Either side has merged since: the offer is void.
        if not live[i] or j >= n or s[i] != a or e[j] != b:
            continue
        e[i], live[j], after[i] = b, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    keep = [i for i in range(n) if live[i]]
    return np.array([s[i] for i in keep], np.int64), np.array([e[i] for i in keep], np.int64)


def encode_segments(segments: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of each segment as little-endian 32-bit bytes."""
    if not segments:
        return []
    data = np.frombuffer(END.join(segments) + END, np.uint8)
    head = (data & 0xC0) != 0x80
    starts = np.flatnonzero(head & (data != END[0]))
    ends = np.append(np.flatnonzero(head)[1:], len(data))[(data[head] != END[0])]
    seg = np.cumsum(data == END[0])[starts]
    keys, pieces = match_edges(data, starts, vocab)
    if not len(keys):
        keys, pieces = np.array([-1]), np.array([0])
    sizes = np.bincount(seg, minlength=len(segments))
    is_long = sizes[seg] > LONG
    parts = [relax_short(starts[~is_long], ends[~is_long], seg[~is_long], keys, pieces, vocab)]
    for k in np.flatnonzero(sizes > LONG):
        a, b = np.searchsorted(seg, [k, k + 1])
        lo, hi = np.searchsorted(keys, [starts[a] * 64, ends[b - 1] * 64])
        parts.append(relax_long(starts[a:b], ends[a:b], keys[lo:hi], pieces[lo:hi], vocab))
    s, e = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(s)
    s, e = s[order], e[order]
    key = s * 64 + np.minimum(e - s, 63)
    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    known = keys[i] == key
    # Byte fallback: a character without a piece stands for its UTF-8 bytes.
    width = np.where(known, 1, e - s)
    token = np.repeat(np.where(known, vocab.ids[pieces[i]], -1), width)
    owner = np.repeat(np.arange(len(s)), width)
    if not known.all():
        raw = token < 0
        offset = np.arange(len(token)) - (np.cumsum(width) - width)[owner]
        token[raw] = np.array(vocab.byte_ids)[data[(s[owner] + offset)[raw]]]
    final = token.astype("<i4").tobytes()
    cut = np.searchsorted(np.cumsum(data == END[0])[s][owner], np.arange(len(segments) + 1)) * 4
    cut = cut.tolist()
    return [final[a:b] for a, b in zip(cut, cut[1:])]


class Encoder:
    """Encodes batches of texts, remembering segments within one task."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known, self.pattern = vocab, {}, segment_pattern(vocab)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        cut = [segments_of(t, self.vocab, self.pattern) for t in texts]
        if len(self.known) > MEMORY:
            self.known = {}
        fresh = list({s for c in cut for s in c if s not in self.known})
        self.known.update(zip(fresh, encode_segments(fresh, self.vocab)))
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]


def decode_ids(ids: list[int], bytes_of: list[bytes]) -> str:
    """The text of token ids; control ids stand for nothing."""
    out = b"".join(map(bytes_of.__getitem__, ids)).replace(MARK, b" ")
    return out.removeprefix(b" ").decode("utf-8", "replace")


def _batched(texts: list[bytes]):
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BATCH_BYTES:
            yield texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode_pieces(df: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """Add ``ids_col``, the token ids of each text.

    Tokens equal those of the model's own encoder. Texts are cut into segments that no piece spans;
    the new segments of a batch are joined, matched through a suffix array and relaxed: the best
    merge first, as a BPE model ranks them. Nothing is shuffled.

    Null and empty texts have no tokens; a text of any length is encoded whole; a column already
    named ``ids_col`` is replaced; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def make():
        encoder = Encoder(shared.value)

        def work(column):
            out = [ids for part in _batched(column.to_pylist()) for ids in encoder(part)]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(out), "<i4"), pa.int32())
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        return work

    text = F.encode(whole(f"`{text_col}`"), "UTF-8")
    return add_by_arrow(df, text, ids_col, T.ArrayType(T.IntegerType(), False), make)


def decode_pieces(df: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add ``text_col``, the text of each row's token ids.

    Encoding and decoding give back every text but one that holds U+2581, which reads as a blank.
    A null list gives the empty text, an id outside the vocabulary is an error; a column already named ``text_col`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(model).bytes_of)

    def make():
        def work(column):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
            rows = (flat[a:b].tolist() for a, b in zip([0, *ends], ends))
            return pa.array([decode_ids(ids, shared.value) for ids in rows], pa.string())

        return work

    return add_by_arrow(df, F.col(f"`{ids_col}`"), text_col, T.StringType(), make)


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: their number, a hash of the ids, and whether decoding gives the text back."""
    docs = own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    both = decode_pieces(encode_pieces(docs))
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        F.octet_length(whole("text")).cast("long").alias("n_bytes"),
        (F.col("decoded") == F.replace(whole("text"), F.lit(MARK_TEXT), F.lit(" "))).alias("round_trip"),
    )
