"""Token ids of documents as binary blocks, by a static range asymmetric numeral system.

Texts become ids of a public tokenizer. One table of frequencies, counted over
all documents and scaled to 2**PRECISION, is shared by all blocks. A block holds
at most BLOCK tokens of one document and is coded by itself: token i goes to
lane i mod LANES, each lane has a state of 64 bits and takes or gives words of
32, and all lanes share one stream of words, interleaved in the order in which a
decoder wants them. A checkpoint every CHECKPOINT tokens holds the lanes' states
and the number of words read so far, so that a decoder can begin there and the
parts of a block can be decoded side by side. A block carries the CRC-32 of its
ids (little-endian, 16 or 32 bits each).

A row of the result is a block: doc_id, block (its number in the document),
n_tokens, n_words, payload (the states before the first token, then the words),
checkpoints (token, word, states) and checksum. One more row, block -1, has the
shared table as its payload: for each id in turn its 32-bit frequency.

Texts are tokenised exactly as the library does it: it never joins tokens over a
single space between two non-blank characters, so a batch is cut there, and a
piece that repeats is tokenised once.

Defined cases: an empty text gives one block without tokens; a null text gives
one block whose n_tokens, payload and checksum are null; a row whose doc_id is
null keeps it; rows that repeat give equal blocks; an empty table gives the row
of an empty table only; a vocabulary that isn't there is an error before any row
is read; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from . import _blocks as B
from ._spark import checkpoint, ship
from ._text import buffer, chunked, mix

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-level vocabularies of this kind cut a text before merging (public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRECISION = 20
BLOCK, LANES, CHECKPOINT = 8_192, 8, 2_048
CHUNK_BYTES = 2_000_000
_LOW = 1 << 31
_U = np.uint64
_STATE = StructType().add("token", IntegerType()).add("word", IntegerType()).add("states", BinaryType())


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    ranks = _encoding(path)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        out[rank] = len(token)
    return out


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions of single blanks between two characters that surely aren't blank."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 1) & (at < len(data) - 1)]
    two, left, right = data[at - 2], data[at - 1], data[at + 1]
    before = (left > 32) & (left < 127) | (left >= 128) & (two >= 0xC3) & (two < 0xE0)
    after = (right > 32) & (right < 127) | (right >= 0xC3) & (right < 0xE0) | (right >= 0xE4)
    return at[before & after]


class Pieces:
    """Tokens of pieces that were met before, by the pieces' hashes."""

    def __init__(self, path: str):
        self.encoding, self.lengths = _encoding(path), _lengths(path)
        self.keys, self.at, self.tokens = np.zeros(1, _U), np.zeros(2, np.int64), np.zeros(0, np.uint32)
        self.slots = np.zeros(1 << 22, np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and which of them aren't known."""
        place = self.slots[h >> _U(42)].astype(np.int64)
        miss = np.flatnonzero(self.keys[place] != h)
        place[miss] = np.minimum(np.searchsorted(self.keys, h[miss]), len(self.keys) - 1)
        return place, miss[self.keys[place[miss]] != h[miss]]

    def learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        """Tokenises new pieces, all of which begin with a blank, in one go, and finds out where each ends."""
        if not raw:
            return
        text = b"".join(raw)
        tokens = np.array(self.encoding.encode_ordinary(text.decode()), np.uint32)
        ends = np.cumsum(self.lengths[tokens])
        cut = np.append(0, np.searchsorted(ends, np.cumsum([len(x) for x in raw])) + 1)
        all_keys, size = np.concatenate([self.keys, keys]), np.concatenate([np.diff(self.at), np.diff(cut)])
        starts = np.concatenate([self.at[:-1], cut[:-1] + len(self.tokens)])
        pool = np.concatenate([self.tokens, tokens])
        o = np.argsort(all_keys)
        self.keys, self.at = all_keys[o], B.spans(size[o])
        own = np.arange(self.at[-1]) + np.repeat(starts[o] - self.at[:-1], size[o])
        self.tokens = pool[own]
        self.slots[self.keys >> _U(42)] = np.arange(len(self.keys))


def _span_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, by differences of a running polynomial sum."""
    from ._text import _powers

    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(mix(data.astype(_U) + _U(0x9E3779B97F4A7C15)) * power[: len(data)], dtype=_U, out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(_U))


def tokenize(texts: pa.Array, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All ids, text after text, and where each text's begin (with the end of the last)."""
    data, at = buffer(texts)
    cuts = _cuts(data)
    # texts begin pieces too; a piece is within one text, and its blank belongs to it
    begin = np.sort(np.concatenate([cuts, at[:-1][np.diff(at) > 0]]))
    begin = begin[np.append(True, begin[1:] != begin[:-1])] if len(begin) else begin
    end = np.append(begin[1:], at[-1]) if len(begin) else begin
    edge = np.zeros(len(begin) + 1, bool)  # the first and last piece of each text
    first_piece = np.searchsorted(begin, at)
    edge[first_piece] = edge[np.maximum(first_piece - 1, 0)] = True
    edge = edge[:-1]
    inner = np.flatnonzero(~edge)
    h = _span_hash(data, begin[inner], end[inner])
    raw = data.tobytes()
    slot, unknown = known.find(h)
    if len(unknown):
        own, first = np.unique(h[unknown], return_index=True)
        known.learn(own, [raw[begin[i] : end[i]] for i in inner[unknown[first]]])
        slot, _ = known.find(h)
    size = np.zeros(len(begin), np.int64)
    size[inner] = known.at[slot + 1] - known.at[slot]
    edges = {int(i): known.encoding.encode_ordinary(raw[begin[i] : end[i]].decode()) for i in np.flatnonzero(edge)}
    for i, tokens in edges.items():
        size[i] = len(tokens)
    to = B.spans(size)
    ids = np.empty(to[-1], np.uint32)
    if len(inner):
        ids[B.take_runs(to, inner)] = known.tokens[B.take_runs(known.at, slot)]
    for i, tokens in edges.items():
        ids[to[i] : to[i] + len(tokens)] = tokens
    return ids, to[first_piece]


def scale(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to 2**precision, at least 1 for each id that occurs."""
    total, size = int(counts.sum()), 1 << precision
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError("more ids than slots: the precision is too small")
    exact = counts.astype(np.float64) * (size / total)
    f = np.where(counts > 0, np.maximum(np.floor(exact), 1), 0).astype(np.int64)
    while (rest := size - int(f.sum())) != 0:
        order = np.lexsort((np.arange(len(f)), -f))
        if rest > 0:
            some = order[: min(rest, np.count_nonzero(f))]
            f[some] += 1
        else:
            some = order[f[order] > 1][:-rest]
            f[some] -= 1
    return f


def encode(ids: np.ndarray, at: np.ndarray, freq: np.ndarray, precision: int = PRECISION) -> tuple[list[bytes], np.ndarray, list[list[tuple[int, int, bytes]]]]:
    """Payload, number of words and checkpoints of each block ids[at[b]:at[b + 1]]. All lanes of all blocks advance together."""
    blocks = len(at) - 1
    size = np.diff(at)
    start = (np.cumsum(freq) - freq).astype(_U)
    f_all = freq.astype(_U)
    lane_block, lane = np.repeat(np.arange(blocks), LANES), np.tile(np.arange(LANES), blocks)
    steps = np.maximum((size[lane_block] - lane + LANES - 1) // LANES, 0)
    order = np.argsort(-steps, kind="stable")
    lane_block, lane, steps = lane_block[order], lane[order], steps[order]
    first = at[lane_block] + lane
    x = np.full(len(order), _LOW, _U)
    bits, low32 = _U(precision), _U(0xFFFFFFFF)
    every = CHECKPOINT // LANES
    words, owners, saved = [], [], []
    longest = int(steps[0]) if len(steps) else 0
    live = np.searchsorted(-steps, -np.arange(longest), "left") if longest else np.zeros(0, int)  # lanes with more than s tokens
    for s in range(longest - 1, -1, -1):
        n = live[s]
        token = ids[first[:n] + s * LANES]
        f, own = f_all[token], x[:n]
        out = np.flatnonzero(own >= (f << _U(63 - precision)))
        words.append((own[out] & low32).astype(np.uint32))
        owners.append(lane_block[out])
        own[out] >>= _U(32)
        q = own // f
        x[:n] = (q << bits) + (own - q * f) + start[token]
        if s and s % every == 0:
            saved.append((s, n, x[:n].copy(), len(words)))
    words.reverse()
    owners.reverse()
    word, owner = (np.concatenate(words), np.concatenate(owners)) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    by = np.argsort(owner.astype(np.uint16 if blocks < 65536 else np.int64), kind="stable")
    word, count = word[by], np.bincount(owner, minlength=blocks)
    where = B.spans(count)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    state = x[back].reshape(blocks, LANES)
    payload = [state[b].tobytes() + word[where[b] : where[b + 1]].tobytes() for b in range(blocks)]
    points: list[list[tuple[int, int, bytes]]] = [[] for _ in range(blocks)]
    read = {}  # words that steps before s take, for each block
    for s, n, states, n_lists in saved:
        later = owners[:s]
        read[s] = np.bincount(np.concatenate(later), minlength=blocks) if later else np.zeros(blocks, np.int64)
        now = np.full(len(order), _LOW, _U)
        now[:n] = states
        now = now[back].reshape(blocks, LANES)
        for b in np.flatnonzero(size > s * LANES):
            points[b].append((s * LANES, int(read[s][b]), now[b].tobytes()))
    for p in points:
        p.reverse()
    return payload, count, points


def decode(payload: list[bytes], n_tokens: np.ndarray, freq: np.ndarray, begin: list[tuple[int, int, bytes] | None] | None = None, precision: int = PRECISION) -> list[np.ndarray]:
    """The ids of each payload, or those from a checkpoint on; ``n_tokens`` is the number of the whole block's tokens (or where to stop)."""
    n = len(payload)
    begin = begin or [None] * n
    slots = np.repeat(np.arange(len(freq), dtype=np.int64), freq)
    f_all, start = freq.astype(_U), (np.cumsum(freq) - freq).astype(_U)
    x = np.stack([np.frombuffer(p[: 8 * LANES] if c is None else c[2], _U) for p, c in zip(payload, begin)]) if n else np.zeros((0, LANES), _U)
    x = x.copy()
    words = np.concatenate([np.frombuffer(p, np.uint32, offset=8 * LANES) for p in payload]) if n else np.zeros(0, np.uint32)
    base = B.spans([(len(p) - 8 * LANES) // 4 for p in payload])[:-1] if n else np.zeros(0, int)
    at = base + np.array([0 if c is None else c[1] for c in begin], np.int64)
    tokens = np.array([0 if c is None else c[0] for c in begin], np.int64)
    left = np.asarray(n_tokens, np.int64) - tokens
    out = np.zeros((n, int(-(-max(left.max(), 0) // LANES)) * LANES if n else 0), np.int64)
    mask = _U((1 << precision) - 1)
    for s in range(0, out.shape[1], LANES):
        use = (s + np.arange(LANES))[None, :] < left[:, None]
        slot = x & mask
        token = np.where(use, slots[np.where(use, slot, 0).astype(np.int64)], 0)
        y = f_all[token] * (x >> _U(precision)) + slot - start[token]
        need = use & (y < _U(_LOW))
        place = at[:, None] + np.cumsum(need, 1) - need
        if need.any() and place[need].max() >= len(words):
            raise ValueError("a block ends too early, so it can't match its checksum")
        y[need] = (y[need] << _U(32)) | words[place[need]]
        at += need.sum(1)
        x = np.where(use, y, x)
        out[:, s : s + LANES] = token
    return [out[b, : max(left[b], 0)] for b in range(n)]


def _checksum(ids: np.ndarray, wide: bool) -> int:
    return zlib.crc32(ids.astype("<u4" if wide else "<u2").tobytes())


def tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (binary, 16 bits each, or 32 where the vocabulary is larger) of each row; the table is in the shared folder."""
    ship(docs.sparkSession)
    wide = len(_lengths(vocabulary)) > 65536
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(SparkFiles.get(name))
        for batch in chunked(batches, limit=CHUNK_BYTES):
            column = batch.column("text")
            if len(known.keys) > 1_000_000:
                known = Pieces(SparkFiles.get(name))  # bounds the memory
            ids, at = tokenize(column, known)
            ids = ids.astype(np.uint32 if wide else np.uint16)
            valid = column.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([ids[a:b].tobytes() if v else None for a, b, v in zip(at[:-1], at[1:], valid)], pa.binary())], names=["doc_id", "ids"])

    return checkpoint(docs.select("doc_id", "text").mapInArrow(write, docs.select("doc_id").schema.add("ids", "binary")))


def output(docs: DataFrame, vocabulary: str = VOCABULARY, precision: int = PRECISION) -> DataFrame:
    """The blocks of all documents, and the row of the table."""
    n_ids = len(_lengths(vocabulary))
    kind = np.uint32 if n_ids > 65536 else np.uint16
    coded = tokens(docs, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_ids, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column("ids").drop_null().to_pylist()), kind), minlength=n_ids)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["id", "n"])

    sums = coded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_ids, np.int64)
    counts[sums.column("id").to_numpy()] = sums.column("n").to_numpy()
    freq = scale(counts, precision)
    schema = docs.select("doc_id").schema.add("block", IntegerType()).add("n_tokens", IntegerType()).add("n_words", IntegerType()).add("payload", BinaryType()).add("checkpoints", ArrayType(_STATE)).add("checksum", LongType())

    def rows(doc: pa.Array, block: list, n: list, words: list, payload: list, points: list, checksum: list) -> pa.RecordBatch:
        kind_ = pa.list_(pa.struct([("token", pa.int32()), ("word", pa.int32()), ("states", pa.binary())]))
        points = [None if p is None else [{"token": a, "word": b, "states": c} for a, b, c in p] for p in points]
        return pa.RecordBatch.from_arrays([doc, pa.array(block, pa.int32()), pa.array(n, pa.int32()), pa.array(words, pa.int32()), pa.array(payload, pa.binary()), pa.array(points, kind_), pa.array(checksum, pa.int64())], names=schema.names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                raw = batch.column("ids").to_pylist()
                doc, block, parts = [], [], []
                for r, b in enumerate(raw):
                    ids = None if b is None else np.frombuffer(b, kind)
                    for k in range(max(1, -(-len(ids) // BLOCK)) if ids is not None else 1):
                        doc.append(r)
                        block.append(k)
                        parts.append(None if ids is None else ids[k * BLOCK : (k + 1) * BLOCK])
                there = [p for p in parts if p is not None]
                at = B.spans([len(p) for p in there])
                ids = np.concatenate(there).astype(np.int64) if there else np.zeros(0, np.int64)
                payload, words, points = encode(ids, at, freq, precision)
                it = iter(range(len(there)))
                index = [None if p is None else next(it) for p in parts]
                pick = lambda xs: [None if i is None else xs[i] for i in index]  # noqa: B023, E731
                sums_ = [_checksum(p, kind is np.uint32) for p in there]
                yield rows(batch.column("doc_id").take(pa.array(doc, pa.int64())), block, pick([len(p) for p in there]), pick(words.tolist()), pick(payload), pick(points), pick(sums_))

    spark = docs.sparkSession
    table = freq.astype("<u4").tobytes()
    head = spark.createDataFrame([(None, -1, int((freq > 0).sum()), 0, bytearray(table), [], zlib.crc32(table))], schema)
    return coded.mapInArrow(write, schema).unionByName(head)


def read_back(blocks: DataFrame) -> DataFrame:
    """doc_id, block and ids (array) of each block, checked against its checksum; a mismatch is an error."""
    ship(blocks.sparkSession)
    table = np.frombuffer(bytes(blocks.where("block = -1").first()["payload"]), "<u4").astype(np.int64)
    wide = len(table) > 65536

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array(batch.column("n_tokens").to_pylist())
            ids = decode(batch.column("payload").to_pylist(), n, table)
            for x, c in zip(ids, batch.column("checksum").to_pylist()):
                if _checksum(x, wide) != c:
                    raise ValueError("a block doesn't match its checksum")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], names=["doc_id", "block", "ids"])

    schema = blocks.select("doc_id", "block").schema.add("ids", ArrayType(LongType()))
    return blocks.where("block >= 0 and payload is not null").select("doc_id", "block", "n_tokens", "payload", "checksum").mapInArrow(write, schema)
