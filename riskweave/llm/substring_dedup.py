"""Repeated passages of documents by compaction of a de Bruijn graph over words.

The edges are the runs of K words (k-mers) that occur at two or more source
coordinates (document, word); an edge leads from its first K - 1 words to its
last. An edge is known by its first coordinates, those of the least doc_id and
word at which it occurs.

1. K-mers go to fragments by the least hash of the shorter runs of words within
   them, so that neighbours mostly go together and a fragment has few, long
   stretches of a document, however many fragments there are. Each finds the k-mers
   that repeat and sends every occurrence, with the first coordinates, to its document.
   Hot k-mers, which a bounded sample of documents shows to be in many, don't
   meet in a fragment: each task finds their first coordinates in its own texts,
   the least of these are the first of all, and a second pass over the texts sends
   the occurrences to their documents. Which k-mers count as hot doesn't change
   the result.
2. Occurrences that follow each other in a document and at their first
   coordinates form a run: one path of the graph, compacted where it is read.
3. Where a run follows directly on another, the two meet in a node that
   branches, as its edges also lead on along the source. These nodes are joined
   with the distinct runs on their source document, and each is cut there. What
   remains are the nonbranching paths, at each place where they occur.
4. Paths are found by 64-bit hashes of k-mers, so each is verified: the words at
   its source coordinates and those at its own are read, and where the 128-bit
   digests of these words differ, the path is dropped.

A row of the result is a span of K or more words that occurs elsewhere too:
doc_id, start (word), n_words, and where it occurs first, first_doc and
first_start. ``remove`` deletes every occurrence but the first.

Defined cases: a text that is null or has fewer than K words has no spans; rows
whose doc_id is null come after all others; rows that repeat doc_id and words
are one document (``remove`` handles each row alike), and rows that repeat only
doc_id are documents of their own, in the order of a hash of their words;
repeats within one text count; where doc_id isn't of an integer type, documents
are in the order of a 64-bit hash of it; overlapping occurrences are merged when
removed; a text of which all words are removed keeps what precedes its first
word; an empty table gives no rows; extra columns are kept by ``remove``
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from ._spark import checkpoint, integer_ids, named_ids, ship, text_bytes
from ._text import Words, chunked, mix

K = 50
#: Text bytes whose k-mers make a fragment; one fragment is held in memory at a time.
FRAGMENT_BYTES = 16 << 20
#: Words whose k-mers a task holds before it writes a row for each fragment; the fewer rows, the less each one's own cost counts.
BLOCK_WORDS = 1_000_000
#: Documents of the sample that shows hot k-mers, how often one must be in it, and how many are handled so at most.
HOT_SAMPLE, HOT_COUNT, HOT_MOST = 20_000, 20, 200_000
#: Bits of the filter of documents that take part in a join; the more documents, the more it lets through.
FILTER_BITS = 23
#: The place of a null doc_id.
LAST = (1 << 63) - 1
_U = np.uint64
_POSTINGS = "fragment int, doc binary, sig binary, count binary, key binary, low binary, high binary"
_OCCURRENCES = "bucket int, doc binary, sig binary, count binary, low binary, high binary, source binary, first_low binary, first_high binary, source_doc binary, source_sig binary"
_RUNS = "doc_id bigint, sig bigint, start bigint, n bigint, first_doc bigint, first_sig bigint, first_start bigint, before_doc bigint, before_sig bigint, before bigint"


def signatures(words: Words) -> np.ndarray:
    """A hash of each text's sequence of words."""
    n, counts = len(words), words.counts
    inside = np.arange(n) - np.repeat(words.first[:-1], counts)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words.hash + inside.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), out=total[1:])
    return mix(total[words.first[1:]] - total[words.first[:-1]] + counts.astype(np.uint64))


def _planes(x: np.ndarray) -> tuple[bytes, bytes]:
    """Low and high halves of the differences of 32-bit numbers; words in sequence differ by 1 and compress to nothing."""
    y = x.astype(np.uint32)
    y[1:] -= y[:-1].copy()
    return (y & 0xFFFF).astype(np.uint16).tobytes(), (y >> 16).astype(np.uint16).tobytes()


def _from_planes(low: pa.ChunkedArray, high: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all rows; the differences of each row begin anew."""
    x = B.joined(high, np.uint16).astype(np.uint32)
    x <<= 16
    x |= B.joined(low, np.uint16)
    size = pc.binary_length(low).to_numpy().astype(np.int64) // 2
    first = B.spans(size)[:-1][size > 0]
    np.cumsum(x, dtype=np.uint32, out=x)
    x -= np.repeat(np.append(np.zeros(1, np.uint32), x[first[1:] - 1])[: len(first)], size[size > 0])
    return x


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, with the end of the last."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


def _key(docs: DataFrame, column: str = "doc_id") -> Column:
    return F.coalesce(integer_ids(docs, column), F.lit(LAST))


def _kmers(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word within the text) of all runs of k words of a batch."""
    number = np.maximum(words.counts - k + 1, 0)
    at = B.spans(number)
    doc = np.repeat(np.arange(len(number)), number)
    pos = np.arange(at[-1]) - at[doc]  # int64 here, 32 bits in the blocks
    return (words.runs(words.first[doc] + pos, k) if len(doc) else np.zeros(0, _U)), doc, pos


def _anchors(words: Words, k: int) -> np.ndarray:
    """For the run of k words at each word of a batch, a hash of the least of the shorter runs within.

    Equal runs have equal ones, and so have most neighbours: what is kept by it has long stretches of a document together.
    """
    g, size = words.hash, 1
    while 4 * size <= k and size < 8:
        g = g[:-size] * _U(0x9E3779B97F4A7C15) + mix(g[size:])
        size *= 2
    g, wide = mix(g), 1
    while wide < k - size + 1:
        step = min(wide, k - size + 1 - wide)
        g, wide = np.minimum(g[:-step], g[step:]), wide + step
    return mix(g)


def _place(hot: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash is in the sorted hot ones, or -1."""
    if not len(hot):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return np.where(hot[at] == h, at, -1)


def hot_kmers(rows: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the k-mers that are in a bounded sample of the documents (doc_id, text) HOT_COUNT times or more."""
    total = rows.count()
    share = F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(1 << 30)) < int(min(1.0, HOT_SAMPLE / max(total, 1)) * (1 << 30))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            h, n = np.unique(_kmers(Words(batch.column("text")), k)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = rows.where(share).select("text").mapInArrow(write, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    best = counts.where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "h").limit(HOT_MOST).toArrow()
    return np.sort(best.column("h").to_numpy().view(np.uint64))


def runs(docs: DataFrame, k: int = K) -> DataFrame:
    """Runs of repeated k-mers, with the source coordinates of the k-mer directly before each, if that repeats too."""
    number = B.fragments(text_bytes(docs), FRAGMENT_BYTES)
    label = B.labels(number)
    rows = docs.select(_key(docs).alias("doc_id"), F.lower("text").alias("text"))
    hot = hot_kmers(rows, k)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        documents = words_held = 0
        for batch in chunked(batches):
            words = Words(batch.column("text"))
            h, doc, pos = _kmers(words, k)
            cool = np.flatnonzero(_place(hot, h) < 0)
            if not len(cool):
                continue
            fragment = B.fragment_of(_anchors(words, k)[words.first[doc[cool]] + pos[cool]], number)
            held.append((h[cool], fragment, (doc[cool] + documents).astype(np.int32), pos[cool].astype(np.uint32), batch.column("doc_id").to_numpy(zero_copy_only=False), signatures(words)))
            documents, words_held = documents + batch.num_rows, words_held + len(words)
            if words_held >= BLOCK_WORDS:
                yield block(held)
                held, documents, words_held = [], 0, 0
        if held:
            yield block(held)

    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """A row for each fragment of the k-mers of some chunks."""
        h, fragment, doc, pos, ids, sig = (np.concatenate(x) for x in zip(*held))
        held.clear()
        o = B.sort_by(fragment)
        h, doc, pos, fragment = h[o], doc[o], pos[o], fragment[o]
        cut = _edges(fragment)
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            seg = _edges(doc[a:b])  # documents are in order within a fragment
            own = doc[a:b][seg[:-1]]
            rows.append((int(label[fragment[a]]), ids[own].tobytes(), sig[own].tobytes(), np.diff(seg).astype(np.uint32).tobytes(), h[a:b].tobytes(), *_planes(pos[a:b])))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(7)], names=["fragment", "doc", "sig", "count", "key", "low", "high"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least and the largest coordinates of each hot k-mer in a chunk."""
        for batch in chunked(batches):
            words = Words(batch.column("text"))
            h, doc, pos = _kmers(words, k)
            place = _place(hot, h)
            some = np.flatnonzero(place >= 0)
            if not len(some):
                continue
            ids, sig = batch.column("doc_id").to_numpy(zero_copy_only=False), signatures(words)
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((sig, ids))] = np.arange(len(ids))
            o = some[np.lexsort((pos[some], rank[doc[some]], place[some]))]
            cut = _edges(place[o])
            signed = (sig ^ _U(1 << 63)).view(np.int64)  # so that their order is that of the signatures
            first, last = o[cut[:-1]], o[cut[1:] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(place[first]), *[pa.array(x) for i in (first, last) for x in (ids[doc[i]], signed[doc[i]], pos[i])]], names=["i", "d0", "s0", "p0", "d1", "s1", "p1"])

    def hot_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            words = Words(batch.column("text"))
            h, doc, pos = _kmers(words, k)
            place = _place(hot, h)
            some = np.flatnonzero(place >= 0)
            some = some[many[place[some]]]
            if not len(some):
                continue
            ids, sig = batch.column("doc_id").to_numpy(zero_copy_only=False), signatures(words)
            bucket = B.fragment_of(mix(ids.view(np.uint64)), number)[doc[some]]
            some = some[B.sort_by(bucket)]
            cut = _edges(np.sort(bucket, kind="stable"))
            rows = []
            for a, b in zip(cut[:-1], cut[1:]):
                own, at = doc[some[a:b]], place[some[a:b]]
                which, count = np.unique(own, return_counts=True)
                source, index = np.unique(np.stack([first_doc[at], first_sig[at].view(np.int64)]), axis=1, return_inverse=True)
                rows.append((int(label[B.fragment_of(mix(ids[which[:1]].view(np.uint64)), number)[0]]), ids[which].tobytes(), sig[which].tobytes(), count.astype(np.uint32).tobytes(), *_planes(pos[some[a:b]]), index.astype(np.uint32).ravel().tobytes(), *_planes(first_pos[at]), source[0].tobytes(), source[1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(11)], names=[x.split()[0] for x in _OCCURRENCES.split(", ")])

    def repeated(table: pa.Table) -> pa.Table:
        doc, sig, count = B.joined(table.column("doc"), np.int64), B.joined(table.column("sig"), np.uint64), B.joined(table.column("count"), np.uint32)
        key, pos, at = B.joined(table.column("key"), np.uint64), _from_planes(table.column("low"), table.column("high")), B.spans(count)
        o = np.lexsort((sig, doc))
        d, s = doc[o], sig[o]
        o = o[np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))] if len(o) else o  # rows that repeat are one document
        i = B.take_runs(at, o)
        doc, sig, count, key, pos = doc[o], sig[o], count[o], key[i], pos[i]
        del i
        owner = np.repeat(np.arange(len(doc), dtype=np.int32), count)
        # postings are in the order of document and word: the least of a run of equal keys is the first
        o = np.argsort(key).astype(np.int32)
        cut = _edges(key[o])
        del key
        size = np.diff(cut)
        first = np.empty(len(o), np.int32)
        if len(o):
            first[o] = np.repeat(np.minimum.reduceat(o, cut[:-1]), size)
            many = np.empty(len(o), bool)
            many[o] = np.repeat(size > 1, size)
        else:
            many = np.zeros(0, bool)
        del o
        i = np.flatnonzero(many)
        bucket = B.fragment_of(mix(doc.view(np.uint64)), number)
        i = i[B.sort_by(bucket[owner[i]])]
        own, first, pos_i = owner[i], first[i], pos[i]
        cut = _edges(bucket[own])
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            seg = _edges(own[a:b])
            which = own[a:b][seg[:-1]]
            source, index = np.unique(owner[first[a:b]], return_inverse=True)
            rows.append((int(label[bucket[own[a]]]), doc[which].tobytes(), sig[which].tobytes(), np.diff(seg).astype(np.uint32).tobytes(), *_planes(pos_i[a:b]), index.astype(np.uint32).tobytes(), *_planes(pos[first[a:b]]), doc[source].tobytes(), sig[source].tobytes()))
        names = [x.split()[0] for x in _OCCURRENCES.split(", ")]
        return pa.table([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(11)], names=names)

    def compact(table: pa.Table) -> pa.Table:
        doc, sig, count = B.joined(table.column("doc"), np.int64), B.joined(table.column("sig"), np.uint64), B.joined(table.column("count"), np.uint32)
        pos, first = _from_planes(table.column("low"), table.column("high")).astype(np.int64), _from_planes(table.column("first_low"), table.column("first_high")).astype(np.int64)
        sources = [np.frombuffer(x, np.int64) for x in table.column("source_doc").to_pylist()]
        shift = B.spans([len(x) for x in sources])
        index = [np.frombuffer(x, np.uint32) for x in table.column("source").to_pylist()]
        source = np.concatenate([x + s for x, s in zip(index, shift)]) if index else np.zeros(0, np.int64)
        s_doc, s_sig = np.concatenate(sources) if sources else np.zeros(0, np.int64), B.joined(table.column("source_sig"), np.uint64)
        _, row = np.unique(mix(doc.view(np.uint64)) + sig * _U(3), return_inverse=True)
        _, same, inverse = np.unique(mix(s_doc.view(np.uint64)) + s_sig * _U(3), return_index=True, return_inverse=True)
        source = inverse[source]
        segment = np.repeat(np.arange(len(doc)), count)
        o = np.lexsort((pos, row[segment]))
        r = row[segment[o]]
        o = o[np.append(True, (r[1:] != r[:-1]) | (pos[o][1:] != pos[o][:-1]))] if len(o) else o  # rows that repeat are one document
        segment, pos, first, source = segment[o], pos[o], first[o], source[o]
        r = row[segment]
        next_ = (r[1:] == r[:-1]) & (pos[1:] == pos[:-1] + 1)
        on = next_ & (source[1:] == source[:-1]) & (first[1:] == first[:-1] + 1)
        a = np.flatnonzero(np.append(True, ~on)) if len(r) else np.zeros(0, np.int64)
        n = np.diff(np.append(a, len(r)))
        joint = np.append(False, next_)[a] if len(r) else np.zeros(0, bool)
        before = np.maximum(a - 1, 0)
        signed = lambda x: x.view(np.int64)
        out = [doc[segment[a]], signed(sig[segment[a]]), pos[a], n, s_doc[same[source[a]]], signed(s_sig[same[source[a]]]), first[a]]
        prior = [s_doc[same[source[before]]], signed(s_sig[same[source[before]]]), first[before]]
        return pa.table([*map(pa.array, out), *[pa.array(x, mask=~joint) for x in prior]], names=[x.split()[0] for x in _RUNS.split(", ")])

    found = rows.mapInArrow(write, _POSTINGS).repartition(number, "fragment").groupBy("fragment").applyInArrow(repeated, _OCCURRENCES)
    if len(hot):
        sums = rows.mapInArrow(ends, "i bigint, d0 bigint, s0 bigint, p0 bigint, d1 bigint, s1 bigint, p1 bigint")
        sums = sums.groupBy("i").agg(F.min(F.struct("d0", "s0", "p0")).alias("a"), F.max(F.struct("d1", "s1", "p1")).alias("b")).select("i", "a.*", "b.*").toArrow()
        many, first_doc, first_sig, first_pos = np.zeros(len(hot), bool), *(np.zeros(len(hot), t) for t in (np.int64, _U, np.int64))
        at, d, x, p, d1, x1, p1 = (sums.column(c).to_numpy() for c in ("i", "d0", "s0", "p0", "d1", "s1", "p1"))
        many[at] = (d != d1) | (x != x1) | (p != p1)
        first_doc[at], first_sig[at], first_pos[at] = d, x.view(np.uint64) ^ _U(1 << 63), p
        found = found.unionByName(rows.mapInArrow(hot_occurrences, _OCCURRENCES))
    return checkpoint(found.repartition(number, "bucket").groupBy("bucket").applyInArrow(compact, _RUNS))


def cuts(found: DataFrame) -> DataFrame:
    """Distinct runs (first_doc, first_sig, first_start, n) that nodes cut, and where their pieces begin, with the end of the last.

    The cuts of a run depend on its source coordinates alone, so a run is cut once, however often it occurs; one of a single k-mer has no node inside.
    """
    source = lambda d, s, p: F.struct(F.col(d).alias("first_doc"), F.col(s).alias("first_sig"), p.alias("node"))
    ends = F.array(source("before_doc", "before_sig", F.col("before") + 1), source("first_doc", "first_sig", F.col("first_start")))
    nodes = found.where("before is not null").select(F.explode(ends).alias("x")).select("x.*").distinct()
    nodes = nodes.groupBy("first_doc", "first_sig").agg(F.array_sort(F.collect_list("node")).alias("_nodes"))
    whole = found.where("n > 1").select("first_doc", "first_sig", "first_start", "n").distinct()
    whole = whole.groupBy("first_doc", "first_sig").agg(F.collect_list("first_start").alias("_starts"), F.collect_list("n").alias("_sizes"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes, nodes_ = (batch.column(c) for c in ("_starts", "_sizes", "_nodes"))
            run_at, node_at = B.spans(starts.value_lengths().to_numpy()), B.spans(nodes_.value_lengths().to_numpy())
            start, size, node = (x.flatten().to_numpy() for x in (starts, sizes, nodes_))
            row = np.repeat(np.arange(batch.num_rows), np.diff(run_at))
            low, high = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
            for r in range(batch.num_rows):
                i, own = slice(run_at[r], run_at[r + 1]), node[node_at[r] : node_at[r + 1]]
                low[i] = np.searchsorted(own, start[i], "right") + node_at[r]
                high[i] = np.searchsorted(own, start[i] + size[i], "left") + node_at[r]
            some = np.flatnonzero(high > low)
            inner = high[some] - low[some]
            at = B.spans(inner + 2)
            out = np.empty(at[-1], np.int64)
            out[at[:-1]], out[at[1:] - 1] = start[some], start[some] + size[some]
            j = np.arange(inner.sum()) - np.repeat(B.spans(inner)[:-1], inner)
            out[np.repeat(at[:-1] + 1, inner) + j] = node[np.repeat(low[some], inner) + j]
            doc, sig = (batch.column(c).to_numpy()[row[some]] for c in ("first_doc", "first_sig"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sig), pa.array(start[some]), pa.array(size[some]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out))], names=["first_doc", "first_sig", "first_start", "n", "cuts"])

    return whole.join(nodes, ["first_doc", "first_sig"]).mapInArrow(split, "first_doc bigint, first_sig bigint, first_start bigint, n bigint, cuts array<bigint>")


def paths(docs: DataFrame, k: int = K) -> DataFrame:
    """Nonbranching paths at each place where they occur: doc_id, sig, start, n (k-mers), first_doc, first_sig, first_start."""
    found = runs(docs, k)
    columns = ["doc_id", "sig", "start", "n", "first_doc", "first_sig", "first_start"]
    rows = found.where("n > 1").select(*columns).join(cuts(found), ["first_doc", "first_sig", "first_start", "n"], "left")
    rows = rows.withColumn("cuts", F.coalesce("cuts", F.array("first_start", F.col("first_start") + F.col("n"))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)))
    here = F.element_at("cuts", F.col("i"))
    rows = rows.withColumns({"shift": here - F.col("first_start"), "length": F.element_at("cuts", F.col("i") + 1) - here})
    rows = rows.select("doc_id", "sig", (F.col("start") + F.col("shift")).alias("start"), F.col("length").alias("n"), "first_doc", "first_sig", (F.col("first_start") + F.col("shift")).alias("first_start"))
    return found.where("n = 1").select(*columns).unionByName(rows)


class Joined:
    """Words of a batch joined by blanks, to take digests of runs of them."""

    def __init__(self, words: Words):
        size = words.end - words.begin
        self.at = B.spans(size + 1)
        self.raw = np.full(self.at[-1], 32, np.uint8)
        self.raw[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = words.data[words._flag]
        self.first = words.first

    def digest(self, doc: int, start: int, n: int) -> bytes | None:
        """128 bits over n words of a text, from the given one; None where the text has fewer."""
        a = self.first[doc] + start
        if a + n > self.first[doc + 1]:
            return None
        return hashlib.blake2b(self.raw[self.at[a] : self.at[a + n] - 1].tobytes(), digest_size=16).digest()


def _filter(ids: DataFrame) -> np.ndarray:
    """One bit for each hash value that an ``_id`` has; its size doesn't depend on theirs."""
    spot = F.pmod(F.xxhash64("_id"), F.lit(1 << FILTER_BITS)) + 1
    parts = ids.select(spot.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("g")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    out = np.zeros((1 << FILTER_BITS) >> 3, np.uint8)
    for r in parts:
        at = (r.g - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.m), np.uint8)[: len(out) - at]
    return out


def _signed(rows: DataFrame, keep: list[str], bits: np.ndarray, inside: bool) -> DataFrame:
    """Adds ``_sig`` to the rows that have ``_id`` and ``_text``, of those that pass the filter (or don't)."""
    columns = [*keep, "_id", "_text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column("_spot").to_numpy()
            own = (bits[spot >> 3] >> (spot & 7) & 1) == int(inside)
            if not own.any():
                continue
            for part in chunked(iter([batch.filter(pa.array(own))]), "_text"):
                sig = signatures(Words(part.column("_text"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(sig)], names=[*columns, "_sig"])

    spot = F.pmod(F.xxhash64("_id"), F.lit(1 << FILTER_BITS)).cast("int")
    schema = rows.select(*columns).schema.add("_sig", "long")
    return rows.select(*columns, spot.alias("_spot")).mapInArrow(sign, schema)


def witnessed(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The paths with the digest of the words at their source coordinates."""
    keys = ["first_doc", "first_sig", "first_start", "n"]
    wanted = found.select(*keys).distinct().groupBy("first_doc", "first_sig").agg(F.collect_list(F.struct("first_start", "n")).alias("_spans"))
    wanted = wanted.withColumnsRenamed({"first_doc": "_id", "first_sig": "_sig"})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            text = Joined(Words(batch.column("_text")))
            out: list[tuple] = []
            for r, (doc, sig, items) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_id", "_sig", "_spans")))):
                out += [(doc, sig, x["first_start"], x["n"], text.digest(r, x["first_start"], x["n"] + k - 1)) for x in items]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 4 else pa.binary()) for i in range(5)], names=[*keys, "witness"])

    rows = docs.select(_key(docs).alias("_id"), F.lower("text").alias("_text"))
    rows = _signed(rows, [], _filter(found.select(F.col("first_doc").alias("_id"))), True).join(wanted, ["_id", "_sig"])
    # rows that repeat a document say the same
    said = rows.mapInArrow(read, "first_doc bigint, first_sig bigint, first_start bigint, n bigint, witness binary").groupBy(*keys).agg(F.first("witness").alias("witness"))
    return found.join(said, keys)


def spans(docs: DataFrame, k: int = K) -> DataFrame:
    """Every occurrence of every repeated nonbranching path, the first one included."""
    ship(docs.sparkSession)
    found = witnessed(docs, checkpoint(paths(docs, k)), k)
    own = checkpoint(found.groupBy(F.col("doc_id").alias("_id"), F.col("sig").alias("_sig")).agg(F.collect_list(F.struct("start", "n", "first_doc", "first_start", "witness")).alias("_spans")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            text = Joined(Words(batch.column("_text")))
            out: list[tuple] = []
            for r, (doc, sig, items) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_id", "_sig", "_spans")))):
                out += [(doc, sig, x["start"], x["n"] + k - 1, x["first_doc"], x["first_start"]) for x in items if x["witness"] is not None and text.digest(r, x["start"], x["n"] + k - 1) == x["witness"]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(6)], names=["doc_id", "_sig", "start", "n_words", "first_doc", "first_start"])

    rows = _signed(docs.select(_key(docs).alias("_id"), F.lower("text").alias("_text")), [], _filter(own.select("_id")), True).join(own, ["_id", "_sig"])
    rows = rows.mapInArrow(verify, "doc_id bigint, _sig bigint, start bigint, n_words bigint, first_doc bigint, first_start bigint").distinct()
    rows = rows.select(*[F.nullif(F.col(c), F.lit(LAST)).alias(c) if c.endswith("doc_id") or c == "first_doc" else F.col(c) for c in ("doc_id", "start", "n_words", "first_doc", "first_start")])
    return named_ids(rows, docs, "doc_id", ["doc_id", "first_doc"])


def remove(docs: DataFrame, k: int = K) -> DataFrame:
    """The rows of ``docs`` without the repeated passages, but for each passage's first occurrence; n_chars follows the text."""
    ship(docs.sparkSession)
    columns = docs.columns
    names = [f"_c{i}" for i in range(len(columns))]
    ident, text = (names[columns.index(c)] for c in ("doc_id", "text"))
    later = checkpoint(paths(docs, k).where("not (doc_id = first_doc and sig = first_sig and start = first_start)"))
    later = witnessed(docs, later, k).groupBy(F.col("doc_id").alias("_id"), F.col("sig").alias("_sig")).agg(F.collect_list(F.struct("start", "n", "witness")).alias("_spans"))
    later = checkpoint(later)
    plain = docs.toDF(*names)
    plain = plain.select(*names, _key(plain, ident).alias("_id"), F.lower(text).alias("_text"))
    schema = plain.select(*names).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in chunked(batches, "_text"):
            # the words are sought in the text itself: its positions are its own
            out, found = batch.column(at).to_pylist(), Words(batch.column(at))
            lowered = Joined(Words(batch.column("_text")))
            for r, items in enumerate(batch.column("_spans").to_pylist()):
                spans_ = [(x["start"], x["n"] + k - 1) for x in items or [] if x["witness"] is not None and lowered.digest(r, x["start"], x["n"] + k - 1) == x["witness"]]
                if not spans_:
                    continue
                raw, first, last = out[r].encode(), found.first[r], found.first[r + 1]
                gone = np.zeros(last - first + 1, np.int64)
                s, n = np.array(spans_).T
                np.add.at(gone, s, 1)
                np.add.at(gone, s + n, -1)
                gone = np.cumsum(gone)[:-1] > 0
                # a word goes with what separates it from the next
                begin = np.append(found.begin[first:last] - found.at[r], len(raw))
                kept, edge = [raw[: begin[0]]], _edges(gone)
                kept += [raw[begin[a] : begin[b]] for a, b in zip(edge[:-1], edge[1:]) if not gone[a]]
                out[r] = b"".join(kept).decode()
            arrays = [batch.column(i) for i in range(len(names))]
            arrays[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    bits = _filter(later.select("_id"))
    # documents without a repeat pass by; the others meet their spans
    joined = _signed(plain, names, bits, True).join(later, ["_id", "_sig"], "left")
    rows = joined.select(*names, "_spans", "_text").mapInArrow(cut, schema).unionByName(_signed(plain, names, bits, False).select(*names)).toDF(*columns)
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows


def oracle(k: int = K) -> str:
    return f"""with w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') w from documents where doc_id is not null),
  p as (select doc_id, w, unnest(range(0, len(w) - {k} + 1)) pos from w where len(w) >= {k}),
  m as (select doc_id, pos, md5(array_to_string(list_slice(w, pos + 1, pos + {k}), ' ')) m from p),
  f as (select doc_id, pos, min({{'d': doc_id, 'p': pos}}) over (partition by m) f, count(*) over (partition by m) n from m),
  e as (select doc_id, pos, f.d fd, f.p fp from f where n > 1),
  l as (select *, lag(pos) over x lp, lag(fd) over x ld, lag(fp) over x lf from e window x as (partition by doc_id order by pos)),
  j as (select * from l where lp = pos - 1 and not (ld = fd and lf = fp - 1)),
  node as (select ld d, lf + 1 p from j union select fd, fp from j),
  c as (select l.*, case when lp = pos - 1 and ld = fd and lf = fp - 1 and node.d is null then 0 else 1 end b from l left join node on node.d = fd and node.p = fp),
  r as (select *, sum(b) over (partition by doc_id order by pos) run from c)
select doc_id, min(pos) as start, count(*) + {k - 1} as n_words, any_value(fd) as first_doc, min(fp) as first_start from r group by doc_id, run"""
