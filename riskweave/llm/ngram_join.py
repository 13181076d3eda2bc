"""Self-join of documents on the Jaccard similarity of their n-gram sets, by vertical partitioning.

A document's set is that of its runs of N words (all of its words together
where it has fewer). Documents with equal sets are one vertex throughout,
however many they are, and stand for one another; so copies are never expanded
into pairs. Every pair of vertices with |A & B| / |A | B| >= threshold is found:

1. The hash order of n-grams is cut into fragments. Each fragment counts by
   itself in how many different sets a gram occurs; grams of one set alone
   cannot overlap and go no further. Summed over fragments this gives how much
   of a set is shared at all, and sets that share too little for any partner drop out.
2. The remaining grams are put in a global order, rare before frequent, which is
   cut into fragments of equal size. Two similar sets must share a gram among
   the first of each (prefix filter) and have sizes within the threshold. Each
   fragment counts by itself how many grams of it the prefixes of two sets share.
   A fragment whose lists are so long that they make too many pairs is split
   into parts of its sets, each two of which meet in a task of their own.
3. The counts are summed for each pair. What two sets can share behind their
   prefixes is bounded; pairs that cannot reach the threshold drop out.
4. The pairs left are cut into cells of bounded size, of which each has pairs
   that have sets in common, and the global order into PARTS parts. Each part of
   each cell counts the overlap of its pairs; the counts are summed for each pair
   and compared with the threshold exactly.

No candidate, partner or gram is capped. Grams and sets are known by 64 bits of
a hash, at every size of the input: the overlap of a pair is wrong with a
probability of at most |A| * |B| / 2**64, and the sets of two given documents
are taken as equal with one of 2**-64.

``classes`` has one row for each document: its class (all documents that are
linked, directly or through others, by the least of their doc_ids) with the
number of its copies and of its links to different sets. ``vertex_pairs`` has
the links themselves, and ``members`` the documents of each vertex.

Defined cases: a text that is null or has no words has an empty set, no copy and
no link, and is a class of its own; a row whose doc_id is null is a document
like others, and its class has a null id only where no document of it has an id;
rows that repeat doc_id and set are one document, and rows that repeat only
doc_id are documents of their own; ``deduplicate`` keeps of each class the
document of the least doc_id (null counts as the last), all rows without words,
and of rows that repeat doc_id and set the one whose text has the least hash;
ties of doc_id go by the set's hash; identifiers may be of any type that has an
order; an empty table gives no rows; extra columns are ignored by ``classes`` and
kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _blocks as B
from ._spark import checkpoint, ship, text_bytes
from ._text import Words, chunked, mix

N = 3
#: The threshold as a fraction.
THRESHOLD = (1, 2)
#: Text bytes whose grams make a fragment of the first step, and grams in one of the later steps.
FRAGMENT_BYTES = 16 << 20
FRAGMENT_GRAMS = 3_000_000
#: Pairs that a task of the second step may go through, pairs and grams in a cell of the last step, sets of a hot cell, and parts of the order there.
TASK_PAIRS = 200_000_000
CELL_PAIRS, CELL_GRAMS, CELL_SETS, PARTS = 200_000, 2_000_000, 10_000, 2
_U = np.uint64
_BANDS = 64
_SURVIVORS = "sig binary, size binary, count binary, prefix binary, key binary, band binary, hist array<bigint>, work array<bigint>"


def _need(size: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """The least overlap of a set of this size with any partner."""
    return -((-size.astype(np.int64) * threshold[0]) // threshold[1])


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, text) of each text's set in the order of text and gram, the set's signature and its size."""
    g, doc = Words(texts).grams(n)
    o = np.argsort(g)
    o = o[B.sort_by(doc[o].astype(np.uint16 if len(texts) < 65536 else np.uint32))]
    g, doc = g[o], doc[o]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
    size = np.bincount(doc, minlength=len(texts)).astype(np.uint32)
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(mix(g), out=total[1:])
    at = B.spans(size)
    return g, doc, mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)), size


def _members(docs: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """Adds ``_sig`` and ``_size`` of each row's set to its columns."""
    schema = docs.select(*columns).schema.add("_sig", "long").add("_size", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            _, _, sig, size = _sets(batch.column("_text"), n)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], pa.array(sig.view(np.int64)), pa.array(size.astype(np.int64))], names=[*columns, "_sig", "_size"])

    return docs.select(*columns, F.lower("text").alias("_text")).mapInArrow(rows, schema)


def _vertices(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Blocks of the sets that share enough grams with others, each in the global order."""
    number = B.fragments(text_bytes(docs), FRAGMENT_BYTES)
    label = B.labels(number)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            g, doc, sig, size = _sets(batch.column("text"), n)
            if not len(g):
                continue
            fragment = B.fragment_of(g, number)
            o = B.sort_by(fragment)
            g, doc, fragment = g[o], doc[o], fragment[o]
            at = np.append(np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1])), len(g))
            out: list[list] = [[], [], [], [], []]
            for a, b in zip(at[:-1], at[1:]):
                own, count = np.unique(doc[a:b], return_counts=True)
                for to, x in zip(out, (int(label[fragment[a]]), sig[own].tobytes(), size[own].tobytes(), count.astype(np.uint32).tobytes(), g[a:b].tobytes())):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["fragment", "sig", "size", "count", "key"])

    def shared(table: pa.Table) -> pa.Table:
        sig, size, count = B.joined(table.column("sig"), np.uint64), B.joined(table.column("size"), np.uint32), B.joined(table.column("count"), np.uint32)
        key, at = B.joined(table.column("key"), np.uint64), B.spans(count)
        sig, first = np.unique(sig, return_index=True)  # an equal set has an equal segment here
        key, size, count = key[B.take_runs(at, first)], size[first], count[first]
        o = np.argsort(key)
        k = key[o]
        at = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
        df = np.empty(len(k), np.uint32)
        df[o] = np.repeat(np.diff(at), np.diff(at))
        del o, k
        keep = df > 1
        count = np.add.reduceat(keep, B.spans(count)[:-1], dtype=np.uint32)
        key = mix(key[keep])  # within a fragment the first bits are the same
        band = np.ceil(np.log2(df[keep])).astype(np.uint8)
        some = count > 0
        sig, size, count = sig[some], size[some], count[some]
        bucket = B.fragment_of(sig, number)
        cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
        at = B.spans(count)
        rows = [(int(label[bucket[a]]), sig[a:b].tobytes(), size[a:b].tobytes(), count[a:b].tobytes(), key[at[a] : at[b]].tobytes(), band[at[a] : at[b]].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=["bucket", "sig", "size", "count", "key", "band"])

    def survive(table: pa.Table) -> pa.Table:
        sig, size, count = B.joined(table.column("sig"), np.uint64), B.joined(table.column("size"), np.uint32), B.joined(table.column("count"), np.uint32)
        at = B.spans(count)
        own, first, which = np.unique(sig, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=count).astype(np.int64)
        size = size[first]
        need = _need(size, threshold)
        live = np.flatnonzero(total >= need)
        o = B.sort_by(which)
        o = o[(total >= need)[which[o]]]  # segments of the live sets, set after set
        i = B.take_runs(at, o)
        key, band = B.joined(table.column("key"), np.uint64)[i], B.joined(table.column("band"), np.uint8)[i]
        vertex = np.repeat(np.arange(len(live)), total[live])
        o = np.lexsort((key, band, vertex))
        key, band = key[o], band[o]
        inside = np.arange(len(key)) - np.repeat(B.spans(total[live])[:-1], total[live])
        first_band = band[inside < np.repeat((total - need + 1)[live], total[live])]
        hist, work = np.bincount(band, minlength=_BANDS).tolist(), np.bincount(first_band, minlength=_BANDS).tolist()
        row = (own[live].tobytes(), size[live].tobytes(), total[live].astype(np.uint32).tobytes(), (total - need + 1)[live].astype(np.uint32).tobytes(), key.tobytes(), band.tobytes())
        return pa.table([*[pa.array([x] if len(live) else [], pa.binary()) for x in row], *[pa.array([x] if len(live) else [], pa.list_(pa.int64())) for x in (hist, work)]], names=["sig", "size", "count", "prefix", "key", "band", "hist", "work"])

    blocks = docs.select(F.lower("text").alias("text")).mapInArrow(write, "fragment int, sig binary, size binary, count binary, key binary")
    blocks = blocks.repartition(number, "fragment").groupBy("fragment").applyInArrow(shared, "bucket int, sig binary, size binary, count binary, key binary, band binary")
    return checkpoint(blocks.repartition(number, "bucket").groupBy("bucket").applyInArrow(survive, _SURVIVORS))


def vertex_pairs(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Pairs of different sets: a, b (signatures), size_a, size_b and overlap."""
    ship(docs.sparkSession)
    vertices = _vertices(docs, n, threshold)
    hist, prefixes = np.zeros(_BANDS, np.int64), np.zeros(_BANDS, np.int64)
    for band, number, first in vertices.select(F.posexplode(F.arrays_zip("hist", "work")).alias("band", "x")).groupBy("band").agg(F.sum("x.hist"), F.sum("x.work")).collect():
        hist[band], prefixes[band] = number, first
    below, number, total = np.cumsum(hist) - hist, hist, int(hist.sum())
    # a gram of band x is in at most 2**x sets, which bounds the pairs that a fragment's lists make
    ends = np.arange(0, total + FRAGMENT_GRAMS, FRAGMENT_GRAMS)
    within = np.clip(np.minimum(ends[1:, None], below + number) - np.maximum(ends[:-1, None], below), 0, None)
    pairs_of = (within / np.maximum(number, 1) * prefixes * 2.0 ** np.arange(_BANDS)).sum(1)
    split = np.maximum(np.ceil(np.sqrt(pairs_of / TASK_PAIRS)), 1).astype(np.int64)
    t0, t1 = threshold

    def place_of(key: np.ndarray, band: np.ndarray) -> np.ndarray:
        """About the place of a gram in the order (band, key)."""
        return below[band] + (key.astype(np.float64) * (number[band] / 2.0**64)).astype(np.int64)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """sig, size, count, prefix, key and band of each block of sets."""
        kinds = {"sig": np.uint64, "size": np.uint32, "count": np.uint32, "prefix": np.uint32, "key": np.uint64, "band": np.uint8}
        for batch in batches:
            for r in range(batch.num_rows):
                yield tuple(np.frombuffer(batch.column(c)[r].as_py(), k) for c, k in kinds.items())

    def prefix_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, size, count, first, key, band in unpacked(batches):
            vertex = np.repeat(np.arange(len(sig)), count)
            i = np.arange(len(key)) - np.repeat(B.spans(count)[:-1], count) < np.repeat(first, count)
            key, band, vertex = key[i], band[i], vertex[i]
            fragment = (place_of(key, band) // FRAGMENT_GRAMS).astype(np.int32)
            o = np.lexsort((key, vertex, fragment))
            key, vertex, fragment = key[o], vertex[o], fragment[o]
            cut = np.append(np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1])), len(fragment)) if len(key) else np.zeros(1, int)
            rest, rows = (count - first).astype(np.uint32), []
            for a, b in zip(cut[:-1], cut[1:]):
                f = int(fragment[a])
                own, c = np.unique(vertex[a:b], return_counts=True)
                at = B.spans(c)
                part = (sig[own] % _U(split[f])).astype(np.int64)
                for p in np.unique(part).tolist():
                    w = np.flatnonzero(part == p)
                    v = own[w]
                    row = (sig[v].tobytes(), size[v].tobytes(), rest[v].tobytes(), c[w].astype(np.uint32).tobytes(), key[a:b][B.take_runs(at, w)].tobytes())
                    rows += [(f, min(p, x), max(p, x), *row) for x in range(int(split[f]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int32() if i < 3 else pa.binary()) for i in range(8)], names=["fragment", "x", "y", "sig", "size", "rest", "count", "key"])

    def candidates(table: pa.Table) -> pa.Table:
        f, x, y = (table.column(c)[0].as_py() for c in ("fragment", "x", "y"))
        sig, size, rest, count = B.joined(table.column("sig"), np.uint64), *(B.joined(table.column(c), np.uint32).astype(np.int64) for c in ("size", "rest", "count"))
        key, at = B.joined(table.column("key"), np.uint64), B.spans(count)
        o = np.lexsort((sig, size))  # from here a vertex is known by its place in the order of size
        key, sig, size, rest, count = key[B.take_runs(at, o)], sig[o], size[o], rest[o], count[o]
        at, vertex = B.spans(count), np.repeat(np.arange(len(sig)), count)
        side = sig % _U(split[f]) == _U(x)
        o = np.argsort(key, kind="stable")
        k, listed = key[o], vertex[o]
        new = np.append(True, k[1:] != k[:-1])
        run = np.empty(len(k), np.int64)
        run[o] = np.cumsum(new) - 1
        lists = np.append(np.flatnonzero(new), len(k))
        longest = np.searchsorted(size, size * t1 // t0, "right")
        out: list[list] = [[], [], []]
        for a in range(len(sig)):
            own = run[at[a] : at[a + 1]]
            own = own[lists[own + 1] - lists[own] > 1]
            if len(own):
                b = listed[B.take_runs(lists, own)]
                b = b[(b > a) & (b < longest[a])]
                if x != y:
                    b = b[side[b] != side[a]]
                if len(b):
                    b, shared = np.unique(b, return_counts=True)
                    for to, part in zip(out, (np.full(len(b), a), b, shared)):
                        to.append(part)
        a, b, shared = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        columns = (sig[a].view(np.int64), sig[b].view(np.int64), size[a], size[b], np.maximum(rest[a], rest[b]), shared)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "size_a", "size_b", "rest", "shared"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each set and part of the order: sig, part and the sorted grams."""
        for sig, _, count, _, key, band in unpacked(batches):
            part = np.minimum(place_of(key, band) * PARTS // max(total, 1), PARTS - 1)
            vertex = np.repeat(np.arange(len(sig)), count)
            o = np.lexsort((key, part, vertex))
            key, group = key[o], vertex[o] * PARTS + part[o]
            at = np.searchsorted(group, np.arange(len(sig) * PARTS + 1))
            for first in range(0, len(sig), 1000):
                i = range(first * PARTS, min(first + 1000, len(sig)) * PARTS)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sig[first : first + 1000], PARTS).view(np.int64)), pa.array([j % PARTS for j in i], pa.int32()), pa.array([key[at[j] : at[j + 1]].tobytes() for j in i], pa.binary())], names=["v", "part", "key"])

    def overlaps(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["a", "b", "size_a", "size_b", "overlap"], [pa.int64()] * 5
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        ids = left.column("v").to_numpy()
        count = np.array([len(x) // 8 for x in left.column("key").to_pylist()], np.int64)
        key, at = B.joined(left.column("key"), np.uint64), B.spans(count)
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids[order], right.column(c).to_numpy())] for c in ("a", "b"))
        chosen = B.sort_by(a)
        overlap = np.zeros(len(chosen), np.int64)
        va, vb = a[chosen], b[chosen]
        cut = np.append(np.flatnonzero(np.append(True, va[1:] != va[:-1])), len(va))
        for i, j in zip(cut[:-1], cut[1:]):
            own = key[at[va[i]] : at[va[i] + 1]]
            if len(own):
                others = key[B.take_runs(at, vb[i:j])]
                hit = np.append(own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others, False)
                sums = B.spans(hit)
                ends = B.spans(at[vb[i:j] + 1] - at[vb[i:j]])
                overlap[i:j] = sums[ends[1:]] - sums[ends[:-1]]
        some = np.flatnonzero(overlap)
        return pa.table([*[pa.array(right.column(c).to_numpy()[chosen[some]]) for c in ("a", "b", "size_a", "size_b")], pa.array(overlap[some])], names=names)

    enough = lambda c: c * (t0 + t1) >= (F.col("size_a") + F.col("size_b")) * t0
    block = "fragment int, x int, y int, sig binary, size binary, rest binary, count binary, key binary"
    pair = "a bigint, b bigint, size_a bigint, size_b bigint"
    found = vertices.mapInArrow(prefix_segments, block).groupBy("fragment", "x", "y").applyInArrow(candidates, pair + ", rest bigint, shared bigint")
    found = found.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"), F.max("rest").alias("rest"))
    found = checkpoint(found.where(enough(F.col("shared") + F.col("rest"))).select("a", "b", "size_a", "size_b"))
    # sets that are near each other get the same home, so that few sets are needed in several cells
    near = found.select(F.col("a").alias("v"), F.col("b").alias("u"), F.lit(1).alias("n")).unionByName(found.select(F.col("b").alias("v"), F.col("a").alias("u"), F.lit(0).alias("n")))
    near = near.groupBy("v").agg(F.min("u").alias("u"), F.sum("n").alias("n")).select("v", F.least("v", "u").alias("home"), "n")
    homes = near.groupBy("home").agg(F.sum("n").alias("pairs"), F.count("*").alias("sets"))
    homes = homes.select("home", F.greatest(F.ceil(F.sqrt(F.col("pairs") / CELL_PAIRS)), F.ceil(F.col("sets") / CELL_SETS)).alias("split"))
    near = near.join(homes, "home").select(F.col("v").alias("a"), "home", "split")
    cells = max(1, -(-found.count() // CELL_PAIRS), -(-total // CELL_GRAMS))
    spot = F.when(F.col("split") > 1, F.xxhash64("home", F.pmod("a", "split"), F.pmod("b", "split"))).otherwise(F.xxhash64("home"))
    celled = found.join(near, "a").select("a", "b", "size_a", "size_b", F.pmod(spot, F.lit(cells)).alias("cell"))
    celled = checkpoint(celled)
    needed = celled.select(F.col("a").alias("v"), F.col("cell").alias("_cell")).union(celled.select("b", "cell")).distinct()
    left = vertices.mapInArrow(sets, "v bigint, part int, key binary").join(needed, "v").select(F.col("_cell").alias("cell_"), "part", "v", "key")
    right = celled.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])))
    parts = left.groupBy("cell_", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(overlaps, pair + ", overlap bigint")
    return parts.groupBy("a", "b", "size_a", "size_b").agg(F.sum("overlap").alias("overlap")).where(enough(F.col("overlap")))


def members(docs: DataFrame, n: int = N) -> DataFrame:
    """The documents of each vertex: doc_id, _sig (signature) and _size of the set; rows that repeat doc_id and set are one."""
    ship(docs.sparkSession)
    return _members(docs.select("doc_id", "text"), n, ["doc_id"]).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """The least vertex reachable from each vertex of the pairs (a, b): a, label. Labels go to neighbours and then to the labels' labels until none changes."""
    edges = checkpoint(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("far"))
        step = checkpoint(step.join(jump, "label", "left").select("a", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        changed = step.where("label != old").limit(1).count()
        labels = step.select("a", "label")
        if not changed:
            return labels


def classes(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, class_id, n_copies (other documents with the same set) and n_links (similar sets that differ from its own)."""
    own = checkpoint(members(docs, n))
    pairs = checkpoint(vertex_pairs(docs, n, threshold).select("a", "b"))
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    links = ends.groupBy("a").agg(F.count("*").alias("n_links")).join(components(pairs), "a")
    # a class is worked out on its vertices, so no task has all documents of it
    vertices = own.where("_size > 0").groupBy(F.col("_sig").alias("a")).agg(F.min("doc_id").alias("least"), (F.count("*") - 1).alias("n_copies"))
    vertices = vertices.join(links, "a", "left").withColumn("label", F.coalesce("label", "a"))
    least = vertices.groupBy("label").agg(F.min("least").alias("class_id"))
    vertices = vertices.join(least, "label").select(F.col("a").alias("_sig"), "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    rows = own.where("_size > 0").join(vertices, "_sig").select("doc_id", "class_id", "n_copies", "n_links")
    zero = F.lit(0).cast("bigint")
    return rows.unionByName(own.where("_size = 0").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_copies"), zero.alias("n_links")))


def deduplicate(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row of each class, that of the least doc_id, and all rows without words. The columns of ``docs``."""
    ship(docs.sparkSession)
    columns = docs.columns
    names = [f"_c{i}" for i in range(len(columns))]
    ident, text = (names[columns.index(c)] for c in ("doc_id", "text"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias("_doc")
    plain = docs.toDF(*names).withColumn("text", F.col(text))
    least = members(docs, n).where("_size > 0").groupBy("_sig").agg(F.min(F.struct(F.isnull("doc_id").alias("x"), F.col("doc_id"))).alias("first"))
    labels = components(vertex_pairs(docs, n, threshold))
    least = least.join(labels.withColumnRenamed("a", "_sig"), "_sig", "left")
    kept = least.groupBy(F.coalesce("label", "_sig")).agg(F.min(F.struct("first.x", "first.doc_id", "_sig")).alias("k")).select("k._sig", "k.doc_id")
    kept = kept.select("_sig", key("doc_id"), F.lit(1).alias("_in"))
    rows = _members(plain, n, names)
    # rows without words belong to no class; each has a key of its own, which spreads them
    rows = rows.withColumn("_doc", F.when(F.col("_size") > 0, key(ident)).otherwise(F.concat(F.lit("empty"), F.monotonically_increasing_id())))
    # of rows that repeat, a task sends one
    again = F.row_number().over(Window.partitionBy("_sig", "_doc").orderBy(F.xxhash64(text)))
    rows = rows.withColumn("_again", again).where("_again = 1").join(kept, ["_sig", "_doc"], "left")
    return rows.where("_in = 1 or _size = 0").select(*names).toDF(*columns)


def oracle(n: int = N, threshold: tuple[int, int] = THRESHOLD) -> str:
    return f"""with recursive w as (select doc_id, coalesce(regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) w from documents),
  m as (select distinct doc_id, case when len(w) = 0 then [] else list_sort(list_distinct(case when len(w) < {n} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) end)) end s from w),
  v as (select s, row_number() over () v, count(*) - 1 n_copies, min(doc_id) least from m where len(s) > 0 group by s),
  g as (select v, len(s) n, unnest(s) g from v),
  p as (select a.v a, b.v b from g a join g b on a.g = b.g and a.v < b.v group by a.v, b.v, a.n, b.n having count(*) * {sum(threshold)} >= (a.n + b.n) * {threshold[0]}),
  e as (select a, b from p union all select b, a from p),
  c as (select v, v label from v union select e.b, c.label from c join e on e.a = c.v),
  l as (select v, min(label) label from c group by v),
  k as (select label, min(least) class_id from l join v using (v) group by label)
select m.doc_id, case when len(m.s) = 0 then m.doc_id else class_id end class_id, coalesce(n_copies, 0)::bigint n_copies, coalesce(n_links, 0)::bigint n_links
from m left join v on v.s = m.s left join l using (v) left join k using (label) left join (select a v, count(*) n_links from e group by a) d using (v)"""
