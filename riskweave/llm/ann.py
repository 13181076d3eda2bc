"""Approximate nearest neighbours by collision counting.

For each query vector its K nearest others by Euclidean distance are wanted.
Each of PROJECTIONS random directions maps a vector to one number, and a block
of vectors is held as one sorted array a direction. Around a query and for a
radius R the window of a direction is centred on the query's own projection and
reaches HALF_WIDTH * R to either side; virtual rehashing widens all windows over
the same sorted arrays. A vector in the windows of at least THRESHOLD directions
collides, and only then its distance is computed. The radius at which a vector
begins to collide is its *reach*, so it is found once R is at least the larger
of its reach and its distance; the result is the K vectors for which this larger
one is least, in the order of distance. A vector at distance R has reach R or
less with probability CONFIDENCE. This definition knows of no blocks: how the
vectors are split doesn't change the result.

1. A bounded sample, the SAMPLE vectors that are least by a hash, is searched
   first, with windows that widen by STEP at a time. Its K-th radius bounds the
   radius of the whole search for each query.
2. All vectors are cut into groups by ranges of one fitted direction, the first
   principal one of the sample. The vectors go to their group once; the queries,
   which are the smaller side, visit every group. In a group the windows reach
   the bound, which gets less with each block. A block in whose arrays too few
   windows have a place is passed over.
3. The groups' K best are merged for each query.

Every vector is indexed and nothing is capped. Each query counts collisions in
every block that its windows reach, so the whole is linear in the number of
vectors for each query.

The result: vec_id, rank, neighbor and distance (six places), with ties in the
order of neighbor. Fewer than K others give fewer rows.

Defined cases: rows whose vec_id or embedding is null, or whose embedding is
empty or has a null, NaN or infinite element, take no part; vectors of different
lengths are never compared; rows that repeat vec_id and embedding are one; rows
that repeat vec_id only are each a query, and none is a neighbour of the same
vec_id; where vec_id isn't of an integer type, a 64-bit hash stands for it
within the search, and decides ties; extra columns are ignored; an empty table,
or no query, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpoint, integer_ids, named_ids, ship

K = 10
PROJECTIONS = 192
HALF_WIDTH = 1.4
CONFIDENCE = 0.95
STEP = 1.08
SEED = 20240611
#: Vectors whose search gives each query its first bound, and from which the direction of the ranges is fitted.
SAMPLE = 2048
#: Vectors in a block of sorted arrays (places in them are 16-bit numbers), bytes of vectors in a group, and queries in a row.
BLOCK, GROUP_BYTES, QUERIES = 8_192, 32 << 20, 512
#: Queries whose collisions are counted together.
BATCH = 16
_ROW = "grp int, kind int, dim int, ids binary, v binary, extra binary"
_FOUND = "vec_id bigint, mark bigint, neighbor bigint, distance double, radius double"


def threshold(projections: int, half_width: float, confidence: float) -> int:
    """The largest number of collisions that a vector within the radius reaches with this probability."""
    p = 2 * NormalDist().cdf(half_width) - 1
    miss, term, n = 0.0, (1 - p) ** projections, 0
    while miss + term <= 1 - confidence:
        miss += term
        n += 1
        term *= (projections - n + 1) / n * p / (1 - p)
    return n


def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((dim, projections))


class Arrays:
    """The sorted arrays of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray):
        self.ids, self.vectors, self.lines = ids, vectors, lines
        p = (vectors.astype(np.float64) @ lines).T
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, 1)
        self.place = np.empty(p.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.uint16)[None, :], 1)
        self.scale = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64).mean())) if len(ids) else 1.0

    def windows(self, projected: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in the sorted array of each direction: queries x directions."""
        low, high = (np.empty(projected.shape, np.int64) for _ in range(2))
        for i, s in enumerate(self.sorted):
            low[:, i] = np.searchsorted(s, projected[:, i] - reach, "left")
            high[:, i] = np.searchsorted(s, projected[:, i] + reach, "right")
        return low, high

    def colliding(self, low: np.ndarray, high: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) in at least ``need`` windows; a vector lies in a window if its place in the sorted array does."""
        shape = min(BATCH, len(low)), len(self.ids)
        gap, mask = np.empty(shape, np.uint16), np.empty(shape, bool)
        found = []
        for g in range(0, len(low), BATCH):
            n = min(BATCH, len(low) - g)
            count = np.zeros((n, shape[1]), np.uint8 if low.shape[1] < 256 else np.uint16)
            start, width = low[g : g + n].astype(np.uint16), (high[g : g + n] - low[g : g + n]).astype(np.uint16)
            for i, place in enumerate(self.place):
                np.subtract(place[None, :], start[:, i, None], out=gap[:n])
                np.less(gap[:n], width[:, i, None], out=mask[:n])
                np.add(count, mask[:n].view(np.uint8), out=count)
            q, v = np.nonzero(count >= need)
            found.append((q + g, v))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


class Search:
    """The k best of some queries, over one block of vectors after another. verified: how many distances were computed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, limit: np.ndarray, lines: np.ndarray, k: int, half_width: float, need: int):
        self.ids, self.vectors, self.limit = ids, vectors.astype(np.float64), limit.copy()
        self.projected, self.k, self.half_width, self.need = self.vectors @ lines, k, half_width, need
        none = np.zeros(0)
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none.astype(np.int64), none, none)] * len(ids)  # vector, distance, radius
        self.verified, self._start = 0, 0.0

    def visit(self, block: Arrays) -> None:
        """Widens the windows of all queries in a block until they reach the bound, or k vectors lie within the radius."""
        n = len(block.ids)
        active = np.arange(len(self.ids))
        step = 0
        begin = self._start or block.scale / 4
        while len(active) and n:
            bounded = np.isfinite(self.limit[active])
            radius = np.where(bounded, self.limit[active], begin * STEP**step)
            low, high = block.windows(self.projected[active], self.half_width * radius * (1 + 1e-9) + 1e-12)
            able = ((high > low).sum(1) >= self.need) & (n > 0)
            whole = (high - low).min(1) == n
            q, v = block.colliding(low[able], high[able], self.need)
            q = np.flatnonzero(able)[q]
            self._verify(block, active, np.where(whole & ~bounded, np.inf, radius), q, v, ~bounded)
            done = bounded | whole | (self.limit[active] <= radius)
            if (done & ~bounded).any():
                self._start = begin * STEP ** (step - 1)
            active = active[~done]
            step += 1

    def _verify(self, block: Arrays, active: np.ndarray, radius: np.ndarray, q: np.ndarray, v: np.ndarray, trial: np.ndarray) -> None:
        """Computes the distances of what collides, and keeps the k best within the radius; a trial that finds fewer leaves no trace."""
        other = block.ids[v] != self.ids[active[q]]
        q, v = q[other], v[other]
        self.verified += len(q)
        d = np.sqrt(((block.vectors[v].astype(np.float64) - self.vectors[active[q]]) ** 2).sum(1))
        near = d <= radius[q]
        q, v, d = q[near], v[near], d[near]
        gaps = np.abs(block.vectors[v].astype(np.float64) @ block.lines - self.projected[active[q]])
        reach = np.partition(gaps, self.need - 1, axis=1)[:, self.need - 1] / self.half_width if len(q) else np.zeros(0)
        r = np.maximum(d, reach)
        near = r <= radius[q]
        q, v, d, r = q[near], v[near], d[near], r[near]
        cut = np.searchsorted(q, np.arange(len(active) + 1))
        for i in range(len(active)):
            a, b = cut[i], cut[i + 1]
            j = active[i]
            old = self.best[j]
            if trial[i] and np.isfinite(radius[i]) and (b - a) + len(old[0]) < self.k:
                continue
            if a == b:
                continue
            ids, dist, rad = np.concatenate([old[0], block.ids[v[a:b]]]), np.concatenate([old[1], d[a:b]]), np.concatenate([old[2], r[a:b]])
            o = np.lexsort((ids, dist, rad))[: self.k]
            if trial[i] and np.isfinite(radius[i]) and rad[o[-1]] > radius[i]:
                continue
            self.best[j] = ids[o], dist[o], rad[o]
            if len(o) == self.k:
                self.limit[j] = rad[o[-1]]


def _good(vectors: DataFrame) -> DataFrame:
    rows = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select(integer_ids(rows, "vec_id").alias("vec_id"), "v").dropDuplicates(["vec_id", "v"]).withColumns({"dim": F.size("v"), "mark": F.xxhash64("v")})


def neighbors(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, confidence: float = CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """The k nearest of ``vectors`` for each row of ``queries`` (by default every vector); both have vec_id and embedding."""
    spark = vectors.sparkSession
    ship(spark)
    need = threshold(projections, half_width, confidence)
    rows = checkpoint(_good(vectors))
    asked = rows if queries is None else _good(queries)
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0)) * 4).first()
    groups = max(1, -(-size // GROUP_BYTES), min(4 * spark.sparkContext.defaultParallelism, -(-total // 512)))
    some: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", "mark"), "vec_id", "mark").limit(sample).collect():
        some.setdefault(r.dim, []).append((r.vec_id, r.v))
    fitted = {dim: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.float32)) for dim, x in some.items()}
    axis = {dim: np.linalg.svd(v - v.mean(0), full_matrices=False)[2][0].astype(np.float64) for dim, (_, v) in fitted.items()}

    def matrix(batch: pa.RecordBatch, which: np.ndarray, dim: int) -> np.ndarray:
        return batch.column("v").take(pa.array(which)).flatten().to_numpy().astype(np.float32, copy=False).reshape(-1, dim)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                x = matrix(batch, which, dim)
                own = batch.take(pa.array(which))
                p = x.astype(np.float64) @ axis[dim] if dim in axis else x[:, 0].astype(np.float64)
                yield pa.RecordBatch.from_arrays([own.column("dim"), own.column("vec_id"), own.column("mark"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(p)], names=["dim", "vec_id", "mark", "v", "p"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table).sort_by([(c, "ascending") for c in ("dim", "p", "vec_id", "mark")])
        group, dims = TaskContext.get().partitionId(), table.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = table.filter(pa.array(dims == dim))
            for a in range(0, own.num_rows, BLOCK):
                part = own.slice(a, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([0], pa.int32()), pa.array([dim], pa.int32()), pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([b"".join(part.column("v").to_pylist())], pa.binary()), pa.array([b""], pa.binary())], names=["grp", "kind", "dim", "ids", "v", "extra"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Arrays] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                lines = directions(dim, projections)
                if dim in fitted and dim not in held:
                    held[dim] = Arrays(*fitted[dim], lines)
                which = np.flatnonzero(dims == dim)
                for a in range(0, len(which), QUERIES):
                    part = which[a : a + QUERIES]
                    own = batch.take(pa.array(part))
                    ids, x = own.column("vec_id").to_numpy(), matrix(batch, part, dim)
                    search = Search(ids, x, np.full(len(ids), np.inf), lines, k, half_width, need)
                    if dim in held:
                        search.visit(held[dim])
                    extra = search.limit.tobytes() + own.column("mark").to_numpy().tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([dim], pa.int32()), *[pa.array([b], pa.binary()) for b in (ids.tobytes(), x.tobytes(), extra)]], names=["kind", "dim", "ids", "v", "extra"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, lines = -1, {}, {}
        for batch in batches:
            for grp, kind, dim, ids, v, extra in zip(*(batch.column(c).to_pylist() for c in ("grp", "kind", "dim", "ids", "v", "extra"))):
                if grp != group:
                    group, held = grp, {}
                if dim not in lines:
                    lines[dim] = directions(dim, projections)
                own, x = np.frombuffer(ids, np.int64), np.frombuffer(v, np.float32).reshape(-1, dim)
                if kind == 0:
                    held.setdefault(dim, []).append(Arrays(own, x, lines[dim]))
                    continue
                n = len(own)
                search = Search(own, x, np.frombuffer(extra[: 8 * n], np.float64), lines[dim], k, half_width, need)
                for block in held.get(dim, []):
                    search.visit(block)
                at = np.repeat(np.arange(n), [len(b[0]) for b in search.best])
                parts = [np.concatenate(p) for p in zip(*search.best)]
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.frombuffer(extra[8 * n :], np.int64)[at]), *map(pa.array, parts)], names=["vec_id", "mark", "neighbor", "distance", "radius"])

    blocks = rows.mapInArrow(project, "dim int, vec_id bigint, mark bigint, v binary, p double").repartitionByRange(groups, "dim", "p", "vec_id").mapInArrow(pack, _ROW)
    chunks = asked.select("dim", "vec_id", "mark", "v").repartition(int(groups)).mapInArrow(bound, "kind int, dim int, ids binary, v binary, extra binary")
    chunks = chunks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(int(groups) - 1))))
    visits = blocks.unionByName(chunks).repartition(int(groups), "grp").sortWithinPartitions("grp", "kind", "dim")
    one = Window.partitionBy("vec_id", "mark")
    best = F.row_number().over(one.orderBy("radius", "distance", "neighbor"))
    found = visits.mapInArrow(find, _FOUND).withColumn("_place", best).where(F.col("_place") <= k)
    found = found.withColumn("rank", F.row_number().over(one.orderBy("distance", "neighbor"))).select("vec_id", "rank", "neighbor", F.round("distance", 6).alias("distance"))
    return named_ids(found, vectors if queries is None else vectors.select("vec_id").unionByName(queries.select("vec_id")), "vec_id", ["vec_id", "neighbor"])
