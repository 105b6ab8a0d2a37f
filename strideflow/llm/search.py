"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors are quantised to whole numbers. A block of vectors is indexed by postings
(dimension, vector, value) in order of falling impact, the value's magnitude, and cut into
segments at quantiles of it. A block of queries goes through one segment after the other;
what a vector may still gain is at most the norm of its postings to come times the norm of
the query over just those. A query stops in a block when the bounds prove that few vectors
of the block can reach the k-th best score known, from this block or those before it; these
possible members are scored again, exactly. Vectors lie in blocks by falling norm, so
whole blocks can be ruled out before the first segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, read_table, staged

SCALE = 64
TOP = 20
EVERY = 20
#: Vectors of a block of the index, and queries that go through it together.
BLOCK = 2048
#: Parts that the index is dealt into for each block of queries; each gives the best k of its own.
LANES = 8
#: Shares of the postings, by falling impact, at which segments end.
QUANTILES = (0.4, 0.6, 0.75, 0.87, 1.0)
#: Possible members, as a multiple of k, that are few enough to be scored one by one.
FEW = 2
WIDTHS = ("<i2", "<i4", "<i8")
PACKED = "n int, dim int, width string, rows binary, ids binary, vals binary"


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id and ints: floor(scale * x) for each component x, as double.

    Vectors that are null or hold a null or non-finite component, and rows without a
    vec_id, take no part. Repeated rows are rows like any other. To be staged before use.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    out = embeddings.where(fine & F.col("vec_id").isNotNull())
    return out.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("ints"))


def packed(part: list[tuple]) -> tuple:
    """(row, vec_id, ints) as a row of PACKED; shorter vectors end in zeros."""
    dim = max(len(v) for _, _, v in part)
    values = np.zeros((len(part), dim), dtype="<i8")
    for i, (_, _, v) in enumerate(part):
        values[i, : len(v)] = v
    top = int(np.abs(values).max(initial=0))
    width = next(w for w in WIDTHS if top <= np.iinfo(w).max)
    rows, ids = (np.array([r[i] for r in part], dtype="<i8").tobytes() for i in (0, 1))
    return len(part), dim, width, rows, ids, values.astype(width).tobytes()


def blocks(vectors: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Blocks of up to ``rows`` vectors (row, vec_id, ints), longer ones first within a partition."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple] = []
        for batch in batches:
            for row in zip(batch["row"], batch["vec_id"], batch["ints"], strict=True):
                kept.append(row)
                if len(kept) == rows:
                    yield pd.DataFrame([packed(kept)], columns=NAMES)
                    kept = []
        if kept:
            yield pd.DataFrame([packed(kept)], columns=NAMES)

    norm = F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return vectors.select("row", "vec_id", "ints").sortWithinPartitions(F.desc(norm), "row").mapInPandas(pack, PACKED)


NAMES = [c.split()[0] for c in PACKED.split(", ")]


def unpacked(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(block.rows, "<i8"), np.frombuffer(block.ids, "<i8"), np.frombuffer(block.vals, block.width).reshape(-1, block.dim).astype(np.int64)


class ImpactIndex:
    """One block's postings by falling impact, in segments."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, quantiles: tuple[float, ...] = QUANTILES):
        self.rows, self.ids, self.values = rows, ids, values
        vec, dim = np.nonzero(values)
        value = values[vec, dim]
        order = np.argsort(-np.abs(value), kind="stable")
        self.vec, self.dim, self.value = vec[order], dim[order], value[order].astype(np.float64)
        self.ends = [int(np.ceil(q * len(order))) for q in quantiles]
        self.square = (values.astype(np.float64) ** 2).sum(axis=1)

    def segments(self, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each segment: its postings and where they are, as tables of vectors by dimensions, and the norms of what is left."""
        left, start = self.square.copy(), 0
        for end in self.ends:
            own = slice(start, end)
            posted, there = np.zeros(self.values.shape, kind), np.zeros(self.values.shape, kind)
            posted[self.vec[own], self.dim[own]] = self.value[own]
            there[self.vec[own], self.dim[own]] = 1.0
            left -= np.bincount(self.vec[own], self.value[own] ** 2, minlength=len(left))
            start = end
            yield posted, there, (np.sqrt(np.maximum(left, 0)) if end < len(self.vec) else np.zeros(len(left))).astype(kind)


class Best:
    """The best k of each query, over the blocks that it has met."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int):
        self.rows, self.ids, self.values, self.k = rows, ids, values, k
        self.floor = np.full(len(rows), -np.inf)  # the k-th best score known
        self.kept: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64))  # query, id, score, row
        self.stops = {"before": 0, "within": 0, "end": 0}  # queries that a block's proof stopped before its first segment, before its last, or not

    def meet(self, index: ImpactIndex) -> None:
        k, n = self.k, len(index.rows)
        dim = index.values.shape[1]
        q = np.pad(self.values, ((0, 0), (0, max(0, dim - self.values.shape[1]))))[:, :dim].astype(np.float64)
        # Sums of products are whole numbers; small ones are exact in either kind.
        most = max((q**2).sum(axis=1).max(initial=0), index.square.max(initial=0))
        kind, error = (np.float32, 1e-5) if most < 1 << 22 else (np.float64, 1e-9)
        narrow, floor = q.astype(kind), self.floor.astype(kind) - kind(error) * np.abs(np.where(np.isfinite(self.floor), self.floor, 0)).astype(kind)
        square = narrow**2
        norms = square.sum(axis=1)
        whole = np.sqrt(norms)[:, None] * np.sqrt(index.square).astype(kind)[None, :]
        slack = kind(error) * whole + kind(1e-3)
        possible = whole + slack >= floor[:, None]
        possible &= index.rows[None, :] != self.rows[:, None]
        score, done = np.zeros((len(q), n), kind), np.zeros((len(q), n), kind)
        open_ = np.flatnonzero(possible.any(axis=1))
        self.stops["before"] += len(q) - len(open_)
        score, done, possible_, slack, floor = (x[open_] for x in (score, done, possible, slack, floor))
        last = len(index.ends) - 1
        for s, (posted, there, left) in enumerate(index.segments(kind)):
            score += narrow[open_] @ posted.T
            done += square[open_] @ there.T
            bound = np.sqrt(np.maximum(norms[open_, None] - done, 0))
            bound *= left
            bound += slack
            if n >= k and not np.isfinite(floor).all():  # nothing is known yet: the block's own k-th least score
                low = np.where(possible_, score - bound, -np.inf)
                floor = np.maximum(floor, np.partition(low, n - k, axis=1)[:, n - k])
            bound += score
            possible_ &= bound >= floor[:, None]
            possible[open_] = possible_
            # Proof: no other vector can be among the best k, so the few that can are scored one by one.
            stop = possible_.sum(axis=1) <= FEW * k
            if s < last and stop.any():
                self.stops["within"] += int(stop.sum())
                open_, score, done, possible_, slack, floor = (x[~stop] for x in (open_, score, done, possible_, slack, floor))
            if not len(open_):
                break
        self.stops["end"] += len(open_)
        self.add(index, *np.nonzero(possible))

    def add(self, index: ImpactIndex, query: np.ndarray, member: np.ndarray) -> None:
        """Score the possible members exactly, and keep the best k of each query."""
        narrow = self.values[:, : index.values.shape[1]]
        other = index.values[:, : self.values.shape[1]]
        top = int(np.abs(narrow).max(initial=0)) * int(np.abs(other).max(initial=0)) * max(1, other.shape[1])
        parts = []
        for at in range(0, len(query), 1 << 16):
            a, b = narrow[query[at : at + (1 << 16)]], other[member[at : at + (1 << 16)]]
            parts.append(np.einsum("ij,ij->i", a, b) if top < 1 << 62 else (a.astype(object) * b.astype(object)).sum(axis=1))
        exact = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        query, ids, score, rows = (np.concatenate(x) for x in zip(self.kept, (query, index.ids[member], exact, index.rows[member]), strict=True))
        if score.dtype == object and len(score) and max(map(abs, score.tolist())) < 1 << 62:
            score = score.astype(np.int64)
        order = np.lexsort((rows, ids, -score, query)) if score.dtype != object else np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], ids[i], rows[i])), dtype=np.int64)
        query = query[order]
        first = np.searchsorted(query, query)
        order, query = order[np.arange(len(query)) - first < self.k], query[np.arange(len(query)) - first < self.k]
        self.kept = (query, ids[order], score[order], rows[order])
        ends = np.searchsorted(query, np.arange(len(self.rows)), side="right")
        full = np.flatnonzero(ends - np.searchsorted(query, np.arange(len(self.rows))) == self.k)
        # Ties of the k-th score may still enter by a smaller id, so only what is lower is ruled out.
        self.floor[full] = self.kept[2][ends[full] - 1].astype(np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, rows: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """The k highest inner products of each query with all vectors but its own row.

    ``vectors`` and ``queries``: row long, vec_id long, ints array<long>, as staged by
    ``quantised``. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id. Repeated rows each take part, as queries and as candidates. Fewer vectors than
    k give as many rows as there are; an empty table gives none. Each block of queries
    meets the blocks of the index as they come, in ``lanes`` tasks that each carry the k-th
    best score along; a task holds one block of either kind.
    """
    spark = vectors.sparkSession
    n_blocks = -(-queries.count() // rows)
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def one_block(own: pd.DataFrame) -> pd.DataFrame:
        block = packed(list(zip(own["row"], own["vec_id"], own["ints"], strict=True)))
        return pd.DataFrame([(int(own["qblock"].iloc[0]), *block)], columns=["qblock", *NAMES])

    numbered = queries.select("row", "vec_id", "ints", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("qblock"))
    asked = numbered.groupBy("qblock").applyInPandas(one_block, f"qblock int, {PACKED}")
    asked = asked.select("qblock", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).cast("long").alias("block"), *NAMES)
    data = staged(blocks(vectors, rows).withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    # Every block of the index goes to every block of queries: the query set is stated, and this is its product with all vectors, in blocks.
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    dealt = data.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("qblock"), lane.alias("lane"), "block", *NAMES)
    met = asked.unionByName(dealt).repartition(max(partitions(spark), min(n_blocks * lanes, 4 * partitions(spark))), "qblock", "lane").sortWithinPartitions("qblock", "lane", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: Best | None = None

        def found() -> Iterator[pd.DataFrame]:
            if best is not None and len(best.kept[0]):
                query, ids, score, own = best.kept
                yield pd.DataFrame({"query_row": best.rows[query], "query_id": best.ids[query], "vec_id": ids, "score": score.astype("int64"), "vec_row": own})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.block < 0:
                    yield from found()
                    best = Best(*unpacked(r), k)
                elif best is not None:
                    best.meet(ImpactIndex(*unpacked(r)))
        yield from found()

    best = met.mapInPandas(search, "query_row long, query_id long, vec_id long, score long, vec_row long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("vec_row"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best neighbours of every vector whose id is divisible by 20."""
    vectors = staged(quantised(read_table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.nr AS query, q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.nr <> c.nr WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id))::INT AS rank FROM s
) WHERE rank <= 20
"""
