"""Exact top-k inner products by best-first search of paged metric nodes.

Metric: with M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and
a query q becomes (q, 0). Then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the nearest
vectors are those with the largest inner products, and the triangle inequality
holds for every bound below.

Index: a bounded sample of vectors are the routing objects; every vector goes
to the nearest one, and a routing object with many vectors is split into nodes
of about ``NODE``. A node's vectors form pages of at most ``PAGE`` around page
pivots. A page stores its pivot, covering radius, the pivot's distance to the
node's routing object, and its members sorted by their distance to the pivot.
Equal vectors are stored once with their ``k + 1`` smallest ids, which is all
that a result can ever hold of them; they are ranked in salted groups first.

Search: queries come in blocks of bounded size, one after another: a block is
broadcast, each task runs all its queries over its pages, and the block's
results are written before the next block starts. A query starts from the k-th
best score among the routing objects, which are data vectors, and visits its
pages by their lower bounds, nearest first. With D the distance of its k-th best
so far, it skips

* a page without computing a distance, if |d(q, parent) - d(pivot, parent)| - radius > D,
* a page whose d(q, pivot) - radius > D, and all pages after it,
* members whose |d(q, pivot) - d(member, pivot)| > D.

Bounds carry a small relative tolerance. Scores are exact integers: while the
largest squared norm is below 2**52 every floating-point product sum is one;
beyond that, whatever comes within the rounding error of a query's k-th best is
summed again in 64-bit integers, and a norm that these can't hold is an error.

Defined results: null vectors and ids, and vectors with null or non-finite
components, take no part; a shorter vector counts as continued with zeros; of
several rows with one id, the least vector counts; ties go to the smaller id;
fewer than k candidates give fewer rows; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, materialize, table

NODE = 4096
PAGE = 256
#: Routing objects: one per NODE vectors, but no more than this.
ROUTES = 256
#: Queries broadcast at once.
QUERY_BLOCK = 32_768
SALTS = 16
SLACK = 1e-9


def scaled(rows: DataFrame, factor: float = 256.0) -> DataFrame:
    """(vec_id, embedding) -> vec_id, v: floor(factor * component) as doubles, of the rows that take part."""
    good = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).where(
        "vec_id IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    good = good.select("vec_id", F.transform("e", lambda x: F.floor(x * factor).cast("double")).alias("v"))
    size = good.agg(F.max(F.size("v"))).first()[0] or 0
    good = good.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v"))).alias("v"))
    return good.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Each vector once, with its ``k + 1`` smallest ids."""
    keyed = vectors.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    part = Window.partitionBy("h", "v", "salt").orderBy("vec_id")
    few = keyed.withColumn("i", F.row_number().over(part)).where(F.col("i") <= k + 1)
    return few.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))  # at most SALTS * (k + 1) ids each


@dataclass
class Index:
    pages: DataFrame
    routes: np.ndarray  # routing vectors
    route_ids: list[list[int]]
    norm2: float  # M squared


def _extra(v: np.ndarray, norm2: float) -> np.ndarray:
    return np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", v, v), 0.0))


def _distances(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T) + (ea[:, None] - eb[None]) ** 2
    return np.sqrt(np.maximum(d2, 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def build(spark: SparkSession, vectors: DataFrame, k: int, held: Scratch) -> Index | None:
    once = held.keep(distinct_vectors(vectors, k), "vectors")
    n = once.count()
    if not n:
        return None
    norm2 = once.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if norm2 >= 2.0**62:
        raise ValueError("inner products of these vectors don't fit in 64 bits")
    routes = once.orderBy("h", "v").limit(min(ROUTES, max(1, -(-n // NODE)), n)).select("v", "ids").collect()  # at most ROUTES rows
    at = np.asarray([r["v"] for r in routes], dtype=np.float64).reshape(len(routes), -1)
    shared = spark.sparkContext.broadcast((at, _extra(at, norm2)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, e = shared.value
        for b in batches:
            v = _matrix(b.column(0))
            cell = _distances(v, _extra(v, norm2), r, e).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["v", "ids", "cell"])

    placed = held.keep(once.select("v", "ids").mapInArrow(assign, "v array<double>, ids array<bigint>, cell int"), "cells")
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most ROUTES rows
    parts = F.create_map(*[F.lit(x) for c, m in sizes.items() for x in (c, -(-m // NODE))])
    nodes = placed.withColumn("part", F.pmod(F.xxhash64("v"), parts[F.col("cell")]).cast("int"))

    def pages(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, e = shared.value
        v = np.stack(pdf["v"].to_numpy()) if r.shape[1] else np.zeros((len(pdf), 0))
        ids = pdf["ids"].tolist()
        ev = _extra(v, norm2)
        up, eup = r[key[0]][None], e[key[0]][None]
        # page pivots: each the vector farthest from those chosen before
        chosen = [int(_distances(v, ev, up, eup)[:, 0].argmin())]
        near = _distances(v, ev, v[chosen], ev[chosen])[:, 0]
        while len(chosen) < -(-len(v) // PAGE) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _distances(v, ev, v[chosen[-1:]], ev[chosen[-1:]])[:, 0])
        d = _distances(v, ev, v[chosen], ev[chosen])
        own = d.argmin(axis=1)
        out = []
        for p, c in enumerate(chosen):
            members = np.flatnonzero(own == p)
            members = members[d[members, p].argsort(kind="stable")]
            for a in range(0, len(members), PAGE):
                m = members[a : a + PAGE]
                out.append(
                    {
                        "cell": int(key[0]), "pivot": v[c].tolist(), "parent": float(_distances(v[c][None], ev[c : c + 1], up, eup)[0, 0]), "radius": float(d[m, p].max()),
                        "members": v[m].ravel().tolist(), "distances": d[m, p].tolist(), "ids": [int(x) for i in m for x in ids[i]], "of": [j for j, i in enumerate(m) for _ in ids[i]],
                    }
                )
        return pd.DataFrame(out)

    index = nodes.groupBy("cell", "part").applyInPandas(
        pages, "cell int, pivot array<double>, parent double, radius double, members array<double>, distances array<double>, ids array<bigint>, of array<int>"
    )
    return Index(held.keep(index, "pages"), at, [list(r["ids"]) for r in routes], norm2)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers."""
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def _error(norm2: float, size: int) -> float:
    """By how much a floating-point product sum can miss, 0 while all are exact."""
    return 0.0 if norm2 < 2.0**52 else norm2 * 2.0**-51 * max(size, 1)


class _Best:
    """The k best (score, id) of each query, and the scores a newcomer must reach."""

    def __init__(self, queries: np.ndarray, floor: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.floor = floor.copy()  # as floating-point numbers, so up to their rounding
        self.rows = np.zeros((0, 3), dtype=np.int64)  # query number, score, id

    def add(self, rows: np.ndarray) -> None:
        rows = rows[rows[:, 2] != self.queries[rows[:, 0]]]
        if not len(rows):
            return
        rows = np.concatenate([self.rows, rows])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        nth = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        rows, nth = rows[nth < self.k], nth[nth < self.k]
        last = nth == self.k - 1
        self.floor[rows[last, 0]] = np.maximum(self.floor[rows[last, 0]], rows[last, 1])
        self.rows = rows


def _search_pages(q: np.ndarray, best: _Best, d_routes: np.ndarray, batch: pa.RecordBatch, norm2: float, stats: dict) -> None:
    """Best-first over the pages of one batch, all queries together."""
    q2 = np.einsum("ij,ij->i", q, q)
    error = _error(norm2, q.shape[1])
    cell = batch.column("cell").to_numpy()
    pivot = _matrix(batch.column("pivot"))
    parent, radius = batch.column("parent").to_numpy(), batch.column("radius").to_numpy()

    def reach() -> np.ndarray:
        """Distance of the k-th best of each query."""
        d = np.sqrt(np.maximum(q2 + norm2 - 2.0 * (best.floor - error), 0.0))
        return np.where(np.isfinite(best.floor), d * (1 + SLACK) + 1e-6 * np.sqrt(norm2 + 1), np.inf)

    # the parent bound costs no distance; a pivot's distance is computed where it fails to decide
    lower = np.abs(d_routes[:, cell] - parent) - radius
    asked = lower <= reach()[:, None]
    d_pivot = np.full(lower.shape, np.inf)
    for p in np.flatnonzero(asked.any(axis=0)):
        some = np.flatnonzero(asked[:, p])
        d2 = q2[some] + norm2 - 2 * (q[some] @ pivot[p])
        d_pivot[some, p] = np.sqrt(np.maximum(d2, 0))
    stats["pivots"] = stats.get("pivots", 0) + int(asked.sum())
    bound = np.maximum(d_pivot - radius, 0)
    order = bound.argsort(axis=1, kind="stable")
    alive = np.arange(len(q))
    for turn in range(len(cell)):  # every query's turn-th nearest page
        limit = reach()
        page = order[alive, turn]
        alive = alive[bound[alive, page] <= limit[alive]]
        if not len(alive):
            return
        page = order[alive, turn]
        found = []
        for p in np.unique(page):
            mine = alive[page == p]
            members = np.asarray(batch.column("members")[p].values).reshape(-1, q.shape[1])
            distances = np.asarray(batch.column("distances")[p].values)
            # members within reach lie in one run of the sorted distances
            lo = np.searchsorted(distances, (d_pivot[mine, p] - limit[mine]).min())
            hi = np.searchsorted(distances, (d_pivot[mine, p] + limit[mine]).max(), side="right")
            stats["members"] = stats.get("members", 0) + len(mine) * (hi - lo)
            if lo >= hi:
                continue
            score = q[mine] @ members[lo:hi].T
            a, b = np.nonzero(score >= best.floor[mine][:, None] - error)
            if not len(a):
                continue
            of, ids = np.asarray(batch.column("of")[p].values), np.asarray(batch.column("ids")[p].values)
            first = np.searchsorted(of, np.arange(len(distances)))
            many = np.append(first, len(of))[1:] - first
            b = b + lo
            times = many[b]
            at = np.repeat(first[b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            exact = score[a, b - lo].astype(np.int64) if not error else _exact(q[mine[a]], members[b])
            found.append(np.column_stack([np.repeat(mine[a], times), np.repeat(exact, times), ids[at]]))
        if found:
            best.add(np.concatenate(found))


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, held: Scratch) -> DataFrame:
    """(vec_id, v) queries -> query_id, vec_id, score of the k best of each and of each task's pages."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    norm2, path = index.norm2, held.folder("found")
    schema = "query_id long, vec_id long, score long"
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()  # about QUERY_BLOCK rows
        ids = rows["vec_id"].to_numpy()
        q = _matrix(rows["v"].combine_chunks()) if len(ids) else np.zeros((0, index.routes.shape[1]))
        shared = spark.sparkContext.broadcast((ids, q, index.routes, index.route_ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, routes, route_ids = shared.value
            if not len(ids):
                return
            score = q @ routes.T
            first = _Best(ids, np.full(len(q), -np.inf), k)
            for r, own in enumerate(route_ids):
                exact = _exact(q, np.broadcast_to(routes[r], q.shape))
                first.add(np.column_stack([np.repeat(np.arange(len(q)), len(own)), np.repeat(exact, len(own)), np.tile(own, len(q))]))
            q2 = np.einsum("ij,ij->i", q, q)
            d_routes = np.sqrt(np.maximum(q2[:, None] + norm2 - 2 * score, 0))
            best = _Best(ids, first.floor, k)
            for batch in batches:
                for a in range(0, batch.num_rows, 64):
                    _search_pages(q, best, d_routes, batch.slice(a, 64), norm2, {})
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[best.rows[:, 0]]), pa.array(best.rows[:, 2]), pa.array(best.rows[:, 1])], names=["query_id", "vec_id", "score"]
            )

        index.pages.mapInArrow(run, schema).write.parquet(f"{path}/block={block}")
        shared.destroy()
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block")


def top_k(spark: SparkSession, rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose id is divisible by ``every``."""
    with Scratch(spark) as held:
        vectors = held.keep(scaled(rows), "scaled")
        index = build(spark, vectors, k, held)
        if index is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        found = search(spark, index, vectors.where(F.col("vec_id") % every == 0), k, held)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return materialize(spark, ranked, "nearest")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
