"""Exact top-k by inner product: ball trees per shard, searched by branch and bound."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import table

LEAF = 64


class BallTree:
    """Balls over rows of x: each node has a centre, a radius and a slice of the rows' order; children halve their node."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x.astype(np.float64)
        self.order = np.arange(len(x))
        self.lo, self.hi, self.left, self.right, centre, radius = [], [], [], [], [], []
        todo = [(0, len(x), -1, False)]
        while todo:
            lo, hi, parent, is_right = todo.pop()
            me = len(self.lo)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = me
            own = self.x[self.order[lo:hi]]
            c = own.mean(0)
            d = np.sqrt(((own - c) ** 2).sum(1))
            self.lo.append(lo)
            self.hi.append(hi)
            self.left.append(-1)
            self.right.append(-1)
            centre.append(c)
            radius.append(d.max())
            if hi - lo > leaf and radius[-1] > 0:
                far = own[d.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                side = own @ (other - far)
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(side, mid)]
                todo += [(lo, lo + mid, me, False), (lo + mid, hi, me, True)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.rows = self.x[self.order]

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, best: list[tuple[float, int]], k: int, floor: float = -np.inf) -> None:
        """Puts into the heap `best` (score, -id) what beats or ties its k-th and isn't under floor: nodes by falling upper bound
        q.c + |q| r, until none can reach that. best and floor may come from other shards. Sums are exact: integers below 2**53."""
        least = lambda: max(floor, best[0][0]) if len(best) >= k else floor
        bound = self.centre @ q + self.radius * np.sqrt(q @ q)
        bound += 1e-9 * np.abs(bound) + 1e-6  # rounding never hides a row
        todo = [(-bound[0], 0)]
        while todo:
            b, node = heapq.heappop(todo)
            if -b < least():
                return
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= least():
                        heapq.heappush(todo, (-bound[child], child))
                continue
            lo, hi = self.lo[node], self.hi[node]
            scores = self.rows[lo:hi] @ q
            for j in np.flatnonzero(scores >= least()):
                i = int(ids[self.order[lo + j]])
                if i == own:
                    continue
                item = (float(scores[j]), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def whole_numbers(v: Column) -> Column:
    """floor(scale * component) of every component, as doubles; null where the vector takes no part."""
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double")))


class _Held:
    """Rows of ids and vectors as they come from Arrow batches, flat."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.values, self.floors = [], [], [], []

    def add(self, rows: pa.RecordBatch) -> None:
        v = rows["v"]
        self.ids.append(rows["vec_id"].to_numpy())
        self.floors.append(rows["floor"].to_numpy(zero_copy_only=False))
        self.sizes.append(np.diff(v.offsets.to_numpy()))
        self.values.append(v.flatten().to_numpy())

    def by_length(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, vectors as a matrix, and floors, for each length of vectors."""
        if not self.ids:
            return {}
        ids, size, values, floors = (np.concatenate(x) for x in (self.ids, self.sizes, self.values, self.floors))
        begin, out = np.cumsum(size) - size, {}
        for m in np.unique(size).tolist():
            own = np.flatnonzero(size == m)
            out[m] = ids[own], values[begin[own][:, None] + np.arange(m)] if m else np.zeros((len(own), 0)), floors[own]
        return out


def _searched(k: int):
    """Candidates of the queries of each (block, group), whose rows come in the order of shard, queries (shard -1) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, queries, best = None, _Held(), {}, {}

        def search() -> None:
            nonlocal queries, best
            if at and at[2] < 0:
                queries = held.by_length()
                best = {m: [[] for _ in ids] for m, (ids, _, _) in queries.items()}
            else:
                for m, (ids, x, _) in held.by_length().items():
                    if m in queries:
                        tree = BallTree(x)
                        for q, v, floor, heap in zip(queries[m][0].tolist(), queries[m][1], queries[m][2].tolist(), best[m], strict=True):
                            tree.search(v, ids, q, heap, k, floor)

        def found() -> pa.RecordBatch:
            rows = [(q, -i, int(s)) for m, (ids, _, _) in queries.items() for q, b in zip(ids.tolist(), best[m], strict=True) for s, i in b]
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["query_id", "vec_id", "score"])

        for rows in batches:
            keys = np.stack([rows[c].to_numpy() for c in ("block", "group", "shard")])
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), rows.num_rows]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                now = tuple(keys[:, lo].tolist())
                if now != at:
                    search()
                    if at and now[:2] != at[:2]:
                        yield found()
                        queries, best = {}, {}
                    at, held = now, _Held()
                held.add(rows.slice(lo, hi - lo))
        search()
        yield found()

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 2048, query_rows: int = 16384, group_shards: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each query vector the k highest integer inner products with every other row (all, if
    fewer), ties to the smaller vec_id.

    Vectors are dealt by hash into shards of about shard_rows, shards into groups of group_shards at most (8 groups at least), queries into
    blocks of query_rows. A task has one block and one group: it builds a shard's ball tree when the shard's rows have come and
    searches it for the whole block, so it holds one shard and one block, and every query's current k-th score is shared from shard to
    shard. Tasks share it too: one shard is searched for all queries first, and no task looks for less than the k-th score found
    there. Then each query's candidates, k from each of its tasks, are ranked. A vector is sent to a task for each block, and a
    query to a task for each group: the stated query set against all rows, in blocks.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows of null vec_id. Vectors of different
    lengths aren't compared. Rows that share the query's vec_id are its own, and the least of
    their vectors asks; other repeated rows are candidates each. Scores are
    exact while they are under 2**53. An empty table gives no rows. Other columns are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    n, nq = v.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // query_rows))
    fan = -(-shards // max(min(shards, 8), -(-shards // group_shards)))
    groups = -(-shards // fan)
    none = F.lit(float("-inf"))
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    own = v.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v", none.alias("floor"))
    ask = v.where("q").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
    ask = ask.select("block", F.lit(-1).alias("shard"), "vec_id", "v", none.alias("floor"))
    names = ["block", "group", "shard", "vec_id", "v", "floor"]

    def near(rows: DataFrame, asked: DataFrame, m: int) -> DataFrame:
        """Candidates for what is asked among rows of m groups."""
        rows = rows.select(every(blocks, "block"), F.floor(F.col("shard") / fan).cast("int").alias("group"), "shard", "vec_id", "v", "floor")
        rows = rows.unionByName(asked.select("*", every(m, "group")).select(*names))
        return rows.repartition(blocks * m, "block", "group").sortWithinPartitions("block", "group", "shard", "vec_id").mapInArrow(_searched(k), "query_id long, vec_id long, score long")

    if shards > 1:
        least = near(own.where("shard = 0"), ask, 1).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") == k)
        ask = ask.drop("floor").join(least.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").withColumn("floor", F.coalesce("least", none)).drop("least")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near(own, ask, groups).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
