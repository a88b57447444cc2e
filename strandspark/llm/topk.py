"""Exact top-k search by aggregation without random access.

Rows are dealt into blocks of a bounded size. In a block, every dimension is a list of its rows sorted by
value, read from the end that a query's weight makes larger. After each depth of reading, what a query has seen of a row bounds
its score: unseen components are at most the list's last read value (upper bound) and at least its
smallest value (lower bound). A query stops when at least k rows have lower bounds that no row outside the
candidates reaches with its upper bound; the candidates' scores are then resolved. Blocks' best rows meet in a
final ranking. All bounds are kept in double precision, exact for integers below 2^53.

Rows whose vector is null, empty or holds null or non-finite components take no part, nor do rows without
an id. Vectors of different lengths do not meet. Rows repeated with equal id and vector count once; a query
never meets rows of its own id. Ties: the smaller id. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.common import read_table, stored

K, SCALE, EVERY = 20, 64, 20
BLOCK_ROWS, BLOCK_QUERIES, QUERIES_AT_ONCE = 4096, 4096, 256
#: Shares of the lists' length to which they are read before bounds are compared.
DEPTHS = (0.25, 0.6)


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, codes): floor(scale * x) of each component, for rows that take part."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & ~odd & (F.size(x) > 0)
    codes = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return df.filter(fine).select(F.col("vec_id").cast("long"), codes.alias("codes"))


class SortedLists:
    """A block's rows as one sorted list per dimension."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        order = np.argsort(codes, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(codes))[:, None], axis=0)
        self.sorted = np.take_along_axis(codes, order, axis=0)

    def top(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the rows and scores that no other row can beat or tie; own: rows that are the query's own."""
        n, live = len(self.codes), np.arange(len(queries))
        out: list = [None] * len(queries)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        for share in DEPTHS if n > 4 * k else ():
            if not len(live):
                break
            depth = max(1, int(n * share))
            high, low = self.rank >= n - depth, self.rank < depth  # read from the top, and from the bottom
            p, m = plus[live], minus[live]
            seen = p @ (self.codes * high).T + m @ (self.codes * low).T
            top, bottom, least, most = self.sorted[n - depth], self.sorted[depth - 1], self.sorted[0], self.sorted[-1]
            upper = seen + p @ (top * ~high).T + m @ (bottom * ~low).T
            lower = seen + p @ (least * ~high).T + m @ (most * ~low).T
            lower[own[live]] = -np.inf
            upper[own[live]] = -np.inf
            bar = np.partition(lower, n - k, axis=1)[:, n - k]
            may = upper >= bar[:, None]
            done = may.sum(axis=1) <= max(4 * k, n // 8)
            for i in np.flatnonzero(done):
                rows = np.flatnonzero(may[i])
                out[live[i]] = (rows, self.codes[rows] @ queries[live[i]])
            live = live[~done]
        if len(live):  # the lists read to the end: all scores are resolved
            full = queries[live] @ self.codes.T
            full[own[live]] = -np.inf
            bar = np.partition(full, max(0, n - k), axis=1)[:, max(0, n - k)]
            for i, q in enumerate(live):
                rows = np.flatnonzero((full[i] >= bar[i]) & ~own[q])
                out[q] = (rows, full[i, rows])
        return out


def _search(k: int):
    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            size = rows["codes"].str.len()
            for dims, part in rows.groupby(size):
                ids = part["vec_id"].to_numpy()
                lists = SortedLists(np.stack(part["codes"].to_numpy()).astype(np.float64))
                asked = queries[queries["codes"].str.len() == dims]
                for at in range(0, len(asked), QUERIES_AT_ONCE):
                    q = asked.iloc[at : at + QUERIES_AT_ONCE]
                    own = ids[None, :] == q["vec_id"].to_numpy()[:, None]
                    for query, (at_rows, scores) in zip(q["vec_id"], lists.top(np.stack(q["codes"].to_numpy()).astype(np.float64), k, own), strict=True):
                        best = np.lexsort((ids[at_rows], -scores))[:k]
                        found.append(pd.DataFrame({"query_id": query, "vec_id": ids[at_rows][best], "score": scores[best].astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k rows (vec_id, codes) with the largest inner product with each query (vec_id, codes)."""
    n, asked = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(asked / BLOCK_QUERIES))
    block = lambda name, n: F.pmod(F.xxhash64("vec_id", "codes"), F.lit(n)).cast("int").alias(name)
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("vec_id", "codes", block("r", row_blocks), each("q", query_blocks)).groupBy("r", "q")
    right = queries.select("vec_id", "codes", block("q", query_blocks), each("r", row_blocks)).groupBy("r", "q")
    near = left.cogroup(right).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    best = near.groupBy("query_id").agg(F.slice(F.array_sort(F.array_agg(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(quantised(read_table(spark, sf_dir, "embeddings")).dropDuplicates(), "codes")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) c from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id query_id, r.vec_id, list_dot_product(q.c::double[], r.c::double[])::bigint score
  from v q join v r on q.vec_id <> r.vec_id and len(q.c) = len(r.c) where q.vec_id % 20 = 0),
t as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int "rank", vec_id, score from p)
select query_id, "rank", vec_id, score from t where "rank" <= 20
"""
