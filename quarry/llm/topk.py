"""Exact top-k search by inner product.

Method: blocks of queries and shards of candidates meet as tiles; a tile is one
matrix product with a partial selection per query, and the tiles' lists of a
query are merged in a tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one matrix product.
STEP = 1024
OUT = "query_id long, vec_id long, score long"


def whole_numbers(vector: str | Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as doubles; null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))


def select_tile(queries: np.ndarray, q_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best (query_id, vec_id, score) of each query in one tile; ties go to the smaller vec_id."""
    dim = queries.shape[1]
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(dim, 1)
    exact = top < 2.0**53  # then every partial sum is a whole number that a double holds
    if exact:
        scores = queries @ shard.T
    else:
        as_int = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
        scores = as_int(queries) @ as_int(shard).T if dim else np.zeros((len(queries), len(shard)))
    out = []
    for q, row in zip(q_ids.tolist(), scores):
        fit = np.flatnonzero(ids != q)
        row = row[fit]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k] if exact else sorted(row)[-k]
            chosen = np.flatnonzero(row >= least)
        else:
            chosen = np.arange(len(row))
        got = sorted(((-int(row[i]), int(ids[fit[i]])) for i in chosen))[:k]
        out += [(q, i, max(min(-s, 2**63 - 1), -(2**63))) for s, i in got]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", block: int = 16384, shard: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query, all if there are fewer.

    ``block`` queries and about ``shard`` candidates make a tile, whose size thus
    has a bound; a candidate is sent once for each block of queries. Only id and
    vector are read, other columns are not. Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part. Rows that repeat an id are candidates
    each, never of that id's own query; a query id has one list, for the least
    of its vectors. Only vectors of the query's length are compared; an empty
    vector scores 0. Scores beyond a long stop at its ends.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(vector).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    queries = rows.where("q").groupBy("id").agg(F.min(F.struct("v")).alias("m")).select("id", F.col("m.v").alias("v"))
    n_rows, n_queries = rows.count(), queries.count()
    blocks, shards = -(-n_queries // block) or 1, max(-(-n_rows // shard), 1)
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    left = queries.withColumn("b", deal(blocks, 1)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # rows that repeat an id must not meet in one shard, hence the vector in the hash
    right = rows.select(F.col("id").alias("c_id"), F.col("v").alias("c_v")).withColumn("s", F.pmod(F.xxhash64("c_id", "c_v"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(qs) and len(cs):
            q_dim, c_dim = qs["v"].map(len), cs["c_v"].map(len)
            for dim in sorted(set(q_dim) & set(c_dim)):
                part, own = qs[q_dim == dim], cs[c_dim == dim]
                matrix = lambda x, dim=dim: np.array(x.iloc[:, -1].tolist(), dtype=float).reshape(len(x), dim)
                right, ids = matrix(own), own["c_id"].to_numpy()
                for at in range(0, len(part), STEP):  # one product of STEP queries at a time
                    step = part.iloc[at : at + STEP]
                    out += select_tile(matrix(step), step["id"].to_numpy(), right, ids, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    lists = left.select("b", "s", "id", "v").groupBy("b", "s").cogroup(right.select("b", "s", "c_id", "c_v").groupBy("b", "s")).applyInPandas(lambda key, a, b: tile(a, b).assign(s=key[1]), OUT + ", s int")
    width = 16
    while shards > width:  # merge the lists of 16 shards at a time
        lists = lists.withColumn("s", F.floor(F.col("s") / width).cast("int"))
        best = Window.partitionBy("query_id", "s").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
        shards = -(-shards // width)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
