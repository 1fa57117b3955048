"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become integers, floor(64 * x). The index deals the candidates into blocks of about BLOCK_ROWS rows by hash
of the id; a block's postings (row, dimension, value) are kept in segments by quantised impact, |value|, highest
level first, with every row's id. Queries are dealt into blocks too and each pair of blocks is one group: the stated
queries against all rows, in blocks of bounded size.

Within a pair the segments are processed in descending impact. Each adds its part to the queries' partial scores;
what a row has left is bounded by |query| * |rest of the row| (Cauchy-Schwarz), so partial score +- that bound holds
the exact score. A pair stops when the rows whose upper bound reaches the k-th best lower bound are few, or the
segments are at an end; all these possible members, ties included, are then rescored with whole integer vectors.
The k best of each block are merged per query.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors
shorter than the longest count as 0 beyond their end; the query's own id is no candidate for it, a row that repeats
another candidate's id is one more candidate; a repeated query row is answered once; fewer candidates than k give
fewer rows; an empty table gives an empty result; extra columns are ignored. A component of 2^62 or more once
scaled, and a score beyond a 64-bit integer, fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import table

K, EVERY, SCALE = 20, 20, 64
BLOCK_ROWS, QUERY_ROWS, LEVELS = 4096, 1024, 6


def quantised(vectors: DataFrame, embedding: Column) -> DataFrame:
    """vec_id and v, the floors as longs, of the vectors that take part."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.cast("array<double>").alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.when(F.abs(c * SCALE) < 2.0**62, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("a component is too large to be an integer of 62 bits")))
    return x.filter(sound).select("vec_id", F.transform("x", whole).alias("v"))


def matrix(lists, dims: int):
    """Rows of integers as one array, filled up with zeros."""
    import numpy as np

    out = np.zeros((len(lists), dims), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def index_blocks(candidates: DataFrame, blocks: int, dims: int, levels: int = LEVELS) -> DataFrame:
    """The index: per block a segment (level, rows, dims, values) for each level of impact, and level -1 with the ids."""

    def build(pdf):
        import numpy as np
        import pandas as pd

        c = matrix(pdf["v"], dims)
        rows, at = np.nonzero(c)
        values = c[rows, at]
        impact = np.abs(values)
        step = max(1, -(-int(impact.max(initial=0)) // levels))
        level = np.minimum((impact - 1) // step, levels - 1) if len(impact) else impact
        block, empty = pdf["block"].iloc[0], b""
        out = [(block, -1, pdf["vec_id"].to_numpy(np.int64).tobytes(), empty, empty)]
        for n in range(levels - 1, -1, -1):
            own = np.flatnonzero(level == n)
            own = own[np.argsort(-impact[own], kind="stable")]
            if len(own):
                out.append((block, n, rows[own].astype(np.int32).tobytes(), at[own].astype(np.int32).tobytes(), values[own].tobytes()))
        return pd.DataFrame(out, columns=["block", "level", "posting_rows", "posting_dims", "posting_values"])

    dealt = candidates.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(build, "block int, level int, posting_rows binary, posting_dims binary, posting_values binary")


def search_pair(q, q_ids, segments, c_ids, k: int):
    """(query position, candidate id, score) of each query's k best in a block; segments in descending impact."""
    import numpy as np

    n, dims = len(c_ids), q.shape[1]
    whole = np.zeros((n, dims), np.int64)
    for rows, at, values in segments:
        whole[rows, at] = values
    left = (whole.astype(np.float64) ** 2).sum(1)
    q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    # Single precision is exact while all sums stay below 2^24.
    exact32 = float(np.abs(q).astype(np.float64).sum(1).max(initial=0)) * float(np.abs(whole).max(initial=0)) < 1 << 24
    kind = np.float32 if exact32 else np.float64
    slack = 1e-6 if exact32 else 1e-9
    partial = np.zeros((len(q), n), kind)
    order = np.argsort(c_ids, kind="stable")
    lo, hi = np.searchsorted(c_ids[order], q_ids, "left"), np.searchsorted(c_ids[order], q_ids, "right")
    own = np.array([(i, order[j]) for i in range(len(q)) for j in range(lo[i], hi[i])], np.int64).reshape(-1, 2)
    members = None
    for s, (rows, at, values) in enumerate(segments):
        part = np.zeros((n, dims), kind)
        part[rows, at] = values
        partial += q.astype(kind) @ part.T
        left = np.maximum(left - np.bincount(rows, weights=values.astype(np.float64) ** 2, minlength=n), 0)
        last = s == len(segments) - 1
        # A proof is worth trying once the rest is small beside the spread of the scores.
        if not last and np.median(np.sqrt(left)) * np.median(q_norm) > 0.5 * partial.std():
            continue
        bound = (q_norm[:, None] * np.sqrt(left)[None, :] * (1 + slack)).astype(kind) + kind(0 if last and exact32 else slack) * (np.abs(partial) + 1)
        if last and exact32:
            bound[:] = 0
        lower = partial - bound
        lower[own[:, 0], own[:, 1]] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf, kind)
        possible = partial + bound >= kth[:, None]
        possible[own[:, 0], own[:, 1]] = False
        if last or possible.sum() <= 8 * k * len(q):
            members = possible
            break
    if members is None:  # no segments: all candidates are zero vectors
        members = np.ones((len(q), n), bool)
        members[own[:, 0], own[:, 1]] = False
    at_q, at_c = np.nonzero(members)
    found = []
    for start in range(0, len(at_q), 1 << 20):
        a, b = at_q[start : start + (1 << 20)], at_c[start : start + (1 << 20)]
        peak = int(np.abs(q).max(initial=0)) * int(np.abs(whole).max(initial=0)) * dims
        if peak < 1 << 62:
            found.append(np.einsum("ij,ij->i", q[a], whole[b]))
        else:
            found.append(np.array([sum(x * y for x, y in zip(q[i].tolist(), whole[j].tolist())) for i, j in zip(a, b)], dtype=object))
    score = np.concatenate(found) if found else np.empty(0, np.int64)
    order = np.lexsort((c_ids[at_c], -score, at_q))
    at_q, at_c, score = at_q[order], at_c[order], score[order]
    first = np.searchsorted(at_q, np.arange(len(q)))
    keep = np.arange(len(at_q)) - first[at_q] < k if len(at_q) else np.empty(0, bool)
    return at_q[keep], c_ids[at_c[keep]], score[keep]


def top_k(queries: DataFrame, candidates: DataFrame, n_candidates: int, n_queries: int, dims: int, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates other than itself; both sides as of quantised()."""
    blocks, parts = max(1, -(-n_candidates // block_rows)), max(1, -(-n_queries // query_rows))
    index = index_blocks(candidates, blocks, dims).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = queries.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        right = right.sort_values("level", ascending=False)
        ids = np.frombuffer(right["posting_rows"].iloc[-1], np.int64)
        segments = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(c, np.int64)) for a, b, c in zip(right["posting_rows"][:-1], right["posting_dims"][:-1], right["posting_values"][:-1])]
        q_ids = left["vec_id"].to_numpy(np.int64)
        at, vec_ids, score = search_pair(matrix(left["v"], dims), q_ids, segments, ids, k)
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": vec_ids, "score": score})

    pairs = dealt.groupBy("part", "block").cogroup(index.groupBy("part", "block")).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), F.col("embedding"))
    asked = vectors.filter(F.col("vec_id") % EVERY == 0)
    n, n_asked, dims = vectors.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % EVERY == 0), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    return top_k(asked, vectors, n, n_asked, dims)


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
