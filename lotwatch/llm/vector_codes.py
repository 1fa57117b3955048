"""Compression of vectors to codes of a product quantizer, with exact integers and exponion search.

Components become floor(SCALE * x). Vectors are cut into PARTS equal parts; each part position has a codebook of at
most ENTRIES entries, at first those parts of the smallest ids. ROUNDS times every part is assigned to its nearest
entry and each entry becomes the componentwise floor of its parts' mean; an entry without parts stays. A last
assignment gives the codes.

Assignment is an exponion search. For part x with former entry a let u = |x - a|. An entry c nearer than a, or as near,
lies in the ball |c - a| <= 2u; and once an entry at distance v <= u is known, in |c - a| <= u + v, for which
|c - a|^2 <= 2 (u^2 + v^2) suffices and needs no root. So each entry's neighbours are sorted by their distance from it,
and the scan of that list starts at the former entry and stops where the ball ends. Squared distances are exact integers:
in doubles where all of them stay below 2^51 (matrix products are exact then), else in 64-bit or, beyond these, Python
integers. Of equally near entries the lowest index is taken.

Every round reads a table of (id, label, integer components, former code) in the shared folder and writes the next, then
drops the one before. Each task adds up its own parts by entry before anything is shuffled; only the codebooks, ENTRIES
entries whatever the input, pass the driver. Sums are exact: they travel as two halves and meet as decimals.

Edge cases: vectors that are null or hold null or non-finite components are dropped. Fewer rows than ENTRIES give as
many entries; rows of equal ids stand in the order of their components, null ids last; repeated rows are entries each
(the first of equal entries takes all parts). Null labels are one label. An empty table gives an empty result. Vectors
of unequal lengths, or a length that PARTS doesn't divide, a component of 2^62 or more once scaled, and an error beyond
64 bits are errors, not wrong numbers. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import drop_table, materialize, table, tidied

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Neighbours that are looked at in one step, and labels up to which their sums are broadcast.
STEP, FEW_LABELS = 16, 100_000


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the integer components of the vectors that take part."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**62, F.floor(c.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large to be an integer of 62 bits"))))
    return vectors.filter(x.isNotNull() & finite).select("vec_id", "label", whole.alias("v"))


def squares(a, b):
    """Exact squared distances of all rows of a from all rows of b, in a type that holds four times as much."""
    import numpy as np

    most = sum(max((abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) for x in (a, b))
    bound = max(1, a.shape[1]) * most * most
    kind = np.float64 if bound < 2**51 else np.int64 if bound < 2**60 else object
    a, b = a.astype(np.int64).astype(kind), b.astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


class Codebook:
    """Entries of one part position, and each entry's neighbours by distance, itself first."""

    def __init__(self, entries) -> None:
        import numpy as np

        self.entries = np.asarray(entries)
        apart = squares(self.entries, self.entries)
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, 1)
        self.looked_at = 0

    def nearest(self, parts, former):
        """The nearest entry of each part and the squared distance, searched from the former entries."""
        import numpy as np

        best, least = np.array(former, np.int64), np.empty(len(parts), object)
        order = np.argsort(best, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(best[order])) + 1):
            if not len(rows):
                continue
            a = int(best[rows[0]])
            near, apart = self.near[a], self.apart[a]
            own = parts[rows]
            d = squares(own, self.entries[a : a + 1])[:, 0]
            u, low, at = d, d.copy(), np.full(len(rows), a)
            active = np.arange(len(rows))
            for t in range(0, len(near), STEP):
                active = active[apart[t] <= 2 * (u[active] + low[active])]
                if not len(active):
                    break
                some = near[t : t + STEP]
                self.looked_at += len(active) * len(some)
                far = squares(own[active], self.entries[some])
                d = far.min(1)
                i = np.where(far == d[:, None], some, len(near)).min(1)
                better = (d < low[active]) | ((d == low[active]) & (i < at[active]))
                low[active[better]], at[active[better]] = d[better], i[better]
            best[rows], least[rows] = at, low
        return best, least


def vectors_of(column, dims: int):
    """An Arrow list column as a matrix."""
    import numpy as np

    if any(n != dims for n in np.diff(column.offsets.to_numpy()).tolist()):
        raise ValueError(f"vectors have {dims} components; some have another number")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def assigned(rows: DataFrame, books: list, dims: int, with_error: bool = False) -> DataFrame:
    """vec_id, label, v and code (an index for each part position); or vec_id, label, code and error."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        found = [Codebook(b) for b in books]
        size = dims // len(books)
        for batch in batches:
            v = vectors_of(batch["v"], dims)
            former = np.array(batch["code"].to_pylist(), np.int64).reshape(len(v), len(books))
            codes, error = np.empty(former.shape, np.int64), np.zeros(len(v), object)
            for p, book in enumerate(found):
                codes[:, p], least = book.nearest(v[:, p * size : (p + 1) * size], former[:, p])
                error = error + least
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(books)), pa.array(codes.ravel().astype(np.int32)))
            last = pa.array([int(x) for x in error], pa.int64()) if with_error else batch["v"]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], lists, last], names=["vec_id", "label", "code", "error" if with_error else "v"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, {'error bigint' if with_error else 'v array<bigint>'}")


def means(rows: DataFrame, books: list, dims: int) -> list:
    """The codebooks that follow from the rows' codes: each entry the floor of its parts' mean, or what it was."""
    size, parts, entries = dims // len(books), len(books), len(books[0])

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        high, low = np.zeros((2, parts, entries, size), np.int64)
        n = np.zeros((parts, entries), np.int64)
        for batch in batches:
            v = vectors_of(batch["v"], dims).reshape(-1, parts, size)
            codes = np.array(batch["code"].to_pylist(), np.int64).reshape(len(v), parts)
            for p in range(parts):
                np.add.at(high[p], codes[:, p], v[:, p] >> 32)
                np.add.at(low[p], codes[:, p], v[:, p] & 0xFFFFFFFF)
                n[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(n)
        for part in range(size):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, np.full(len(p), part), n[p, e], high[p, e, part], low[p, e, part])], names=["p", "e", "i", "n", "high", "low"])

    added = rows.select("v", "code").mapInArrow(run, "p bigint, e bigint, i bigint, n bigint, high bigint, low bigint")
    total = added.groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low"))
    out = [[list(e) for e in b] for b in books]
    for r in total.toLocalIterator():  # PARTS x ENTRIES entries at most
        out[r["p"]][r["e"]][r["i"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["n"]
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list]:
    """(vec_id, label, code, error) of every vector that takes part, and the codebooks by part position."""
    zero = F.array_repeat(F.lit(0), parts).alias("code")
    rows = materialize(scaled(vectors, scale).select("*", zero), "vector-parts")
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    if not first:
        return rows.select("vec_id", "label", "code", F.lit(0).cast("long").alias("error")), [[] for _ in range(parts)]
    dims = len(first[0])
    if dims % parts or any(len(v) != dims for v in first):
        raise ValueError(f"vectors of {dims} components don't have {parts} equal parts, or lengths differ")
    size = dims // parts
    books = [[v[p * size : (p + 1) * size] for v in first] for p in range(parts)]
    for _ in range(rounds):
        before, rows = rows, materialize(assigned(rows, books, dims), "vector-parts")
        drop_table(before)
        books = means(rows, books, dims)
    codes = materialize(assigned(rows, books, dims, with_error=True), "vector-codes")
    drop_table(rows)
    return codes, books


def digests(codes: DataFrame, books: list) -> DataFrame:
    """A row for each vector: its code in hex digits, its error, its label's error, and the codebooks' digest."""
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels")
    few = sums.count() <= FEW_LABELS
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    sums = sums.withColumnRenamed("label", "own_label")
    joined = codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("own_label")))
    return joined.select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(*compress(table(spark, sf_dir, "embeddings")))


def _oracle() -> str:
    """The same in DuckDB: every distance of every part from every entry, round by round."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, min(list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {ENTRIES} + e) AS m
  FROM parts JOIN c{k} USING (p) GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (
  SELECT p, e, i, sum(w[i]) AS s, count(*) AS n
  FROM (SELECT p, (m % {ENTRIES})::BIGINT AS e, w, unnest(range(1, len(w) + 1)) AS i FROM a{k} JOIN parts USING (r, p)) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (p, e))""")
    return f"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS w FROM base, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, e, w AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM base) USING (r) WHERE e < {ENTRIES}),
{", ".join(steps)},
codes AS (SELECT r, string_agg(format('{{:02x}}', (m % {ENTRIES})::BIGINT), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM codes JOIN base USING (r)
"""


ORACLE = _oracle()
