"""Periodic runs of words, found by probing a harmonic grid.

A run is a stretch of words with smallest period q, of length >= max(LEAST, 2q), that no neighbouring word extends with
that period. For each period p up to half of a text the words at grid points jp and (j+1)p are held against each other:
n/2 + n/3 + ... probes, n log n in all. A run of period p covers two neighbouring grid points, so none is missed. A
grid point whose words are equal survives; from it the stretch of i with word[i] = word[i+p] is extended by comparing
chunks of the arrays, from grid point to grid point and then to both sides of a chain of them.

Periods go up in blocks [2^b, 2^(b+1)): no multiple of a period is in its own block, so before a block all runs are
known whose period could divide one of its periods. Grid points within a run of period q are skipped for multiples of
q: there the stretch is that run again (it can't reach beyond, or the run itself would). What is left has its smallest
period, by Fine and Wilf's theorem. A text of one word repeated thus costs its probes, not a comparison of each pair.

Texts are cut into words and numbered within an Arrow batch (numbers stand for equal words exactly, nothing is hashed);
many short texts or one long one are worked on at a time, with a mark between texts that is equal to nothing.

Edge cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows are answered each;
null ids are kept; other columns are ignored; an empty table gives an empty result. A word is dropped from the
collapsed text if any run holds it behind that run's first q words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import WORD, slices, table, tidied

#: Shortest run; bytes of text and grid points that are worked on at once.
LEAST, TEXT_BYTES, PROBES = 12, 3_000_000, 1_000_000
#: Words compared at once when a stretch is extended: at first, and at most.
CHUNK, MOST_CHUNK = 8, 4096
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(texts):
    """Words of an Arrow string array: one flat binary array of them, and how many each text has."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)))
    first = inside.copy()  # a word's first byte: after white space, or where a text begins
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, ends))
    kept = np.concatenate([[0], np.cumsum(inside)])  # where a byte goes once white space is away
    at = np.concatenate([kept[starts], kept[-1:]]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])])
    return flat, counts


def stretch(ids, at, p, side: int, most):
    """How many i next to `at` on one side have ids[i] = ids[i + p], without a gap, `most` at most."""
    import numpy as np

    found, last = np.zeros(len(at), np.int64), len(ids) - 1
    active, width = np.flatnonzero(most > 0), CHUNK
    while len(active):
        again = []
        for part in np.array_split(active, 1 + len(active) * width // PROBES):
            i = (at[part] + side * (1 + found[part]))[:, None] + side * np.arange(width)
            equal = ids[np.clip(i, 0, last)] == ids[np.clip(i + p[part][:, None], 0, last)]
            whole = equal.all(1)
            found[part] += np.where(whole, width, equal.argmin(1))
            again.append(part[whole & (found[part] < most[part])])
        active, width = np.concatenate(again), min(2 * width, MOST_CHUNK)
    return np.minimum(found, most)


def block_runs(ids, off, n, low: int, known):
    """Runs with periods low..2 * low - 1 as rows (text, start, length, period), given all those of smaller periods."""
    import numpy as np

    docs = np.flatnonzero(n >= 2 * low)
    each = np.minimum(low, n[docs] // 2 - low + 1)  # periods of a text in this block
    first_pair = np.cumsum(each) - each
    doc = np.repeat(docs, each)
    p = low + np.arange(len(doc)) - np.repeat(first_pair, each)
    probes = (n[doc] - 1) // p
    upto = np.concatenate([[0], np.cumsum(probes)])
    pair_of = np.full(len(n), -1)
    pair_of[docs] = first_pair
    inside = known[(known[:, 2] > low) & (pair_of[known[:, 0]] >= 0)] if len(known) else known
    # Where a known run's grid points of one multiple of its period begin and end, as (pair, j) numbered through.
    skip_from, skip_to = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(inside):
        k0, k1 = -(-low // inside[:, 3]), np.minimum(2 * low - 1, inside[:, 2] - 1) // inside[:, 3]
        times = np.maximum(0, k1 - k0 + 1)
        run = np.repeat(np.arange(len(inside)), times)
        d, s, length, q = inside[run].T
        m = q * (k0[run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times))
        fits = m <= n[d] // 2
        d, s, length, m = d[fits], s[fits], length[fits], m[fits]
        j0, j1 = -(-s // m), (s + length - 1) // m - 1
        pair = pair_of[d] + m - low
        some = j1 >= j0
        skip_from, skip_to = (upto[pair] + j0)[some], (upto[pair] + j1 + 1)[some]
    found, start = [], 0
    while start < len(p):  # whole pairs, so many that their grid points can be held
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + PROBES, side="right")) - 1)
        own, total = np.repeat(np.arange(start, end), probes[start:end]), int(upto[end] - upto[start])
        at = off[doc[own]] + (np.arange(upto[start], upto[end]) - upto[own]) * p[own]
        alive = ids[at] == ids[at + p[own]]
        if len(skip_from):
            mark = np.zeros(total + 1, np.int64)
            here = (skip_from < upto[end]) & (skip_to > upto[start])
            np.add.at(mark, np.maximum(skip_from[here] - upto[start], 0), 1)
            np.add.at(mark, np.minimum(skip_to[here] - upto[start], total), -1)
            alive &= np.cumsum(mark)[:-1] == 0
        at, own = at[alive], own[alive]
        # The stretch of a run has six members or more, so three on one side of each grid point in it.
        last = len(ids) - 1
        near = np.zeros(len(at), bool)
        for side in (1, -1):
            i = at[:, None] + side * np.arange(1, 4)
            near |= (ids[np.clip(i, 0, last)] == ids[np.clip(i + p[own][:, None], 0, last)]).all(1)
        at, own = at[near], own[near]
        if len(at):
            per = p[own]
            right = stretch(ids, at, per, 1, per - 1)
            joins = (own[1:] == own[:-1]) & (at[1:] == at[:-1] + per[:-1]) & (right[:-1] == per[:-1] - 1)
            head, tail = np.flatnonzero(np.concatenate([[True], ~joins])), np.flatnonzero(np.concatenate([~joins, [True]]))
            left = stretch(ids, at[head], per[head], -1, per[head] - 1)
            begin, size = at[head] - left, at[tail] + 1 + right[tail] - at[head] + left
            q, d = per[head], doc[own[head]]
            good = (size >= q) & (size + q >= LEAST)
            found.append(np.column_stack([d, begin - off[d], size + q, q])[good])
        start = end
    return np.concatenate([np.empty((0, 4), np.int64), *found])


def runs_of(numbers, counts):
    """All runs of texts given as word numbers one after the other: rows (text, start, length, period) in that order."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    m = len(counts)
    # A mark before the first text, between texts and behind the last one; no two marks are equal.
    off = np.cumsum(counts) - counts + 1 + np.arange(m)
    ids = np.empty(len(numbers) + m + 1, np.int64)
    marks = np.concatenate([[0], off + counts])
    ids[marks] = -1 - np.arange(m + 1)
    rest = np.ones(len(ids), bool)
    rest[marks] = False
    ids[rest] = numbers
    known, low = np.empty((0, 4), np.int64), 1
    longest = int(counts.max(initial=0))
    while 2 * low <= longest and longest >= LEAST:
        known, low = np.concatenate([known, block_runs(ids, off, counts, low, known)]), 2 * low
    return known[np.lexsort((known[:, 3], known[:, 1], known[:, 0]))]


def dropped(runs, counts):
    """Which words, numbered through, some run holds behind its first period."""
    import numpy as np

    off = np.cumsum(counts) - counts
    mark = np.zeros(int(np.sum(counts)) + 1, np.int64)
    np.add.at(mark, off[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(mark, off[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(mark)[:-1] > 0


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the text's words without repeats, one space apart)."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                words, counts = words_of(batch["text"])
                numbers = words.dictionary_encode().indices.to_numpy()
                runs = runs_of(numbers, counts)
                stay = ~dropped(runs, counts)
                kept = np.add.reduceat(np.append(stay, False), np.minimum(np.cumsum(counts) - counts, len(stay)), dtype=np.int64) * (counts > 0)
                ends = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int64))
                lists = pa.LargeListArray.from_arrays(ends, words.filter(pa.array(stay)).cast(pa.large_string()))
                per_text = np.bincount(runs[:, 0], minlength=len(counts))
                fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
                run_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)), fields)
                joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts.astype(np.int64)), run_lists, joined.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text, but in every tenth document by crc32 of its id the words from some place on repeat a period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # The words are bound to a lambda's variable, or they would be extracted again for each word.
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when((h % 10 == 0) & F.coalesce(text.rlike(WORD), F.lit(False)), F.get(F.transform(words, planted), 0)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """A row of figures for each row of find_runs()."""
    key = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", F.array_max(key))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(find_runs(docs.select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))))
