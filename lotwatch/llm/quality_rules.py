"""Quality rules: counted rules that drop a document outright, and a log-likelihood ratio that decides on the rest.

N-grams are single tokens and pairs of neighbours; tokens are runs of ASCII punctuation and runs of anything else
between white space, A-Z in lower case, hashed to BUCKETS buckets. Two multinomials over the buckets are counted: the
trusted target (all documents that a label calls good) and the raw corpus (every document). With raw counts r, target
counts t and f = sum(t) / sum(r), a bucket weighs

    log((t + SMOOTH * f) / (f * (r + SMOOTH))),

so that a bucket hardly seen says little, whatever the sizes. Weights are whole multiples of 2^-20, so sums don't depend
on their order. A document's score is the mean weight of its n-grams (length-normalised, rounded down). Nothing is
drawn at random: a document is kept if its score reaches the cut, and the cut is the one that tells good labels from
bad ones best among documents that pass the counted rules (share of good kept less share of bad kept, in bins of 2^-8;
the lowest of the best), in the middle of the gap between the last bin it leaves out and the first that it keeps.

All counts, scores and the cut cover all documents. Each task counts its texts into one array and gives a row a bucket;
the driver holds BUCKETS weights and a histogram of scores by label. Labels join the texts as a broadcast only up to
FEW_LABELS labels, beyond that in a shuffled join.

Edge cases: null and empty texts have no words, no n-grams, score 0 and fail the rules (fewer than 50 words); null
labels and labels without a document are left out; of several labels of a document the best counts; without a good or
without a bad label nothing but the counted rules decides; repeated rows are judged each; null ids are kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import drop_table, materialize, slices, table, tidied
from lotwatch.llm.periodic_runs import words_of

BUCKETS, SMOOTH, ONE, BIN = 1 << 16, 8, 1 << 20, 1 << 12
#: A token's hash is that of its bytes as digits + 1 to base 257, modulo this prime; a pair's is first * PAIR + second.
PRIME, BASE, PAIR = 2**31 - 1, 257, 65_599
TEXT_BYTES, FEW_LABELS = 3_000_000, 2_000_000
SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS, MOST_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _kinds():
    """By byte: 0 white space, 1 ASCII punctuation, 2 anything else."""
    import numpy as np

    kind = np.full(256, 2, np.int8)
    for low, high in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
        kind[low : high + 1] = 1
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    return kind


def _powers(n: int):
    """BASE^0 .. BASE^(n-1) modulo PRIME."""
    import numpy as np

    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(BASE, len(out), PRIME) % PRIME])
    return out


def bytes_of(texts):
    """All bytes of an Arrow string array, and where each text ends (with a leading 0)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def per_text(flags, ends):
    """How many flags each text has."""
    import numpy as np

    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def ngrams(raw, ends):
    """Buckets of all n-grams, and the text of each: first all tokens, then all pairs."""
    import numpy as np

    kind = _kinds()[raw]
    inside = kind > 0
    first = inside.copy()
    first[1:] &= kind[1:] != kind[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)[inside].astype(np.int64)
    kept = np.cumsum(inside) - 1
    at = kept[starts]
    stop = np.concatenate([at[1:], [len(lower)]])
    exponent = np.repeat(stop, stop - at) - 1 - np.arange(len(lower))
    h = np.add.reduceat((lower + 1) * _powers(int((stop - at).max()))[exponent] % PRIME, at) % PRIME
    text = np.searchsorted(ends, starts, side="right") - 1
    same = text[1:] == text[:-1]
    pairs = (h[:-1] * PAIR + h[1:]) % PRIME
    return np.concatenate([h, pairs[same]]) % BUCKETS, np.concatenate([text, text[1:][same]])


def renumbered(codes):
    """The same classes, numbered from 0 in order of appearance."""
    import numpy as np
    import pyarrow as pa

    return pa.array(codes).dictionary_encode().indices.to_numpy().astype(np.int64)


def rule_counts(texts, raw, ends):
    """The counted rules' figures of each text: an array for each of COUNTS."""
    import numpy as np

    words, n = words_of(texts)
    space = _kinds()[raw] == 0
    chars = per_text(~space & ((raw & 0xC0) != 0x80), ends)
    symbols = per_text(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)), ends)
    whole, dup = raw.tobytes(), np.zeros(len(n), np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    again = np.zeros(len(words), bool)
    text = np.repeat(np.arange(len(n)), n)
    if len(words) > 2:
        number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        each, at = int(number.max()) + 1, np.flatnonzero(text[2:] == text[:-2])
        window = renumbered(number[at] * each + number[at + 1])
        window = renumbered(window * each + number[at + 2])
        window = renumbered(text[at] * (int(window.max(initial=0)) + 1) + window)
        found = at[np.bincount(window)[window] > 1] if len(window) else at
        for k in range(3):
            again[found + k] = True
    word_ends = np.concatenate([[0], np.cumsum(n)])
    return dict(zip(COUNTS, (n.astype(np.int64), chars, symbols, dup, per_text(again, word_ends))))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of those with `trusted` set."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        raw_counts, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                bucket, text = ngrams(*bytes_of(batch["text"]))
                raw_counts += np.bincount(bucket, minlength=BUCKETS)
                good = batch["trusted"].to_numpy(zero_copy_only=False)[text].astype(bool)
                target += np.bincount(bucket[good], minlength=BUCKETS)
        some = np.flatnonzero(raw_counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw_counts[some], target[some])], names=["bucket", "raw", "target"])

    found = docs.select("text", "trusted").mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights_of(counts: list[tuple[int, int, int]]) -> list[int]:
    """Each bucket's weight in units of 1 / ONE; all 0 where nothing is trusted."""
    total, target = sum(r for _, r, _ in counts), sum(t for _, _, t in counts)
    out = [0] * BUCKETS
    if target:
        f = target / total
        for b, r, t in counts:
            out[b] = math.floor(ONE * math.log((t + SMOOTH * f) / (f * (r + SMOOTH))) + 0.5)
    return out


def scored(docs: DataFrame, weights: list[int]) -> DataFrame:
    """doc_id, the counted rules' figures, n_grams and score (in units of 1 / ONE) of every row."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        weight = np.array(weights, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                raw, ends = bytes_of(batch["text"])
                bucket, text = ngrams(raw, ends)
                n, total = np.bincount(text, minlength=len(batch)), np.zeros(len(batch), np.int64)
                np.add.at(total, text, weight[bucket])
                counts = rule_counts(batch["text"], raw, ends)
                columns = {"doc_id": batch["doc_id"], **counts, "n_grams": n.astype(np.int64), "score": total // np.maximum(n, 1)}
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, n_grams bigint, score bigint")


def best_cut(histogram: list[tuple[int, int, int]]) -> int | None:
    """From rows (bin, good, bad): the bin from which on keeping documents tells good from bad best, or None if none does."""
    good, bad = sum(g for _, g, _ in histogram), sum(b for _, _, b in histogram)
    best, cut, left, before = 0, None, [good, bad], None
    for i, g, b in sorted(histogram):
        gain = left[0] * bad - left[1] * good
        if gain > best:
            best, cut = gain, (before + i + 1) // 2
        left, before = [left[0] - g, left[1] - b], i
    return cut


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counted rules' figures, base_failed, n_grams, log_ratio, cut and kept for every row of docs."""
    own = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = materialize(own.select(F.col("doc_id").alias("labelled"), (F.col("quality") > 0).alias("good")), "quality-labels")
    own_few = F.broadcast(own) if own.count() <= FEW_LABELS else own  # about 10 bytes a label, counted
    texts = docs.select("doc_id", "text").join(own_few, F.col("doc_id") == F.col("labelled"), "left")
    counts = ngram_counts(texts.select("text", F.coalesce("good", F.lit(False)).alias("trusted")))
    weights = weights_of([(r["bucket"], r["raw"], r["target"]) for r in counts.toLocalIterator()])  # BUCKETS rows at most

    base_failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = materialize(scored(docs, weights).withColumn("base_failed", base_failed), "quality-scores")
    judged = rows.filter("NOT base_failed").join(own_few, F.col("doc_id") == F.col("labelled"))
    histogram = judged.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    cut = best_cut([(r["bin"], r["good"], r["bad"]) for r in histogram.toLocalIterator()])  # bins of the range of weights
    drop_table(own)
    kept = ~F.col("base_failed") & (F.lit(True) if cut is None else F.col("score") >= cut * BIN)
    return rows.select("doc_id", *COUNTS, "base_failed", "n_grams", (F.col("score") / ONE).alias("log_ratio"), F.lit(None if cut is None else cut * BIN / ONE).cast("double").alias("cut"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
words AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT r, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM d)),
windows AS (SELECT *, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, w, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS again FROM windows),
covered AS (SELECT r, w, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS again FROM twice WINDOW o AS (PARTITION BY r ORDER BY i)),
per_words AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (again) AS n_repeat_words FROM covered GROUP BY r),
lines AS (SELECT r, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
tokens AS MATERIALIZED (SELECT r, unnest(t) AS t, unnest(range(len(t))) AS i FROM (SELECT r, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{{-~]+|[^\x20\x09-\x0D!-/:-@\[-`{{-~]+') AS t FROM d)),
hashes AS (SELECT t, list_reduce(list_prepend(0::BIGINT, list_transform(range(octet_length(encode(t))), lambda k: ('0x' || substr(hex(encode(t)), 2 * k::INT + 1, 2))::BIGINT + 1)), lambda a, b: (a * {BASE} + b) % {PRIME}) AS h FROM (SELECT DISTINCT t FROM tokens)),
hashed AS (SELECT r, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS h1 FROM tokens JOIN hashes USING (t)),
grams AS MATERIALIZED (SELECT r, h % {BUCKETS} AS b FROM hashed UNION ALL SELECT r, (h * {PAIR} + h1) % {PRIME} % {BUCKETS} FROM hashed WHERE h1 IS NOT NULL),
lab AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
counts AS (SELECT b, count(*) AS n, count(*) FILTER (coalesce(good, false)) AS t FROM grams JOIN d USING (r) LEFT JOIN lab USING (doc_id) GROUP BY b),
f AS (SELECT sum(t)::DOUBLE / sum(n)::DOUBLE AS f FROM counts),
weights AS (SELECT b, CASE WHEN f > 0 THEN floor({ONE} * ln((t + {SMOOTH} * f) / (f * (n + {SMOOTH}))) + 0.5)::BIGINT ELSE 0 END AS w FROM counts, f),
totals AS (SELECT r, count(*) AS n, sum(w)::BIGINT AS s FROM grams JOIN weights USING (b) GROUP BY r),
scores AS MATERIALIZED (
  SELECT r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_words, 0) < {FEWEST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * coalesce(n_words, 0) AS base_failed,
    coalesce(n, 0) AS n_grams, coalesce((s - ((s % n) + n) % n) // n, 0) AS score
  FROM d LEFT JOIN per_words USING (r) JOIN lines USING (r) LEFT JOIN totals USING (r)),
bins AS (SELECT floor(score / {BIN}.0)::BIGINT AS bin, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM scores JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY 1),
gains AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS before, sum(g) OVER o * sum(b) OVER () - sum(b) OVER o * sum(g) OVER () AS gain FROM bins WINDOW o AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
best AS (SELECT max(cut) AS cut FROM (SELECT floor((before + bin + 1) / 2.0)::BIGINT * {BIN} AS cut FROM gains WHERE gain > 0 ORDER BY gain DESC, bin LIMIT 1))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, score / {ONE}.0 AS log_ratio, cut / {ONE}.0 AS cut, NOT base_failed AND (cut IS NULL OR score >= cut) AS kept
FROM scores, best
"""
