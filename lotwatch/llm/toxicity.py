"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are a document's distinct words (letters only, lower case) and their first 4 to 7 letters, hashed; a
feature's value is log(1 + number of distinct words that carry it). A bounded sample of labelled documents
(TRAIN_ROWS, by hash of the id) selects the features that mark toxic documents and fits

    P(grade > k) = 1 / (1 + exp(theta_k - w.x)),  theta_0 < theta_1 < theta_2,

with one weight vector w for all thresholds. Labels are binary, so the grades of toxic examples are the thirds of
their marked words: 0 clean, 1 mild, 2 strong, 3 severe. (The thresholds between these are thus learnt from the same
marks that the score adds up; what the labels themselves decide is the first.) Every document is scored: expected
severity is the sum of P(grade > k), and a document is toxic if P(grade > 0) is at least one half.

Features are counted and chosen by Spark; of the sample's rows only the chosen features go to the driver, and the
model of at most FEATURES weights goes out to the tasks. Edge cases: null and empty texts have no features and get the
base rate; null labels and labels without a document are left out; of several labels of one document the largest
counts, of several rows of one labelled id the least text; without toxic or without clean examples nothing is toxic;
repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import drop_table, materialize, pipeline_stage, table, tidied

TRAIN_ROWS, FEATURES, DIMS, CACHE = 12_000, 600, 1 << 20, 200_000
STEPS, RIDGE = 600, 5e-5
_not_letters = re.compile(r"[\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself and its prefixes."""
    names = [f"w{word}", *(f"p{word[:n]}" for n in range(4, 8) if len(word) > n)]
    return [zlib.crc32(x.encode()) % DIMS for x in names]


def distinct_words(text: str | None, known: dict[str, str]) -> set[str]:
    """Distinct words of a text; `known` keeps what units between white space reduce to."""
    out = set()
    for unit in set((text or "").lower().split()):
        word = known.get(unit)
        if word is None:
            word = known[unit] = _not_letters.sub("", unit)
        out.add(word)
    out.discard("")
    return out


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(toxic, ids, counts) of at most `rows` labelled documents: hashed features and how many words carry each.

    Where rows share a labelled id, the least text stands for them.
    """
    labelled = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            toxic, ids, counts = [], [], []
            for label, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                own = np.unique(np.array([x for w in distinct_words(text, {}) for x in word_features(w)], dtype=np.int32), return_counts=True)
                toxic.append(int(label > 0)), ids.append(own[0]), counts.append(own[1])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.empty(0, np.int32)]).astype(np.int32))) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), *lists], names=["toxic", "ids", "counts"])

    # The sample is at most `rows` pairs of numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return found.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(run, "toxic int, ids array<int>, counts array<int>")


def chosen_features(sample: DataFrame, n1: int, n0: int) -> list[int]:
    """The at most FEATURES features that mark toxic examples best, by the z value of their log odds; most telling first."""
    df1, df0 = F.col("df1"), F.col("df0")
    counts = sample.select("toxic", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("toxic").alias("df1"), F.sum(1 - F.col("toxic")).alias("df0"))
    odds = F.log((df1 + 0.1) / (n1 + 0.3 - df1)) - F.log((df0 + 0.1) / (n0 + 0.3 - df0))
    z = F.col("odds") / F.sqrt(1 / (df1 + 0.5) + 1 / (df0 + 0.5))
    marked = counts.withColumn("odds", odds).filter((df1 >= 3) & (F.col("odds") >= 1.5)).withColumn("z", z).filter("z > 3")
    return [r["id"] for r in marked.orderBy(F.desc("z"), "id").limit(FEATURES).collect()]


def chosen_rows(sample: DataFrame, chosen: list[int]) -> DataFrame:
    """(toxic, at, counts): of each row only the chosen features, by their place in `chosen`."""
    place = {x: i for i, x in enumerate(chosen)}

    @tidied
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, counts = [], []
            for ids, own in zip(batch["ids"].to_pylist(), batch["counts"].to_pylist()):
                kept = sorted((place[i], n) for i, n in zip(ids, own) if i in place)
                at.append([k for k, _ in kept]), counts.append([n for _, n in kept])
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["toxic", "at", "counts"])

    return sample.mapInArrow(run, "toxic int, at array<int>, counts array<int>")


class Model:
    """Weights by hashed feature, and the thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]) -> None:
        self.weights, self.thresholds = weights, thresholds

    def above(self, x):
        """P(grade > k) for each k, for an array of w.x."""
        import numpy as np

        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - np.asarray(x)[:, None], -60, 60)))


def loss_and_slope(t, w, s, grade):
    """-log P(grade), mean over rows of scores s = w.x, and its slopes in each row's score and in t.

    theta = (t0, t0 + e^t1, t0 + e^t1 + e^t2) stays in order.
    """
    import numpy as np

    theta = np.array([t[0], t[0] + np.exp(t[1]), t[0] + np.exp(t[1]) + np.exp(t[2])])
    edge = np.concatenate([[-60.0], theta, [60.0]])
    lo, hi = edge[grade] - s, edge[grade + 1] - s
    c_lo, c_hi = 1 / (1 + np.exp(-np.clip(lo, -60, 60))), 1 / (1 + np.exp(-np.clip(hi, -60, 60)))
    p = np.maximum(c_hi - c_lo, 1e-12)
    d_lo, d_hi = c_lo * (1 - c_lo) / p, c_hi * (1 - c_hi) / p
    g = np.array([d_lo[grade == k + 1].sum() - d_hi[grade == k].sum() for k in range(3)]) / len(s)
    return -np.log(p).mean(), (d_hi - d_lo) / len(s), np.array([g.sum(), g[1:].sum() * np.exp(t[1]), g[2] * np.exp(t[2])])


def fit(toxic, starts, at, values, chosen: list[int], steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Grade the toxic examples by thirds of their marks, and fit w and theta by Adam over sparse rows.

    Row i has the chosen features at[starts[i] : starts[i + 1]] with these values.
    """
    import numpy as np

    y, n = np.asarray(toxic) > 0, len(toxic)
    row = np.repeat(np.arange(n), np.diff(starts))
    marks = np.bincount(row, values, n)
    cuts = np.quantile(marks[y], [1 / 3, 2 / 3])
    grade = np.where(y, 1 + (marks > cuts[0]) + (marks > cuts[1]), 0)
    size = len(chosen)
    w, t = np.full(size, 0.05), np.array([2.0, 0.0, 0.0])
    m, v = np.zeros(size + 3), np.zeros(size + 3)
    for step in range(1, steps + 1):
        _, g_s, g_t = loss_and_slope(t, w, np.bincount(row, values * w[at], n), grade)
        g = np.concatenate([np.bincount(at, values * g_s[row], size) + ridge * w, g_t])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:-3], t - move[-3:]
    theta = [float(t[0]), float(t[0] + np.exp(t[1])), float(t[0] + np.exp(t[1]) + np.exp(t[2]))]
    return Model({int(i): float(a) for i, a in zip(chosen, w)}, theta)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    import numpy as np

    sample = materialize(training_rows(docs, labels, rows), "toxicity-sample")
    n1, n0 = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count_if(F.col("toxic") == 0)).first()
    chosen = chosen_features(sample, n1, n0) if n1 and n0 else []
    if not chosen:
        drop_table(sample)
        return Model({}, [30.0, 31.0, 32.0])
    found = sorted((r["toxic"], r["at"], r["counts"]) for r in chosen_rows(sample, chosen).toLocalIterator())
    drop_table(sample)
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x, _ in found])])
    at = np.array([i for _, x, _ in found for i in x], np.int64)
    values = np.log1p(np.array([n for _, _, x in found for n in x], float))
    return fit([x for x, _, _ in found], starts, at, values, chosen)


def scored(batches, model: Model):
    """Each batch with its rows' P(grade > k)."""
    import numpy as np

    weights = model.weights
    names: dict[str, str] = {}
    marks: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        total = np.zeros(batch.num_rows)
        for i, text in enumerate(batch["text"].to_pylist()):
            counts: dict[int, int] = {}
            for word in distinct_words(text, names):
                own = marks.get(word)
                if own is None:
                    own = marks[word] = tuple(x for x in word_features(word) if x in weights)
                for x in own:
                    counts[x] = counts.get(x, 0) + 1
            total[i] = sum(weights[x] * np.log1p(n) for x, n in sorted(counts.items()))
            if len(names) > CACHE:
                names.clear(), marks.clear()
        yield batch, model.above(total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_toxic, expected_severity, severity (the likeliest grade) and toxic, for every row."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, above in scored(batches, model):
            each = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "p_toxic": above[:, 0], "expected_severity": above.sum(1),
                "severity": each.argmax(1).astype(np.int32), "toxic": above[:, 0] >= 0.5,
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_toxic double, expected_severity double, severity int, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@pipeline_stage
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic, each judged by its own text, whatever other rows share its id."""
    model = train(docs, table(spark, sf_dir, "labels"))

    @tidied
    def run(batches):
        import pyarrow as pa

        for batch, above in scored(batches, model):
            yield batch.filter(pa.array(above[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
