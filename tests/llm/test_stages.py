"""Stages decide by row: null and repeated ids, and rows repeated whole, against plain versions."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lotwatch.llm import exact_dedup, mixing, ngram_join, toxicity
from lotwatch.llm.common import materialize, table
from tests.llm.fixtures import DOCS, UPPER, WORD, hard_documents, shingle_set


def shared_ids(spark):
    """Hard documents, twice whole, twice with a null id, and twice more under one id."""
    docs = hard_documents(spark)
    null, one = docs.withColumn("doc_id", F.lit(None).cast("long")), docs.withColumn("doc_id", F.lit(5).cast("long"))
    return docs.unionByName(docs).unionByName(null).unionByName(null).unionByName(one).unionByName(one)


def first(ids, least=True):
    """The least or largest id; null is above all others in the first case and below them in the second."""
    known = [i for i in ids if i is not None]
    return (min(known) if least else max(known)) if known else None


def test_toxicity_stage(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    some = table(spark, sf, "documents").join(labels.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = [tuple(r) for r in some.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    docs = spark.createDataFrame(rows + [(None, *r[1:]) for r in rows] + [(rows[0][0], *r[1:]) for r in rows[:40]], DOCS)
    numbered = list(enumerate(map(tuple, docs.collect())))
    plain = spark.createDataFrame([(i, r[1]) for i, r in numbered], "doc_id long, text string")
    toxic = {r["doc_id"] for r in toxicity.score(plain, toxicity.train(docs, labels)).filter("toxic").collect()}
    want = Counter(r for i, r in numbered if i not in toxic)
    got = toxicity.stage(spark, docs, sf)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == want
    assert toxic and any(r[0] is None for r in want)


def test_exact_dedup_stage(spark, sf_dir):
    docs = shared_ids(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[(r["text"] or "").translate(UPPER)].append(r["doc_id"])
    got = exact_dedup.stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert Counter(((r["text"] or "").translate(UPPER), r["doc_id"]) for r in got.collect()) == Counter((x, first(ids, least=False)) for x, ids in groups.items())


def test_exact_dedup_keeps_one_row_of_colliding_digests(spark):
    docs = materialize(shared_ids(spark).withColumn("n", F.monotonically_increasing_id()), "numbered")
    rows = exact_dedup.dedup(docs, lambda text: F.substring(F.sha2(text, 256), 1, 1), row="n").filter("locator = keep_locator").collect()
    assert len(rows) == len({r["text_sha256"] for r in rows}) == len({(r["text"] or "").translate(UPPER) for r in docs.collect()})


def test_ngram_join_stage(spark, sf_dir):
    docs = shared_ids(spark)
    sets = defaultdict(list)
    for r in docs.collect():
        sets[shingle_set(r["text"])].append(r["doc_id"])
    alone, parent = sets.pop(frozenset(), []), {s: s for s in sets}

    def root(s):
        return s if parent[s] is s else root(parent[s])

    for x in sets:
        for y in sets:
            if 100 * len(x & y) >= 80 * len(x | y):
                parent[root(x)] = root(y)
    groups = defaultdict(list)
    for s, ids in sets.items():
        groups[root(s)] += ids
    got = ngram_join.stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([*alone, *map(first, groups.values())])


def test_mixing_stage(spark, sf_dir):
    docs = shared_ids(spark)
    got, want = mixing.stage(spark, docs, sf_dir), mixing.mix(docs).filter("copies > 0")
    size = lambda r: len(WORD.findall(r["text"] or ""))
    left = Counter()
    for r in want.collect():
        left[r["doc_id"], r["size"], r["source"]] += r["copies"]
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], size(r), r["source"]) for r in got.collect()) == left


def test_no_range_of_keys_is_crowded(spark):
    """Light and heavy documents of one source: the fullest of the ranges holds a few even shares, not a fifth of all."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'s' AS source", "CASE WHEN id % 3 = 0 THEN repeat('long', 40) ELSE 'some words here' END AS text")
    size = mixing.word_count(F.col("text"))
    w = mixing.quality_weight(F.col("text"), size)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id")), 11).cast("double") + 0.5) / F.lit(float(2**53))
    bucket = F.floor((1 - F.exp(-mixing.LEAST_WEIGHT * (-F.log(u) / w))) * 64)
    fullest = docs.groupBy(bucket).count().agg(F.max("count")).first()[0]
    assert fullest <= 1.2 * 40_000 / 64 / mixing.LEAST_WEIGHT
