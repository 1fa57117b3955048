from itertools import combinations

from pyspark.sql import functions as F

from lotwatch.llm import ngram_join
from lotwatch.llm.common import table
from tests.llm.fixtures import empty_documents, hard_documents, shingle_set


def brute(rows):
    """doc_id -> (n, component) by comparing all pairs."""
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_same_components_as_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert found(ngram_join.query(spark, sf_dir)) == brute(docs.collect())


def test_small_tiles_and_heavy_tokens(spark, sf_dir):
    """Blocks within a tile and the order of frequent shingles change no result."""
    docs = table(spark, sf_dir, "documents")
    assert found(ngram_join.near_duplicates(docs, heavy=2, tile=2)) == brute(docs.collect())


def test_chain_of_near_copies(spark):
    """Neighbours link, ends don't; one component all the same."""
    rows = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 100)), "en", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = found(ngram_join.near_duplicates(docs))
    assert got == brute([{"doc_id": r[0], "text": r[1]} for r in rows]) and {c for _, c in got.values()} == {0}


def test_hard_rows(spark):
    got = found(ngram_join.near_duplicates(hard_documents(spark)))
    assert got.pop(None) == (3, None) and got == brute(hard_documents(spark, with_null_id=False).collect())


def test_repeated_rows_and_clashing_columns(spark):
    docs = hard_documents(spark, with_null_id=False).withColumn("cls", F.lit(1)).withColumn("root", F.lit("x"))
    twice = docs.unionByName(docs)
    got = ngram_join.near_duplicates(twice).collect()
    assert len(got) == 2 * docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs.collect())


def test_empty_table(spark):
    assert ngram_join.near_duplicates(empty_documents(spark)).collect() == []


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = ngram_join.stage(spark, docs, sf_dir)
    want = {d for d, (n, c) in brute(docs.collect()).items() if d == c}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_pairs_of_many_tiles_are_made_once(spark):
    """Near copies share many tiles, each with other classes; a pair is made in one of them, not in each and then thrown out."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(40):
        words = list(base)
        for at in rng.choice(200, 2, replace=False):
            words[at] = f"x{d}-{at}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = ngram_join.prefixes(docs, ngram_join.Bloom(None, 0), with_bits=True).cache()
    shared = ngram_join.bloom_of(ngram_join.tokens_of(sketch, 1))
    entries = ngram_join.tiles_of(ngram_join.shared_entries(sketch, shared).distinct()).withColumn("root", F.col("cls"))
    for tile in (512, 7):
        pairs = ngram_join.tile_pairs(entries, sketch.select("cls", "bits"), tile=tile)
        made = [tuple(r) for r in pairs.collect()]
        assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")[0]
        assert len(made) == len(set(made)) > 500
        cls = {r["cls"]: set(shingle_set(rows[r["doc_id"]][1])) for r in sketch.collect()}
        want = {(a, b) for a, b in combinations(sorted(cls), 2) if 100 * len(cls[a] & cls[b]) >= 80 * len(cls[a] | cls[b])}
        assert want <= set(made)


def test_workers_hold_little_at_a_time(spark):
    """An executor's Python workers get batches of 2 MB at most, and hash a quarter of a million bytes at a time."""
    from lotwatch.llm import common

    before = spark.conf.get(common.BATCH_BYTES)
    spark.conf.set(common.BATCH_BYTES, "8000000")
    common.bounded_batches(spark)
    assert int(spark.conf.get(common.BATCH_BYTES)) <= 2_000_000 and ngram_join.TEXT_BYTES <= 250_000
    spark.conf.set(common.BATCH_BYTES, before)
