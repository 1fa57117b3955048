"""Queries on few rows at the edges of their rules: halves, parts of seconds, nulls, names that overlap in chains."""

import duckdb
import pytest

from lotwatch import registry
from tests.oracle import difference


def table(folder, name, sql):
    duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


def holds(spark, folder, name):
    assert difference(registry.QUERIES[name](spark, str(folder)), str(folder), registry.ORACLES[name]) == ""


EVENTS = "SELECT row_number() OVER () AS event_id, x.ts::TIMESTAMP AS ts, x.v::DOUBLE AS value FROM (VALUES {}) x(ts, v)"


@pytest.mark.parametrize("last", ["2024-01-30 12:00:00.499", "2024-01-30 12:00:00.5", "2024-01-30 12:00:01.5", "2024-01-30 12:00:00.75"])
def test_urgency_rounds_parts_of_seconds_and_has_no_unknown(spark, tmp_path, last):
    at = [f"('{last}'::TIMESTAMP - INTERVAL '{s} seconds' - INTERVAL '{ms} milliseconds', 1)" for s in (3600, 25200, 90000, 262800) for ms in (-1000, -500, -250, 0, 250, 500, 750)]
    table(tmp_path, "events", EVENTS.format(", ".join([f"('{last}'::TIMESTAMP, 1)", "(NULL, 1)", *at])))
    holds(spark, tmp_path, "date05_urgency")


def test_greedy_plan_rounds_halves_to_even(spark, tmp_path):
    table(tmp_path, "supplier", "SELECT i AS s_suppkey, CASE WHEN i % 11 > 0 THEN (i % 10)::INTEGER END AS s_nationkey, CASE WHEN i % 7 > 0 THEN i % 29 - 9.5 END::DOUBLE AS s_acctbal FROM range(1, 300) r(i)")
    holds(spark, tmp_path, "win09_greedy_plan")


def test_lease_counts_parts_of_seconds(spark, tmp_path):
    at = [f"('2024-01-30 12:00:00.25'::TIMESTAMP - INTERVAL '{s} seconds' - INTERVAL '{ms} milliseconds', {v})" for s in (600, 1800) for ms in (-250, -1, 0, 1, 200, 300, 900) for v in (50, 150, 250, "NULL")]
    table(tmp_path, "events", EVENTS.format(", ".join(["('2024-01-30 12:00:00.25'::TIMESTAMP, 50)", "(NULL, 50)", *at])))
    holds(spark, tmp_path, "str06_lease")


def test_platforms_that_overlap_in_chains(spark, tmp_path):
    words = "['the', 'and', 'of', 'les', 'de']"
    chains = f"SELECT array_to_string(list_transform(range(0, 2 + i % 7), lambda j: {words}[1 + (hash(i * 31 + j) % 5)::INTEGER]), ' ') AS text FROM range(2000) r(i)"
    table(tmp_path, "documents", f"SELECT row_number() OVER () AS doc_id, text FROM ({chains} UNION ALL VALUES ('the and the and of'), ('The and the and the'), ('of the and of the'), (''), (NULL))")
    holds(spark, tmp_path, "strf13_platforms_in_text")


def test_accessories_send_no_table_through_the_driver(spark, sf_dir):
    plan = registry.QUERIES["join31_accessories"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_a_lot_size_is_dealt_out_from_one_small_file(spark, tmp_path):
    table(tmp_path, "part", "SELECT i AS p_partkey, 'red plate' AS p_name, (1 + i % 50)::INTEGER AS p_size FROM range(100) r(i)")
    assert "Exchange" in registry.QUERIES["strf17_lot_size"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    holds(spark, tmp_path, "strf17_lot_size")


def test_documents_of_suppliers_take_few_files(spark, tmp_path):
    table(tmp_path, "supplier", "SELECT i AS s_suppkey, 'x' || i AS s_name, (i * 1.5)::DOUBLE AS s_acctbal FROM range(500) r(i)")
    assert len(registry.QUERIES["src05_json_documents"](spark, str(tmp_path)).inputFiles()) < 50
    holds(spark, tmp_path, "src05_json_documents")


def test_a_verdict_is_asked_for_once_and_last(spark, sf_dir):
    plan = registry.QUERIES["val09_exceptional"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("la identidad de la pieza no está clara") == 1


def test_the_pipeline_encodes_in_smaller_parts_with_the_same_ids(spark, monkeypatch):
    from lotwatch.llm import bpe

    parts = []
    monkeypatch.setattr(bpe, "encode_documents", lambda *args, most=bpe.BATCH_CHARS, **more: parts.append(most))
    docs = spark.createDataFrame([(i, "word and " * (i * 7) + "x" * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    bpe.stage(spark, docs, "")
    assert parts and parts[0] < bpe.BATCH_CHARS
    monkeypatch.undo()
    import public_tokenizers

    coded = [sorted(map(tuple, bpe.encode_documents(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, most=n).collect())) for n in (100, bpe.BATCH_CHARS)]
    assert coded[0] == coded[1]


def test_search_intents_read_the_lines_once(spark, sf_dir):
    plan = registry.QUERIES["val10_search_intents"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey") and sum("Relation" in line and "l_suppkey" in line for line in plan.splitlines()) == 1
