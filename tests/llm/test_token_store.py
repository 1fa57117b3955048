"""The token store against the tokenizers library, over rows that are hard."""

import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lotwatch.llm import token_store
from lotwatch.llm.common import fresh_path
from tests.llm.fixtures import empty_documents, hard_documents

VOCABULARY = public_tokenizers.path(token_store.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def stored(docs, file_ids=token_store.FILE_IDS):
    path = fresh_path(docs.sparkSession, "store")
    token_store.write_store(docs, VOCABULARY, path, file_ids=file_ids)
    return token_store.read_store(docs.sparkSession, path)


@pytest.mark.parametrize("file_ids", [1, 50, token_store.FILE_IDS])
def test_hard_rows(spark, library, file_ids):
    """Null, empty and very long texts, null ids, repeated rows and a column whose name the operator uses itself."""
    docs = hard_documents(spark)
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0")).withColumn("start", F.lit("clash")).withColumn("file", F.lit(1))
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_store.END_ID]
        want.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert sorted(map(tuple, stored(docs, file_ids).collect()), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert stored(empty_documents(spark)).collect() == []


def test_pieces_make_the_ids_of_whole_texts(library):
    signs = ["a", "Bc", "É", "ß", "ÿ", "x'S", "'re", "''t", "9", "42", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "!", "?!", "“", "…", "—'ll", "¿", "µ", "×", "İ", "ǅ", "é", "́", "≠", "日本", "\U0001f600", "ﬁ", "Σ", "<|endoftext|>", "<|", "|>"]
    dice = random.Random(5)
    texts = ["".join(dice.choices(signs, k=dice.randrange(12))) for _ in range(4000)]
    t = token_store.WordTokenizer(VOCABULARY)
    want = [b"".join(i.to_bytes(t.width, "little") for i in e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert t.encode(texts) == want


def test_cache_of_two_generations(library, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE", 20)
    t = token_store.WordTokenizer(VOCABULARY)
    for k in range(30):
        texts = [f"word{k} word{k - 1} often seen", f"word{k // 2}"]
        assert t.encode(texts) == [b"".join(i.to_bytes(t.width, "little") for i in library.encode(x, add_special_tokens=False).ids) for x in texts]
        assert len(t.known) < 40 and len(t.older) < 40


def test_offsets_by_select():
    import numpy as np

    dice = np.random.default_rng(1)
    for values in ([], [0], [7] * 5000, np.sort(dice.integers(0, 1 << 40, 10_000)), np.arange(3000), [0] * 600 + [1 << 33]):
        code = token_store.EliasFano.decode(token_store.EliasFano.encode(values))
        assert code.select(np.arange(code.n)).tolist() == list(values)
