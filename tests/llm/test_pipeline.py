"""The pipeline's rows against what plain versions leave of the documents."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from lotwatch.llm import bpe, mixing, toxicity
from lotwatch.llm.common import table
from tests.llm.fixtures import DOCS, UPPER, shingle_set


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "bpe"]


def test_run_against_plain_versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).filter("toxic").collect()}
    left = [r for r in docs.collect() if r["doc_id"] not in toxic]
    same = defaultdict(list)
    for r in left:
        same[(r["text"] or "").translate(UPPER)].append(r)
    left = [max(rows, key=lambda r: r["doc_id"]) for rows in same.values()]
    sets, parent = {r["doc_id"]: shingle_set(r["text"]) for r in left}, {r["doc_id"]: r["doc_id"] for r in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    left = [r for r in left if root(r["doc_id"]) == r["doc_id"]]
    rest = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in left], DOCS)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(rest).select("doc_id", "copies").collect()}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    want = Counter()
    for r in left:
        tokens = whole.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()] += copies[r["doc_id"]]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256").collect())
    assert got == +want
