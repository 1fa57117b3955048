"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Spark deals out the documents. In a task, texts are split by the vocabulary's pattern, with tiktoken's Unicode tables;
the distinct pieces not yet known go to DuckDB as token-position rows, one per byte. A recursive query joins each word's
adjacent pairs to the merge table and contracts its leftmost pair of minimum rank, until no pair of it is in the table.
A piece that is a token itself is that token. Decoding joins a batch's ids to the vocabulary and concatenates the bytes
by an ordered aggregation per document.

Pieces of over LONG bytes (a run of one character, a line without spaces) would take a round per merge and keep every
round's rows. They are contracted in blocks of LONG bytes, all blocks at once. Where two blocks meet, the tokens around
the seam are joined and contracted again, twice as many each time, until what comes out begins and ends with the tokens
that stood there. A row of tokens is the encoding of its bytes if each two neighbours are the encoding of theirs, and
so the result is that of the whole piece.

Memory: a batch of at most BATCH_CHARS characters (or one text), queries over about QUERY_BYTES bytes of pieces, and two
generations of cached pieces per worker: when the younger has more than `cache`, it becomes the older, from which what is
met again comes back. DuckDB is in memory and may not use a folder. Tasks write
nothing, so a lost executor costs only its tasks' time.

Edge cases: null and empty texts have 0 tokens, whose ids digest is that of the empty string; special-token strings
are ordinary text; lone surrogates can't occur in Spark strings; repeated rows, null ids and extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import kept, pipeline_stage, table, tidied

VOCABULARY = "byte_bpe_50k.tiktoken"
BATCH_CHARS, CACHE, LONG, QUERY_BYTES = 3_000_000, 300_000, 64, 500_000
#: In the pipeline, where executors still hold what the stages before took, texts come in smaller parts and fewer pieces are cached.
STAGE_CHARS, STAGE_CACHE = 500_000, 100_000

#: Positions stay below 2^31, ranks below 2^31: one long orders pairs by rank, then from the left.
CONTRACT_SQL = """
WITH RECURSIVE steps(w, pos, tok, live) AS (
    SELECT w, pos, tok, true FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT w, pos, tok, lead(tok) OVER o AS right_tok, lag(pos) OVER o AS before FROM steps WHERE live WINDOW o AS (PARTITION BY w ORDER BY pos)
    ), leftmost AS (
        SELECT w, min(rank::BIGINT << 31 | pos) AS best FROM pairs p JOIN merges m ON p.tok = m.left_tok AND p.right_tok = m.right_tok GROUP BY w
    )
    SELECT p.w, p.pos, CASE WHEN p.pos = best & 2147483647 THEN (best >> 31)::INTEGER ELSE tok END, best IS NOT NULL
    FROM pairs p LEFT JOIN leftmost b ON p.w = b.w
    WHERE best IS NULL OR before IS DISTINCT FROM best & 2147483647)
)
SELECT w, string_agg(tok, ' ' ORDER BY pos) AS ids FROM steps WHERE NOT live GROUP BY w
"""

DECODE_SQL = """
SELECT doc, sha256(unhex(string_agg(hex, '' ORDER BY pos))) AS digest FROM ids JOIN vocabulary USING (id) GROUP BY doc
"""


#: Character classes that a pattern may use.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def ranges(codes) -> str:
    """Ascending code points as the inside of a character class."""
    import numpy as np

    codes = np.asarray(codes)
    if not len(codes):
        return ""
    breaks = np.flatnonzero(np.diff(codes) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.concatenate([[0], breaks + 1])].tolist(), codes[np.concatenate([breaks, [len(codes) - 1]])].tolist()))


@functools.cache
def exact_pattern(pattern: str, first: int = 0x110000) -> tuple[str, str]:
    """The inside of a class of the code points that tiktoken and regex class differently, and the pattern as tiktoken reads it.

    Their Unicode tables are of different versions. What tiktoken has in a class is what it finds in a text of all code
    points, of which bytes are the tokens here. The pattern holds for texts of the `first` code points.
    """
    import regex
    import tiktoken

    every = "".join(chr(k) for k in range(first) if not 0xD800 <= k < 0xE000)
    theirs, odd = {}, set()
    for c in CLASSES:
        found = tiktoken.Encoding("class", pat_str=c, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
        theirs[c] = sorted(map(ord, bytes(found).decode()))
        odd |= set(theirs[c]) ^ set(map(ord, regex.findall(c, every)))
    out, inside, at = [], False, 0
    while at < len(pattern):
        token = next((c for c in CLASSES if pattern.startswith(c, at)), pattern[at : at + 2] if pattern[at] == "\\" else pattern[at])
        own = ranges(theirs[token]) if token in theirs else token
        other = f"[^{ranges(theirs[token.lower()])}]" if token == r"\S" else own
        out.append(f"[{own}]" if token in theirs and not inside else other)
        inside = token == "[" or (inside and token != "]")
        at += len(token)
    return ranges(sorted(odd)), "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The merge table and the vocabulary in a DuckDB of this worker."""

    def __init__(self, path: str, pattern: str, odd: str = "", exact: str = "", near: str = "") -> None:
        """odd and exact: those of exact_pattern(); near: the pattern for texts of the first 256 characters.

        Such texts take the near pattern, which has few characters to tell apart and is the quickest; texts with an odd
        character the exact one; all others the pattern itself.
        """
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        self.fast = regex.compile(pattern).findall
        self.exact = re.compile(exact).findall if odd else self.fast
        self.odd = re.compile(f"[{odd}]").search if odd else lambda text: None
        self.near = re.compile(near).findall if near else None
        self.cache = CACHE
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.ranks = ranks = read_ranks(path)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.bytes_of = {str(r): token for token, r in ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "preserve_insertion_order": "false", "temp_directory": ""})
        merges = pa.table({"left_tok": pa.array(left, pa.int32()), "right_tok": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [x.hex() for x in ranks]})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        del merges, vocabulary

    def pieces(self, text: str) -> list[str]:
        if self.near:
            try:
                text.encode("latin-1")  # by far the quickest test that all characters are among the first 256
            except UnicodeEncodeError:
                return self.exact(text) if self.odd(text) else self.fast(text)
            return self.near(text)
        return self.exact(text) if self.odd(text) else self.fast(text)

    def _contract(self, words: list[bytes]) -> list[str]:
        """The ids of each word, in decimal, by the recursive query."""
        import numpy as np
        import pyarrow as pa

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        start = pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32),
            "tok": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)],
        })
        self.db.register("start", start)
        found = self.db.sql(CONTRACT_SQL).to_arrow_table()
        self.db.unregister("start")
        out = [""] * len(words)
        for w, ids in zip(found["w"].to_pylist(), found["ids"].to_pylist()):
            out[w] = ids
        return out

    def contracted(self, words: list[bytes]) -> list[str]:
        """The same for any number of words, in queries of bounded size; long words in blocks."""
        out, part, size = [""] * len(words), [], 0
        for i, w in enumerate(words):
            if len(w) <= LONG:
                part.append(i)
                size += len(w)
            if part and (size > QUERY_BYTES or i == len(words) - 1):
                for k, ids in zip(part, self._contract([words[k] for k in part])):
                    out[k] = ids
                part, size = [], 0
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        for i, ids in zip(long, self._by_blocks([words[i] for i in long])):
            out[i] = " ".join(ids)
        return out

    def _by_blocks(self, words: list[bytes]) -> list[list[str]]:
        """Long words' ids: those of their blocks, with the seams contracted again; pairs of neighbours join by turns."""
        cut = [[w[i : i + LONG] for i in range(0, len(w), LONG)] for w in words]
        coded = iter(self.contracted([x for blocks in cut for x in blocks]) if words else [])
        rows = [[next(coded).split(" ") for _ in blocks] for blocks in cut]
        while any(len(row) > 1 for row in rows):
            seams = [(k, i) for k, row in enumerate(rows) for i in range(0, len(row) - 1, 2)]
            joined: dict[tuple[int, int], list[str]] = {}
            around = 2
            while len(joined) < len(seams):
                left = [s for s in seams if s not in joined]
                windows = [(rows[k][i][-around:], rows[k][i + 1][:around]) for k, i in left]
                found = self._contract([b"".join(self.bytes_of[t] for t in (*a, *b)) for a, b in windows])
                for (k, i), (a, b), ids in zip(left, windows, (x.split(" ") for x in found)):
                    x, y = rows[k][i], rows[k][i + 1]
                    if (len(a) == len(x) or ids[0] == a[0]) and (len(b) == len(y) or ids[-1] == b[-1]):
                        joined[k, i] = x[: len(x) - len(a)] + ids + y[len(b) :]
                around *= 2
            rows = [[joined.get((k, i), row[i]) for i in range(0, len(row), 2)] for k, row in enumerate(rows)]
        return [row[0] for row in rows]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces, as decimal text, into the cache."""
        words = []
        for p in pieces:
            raw = p.encode()
            if (r := self.ranks.get(raw)) is not None:
                self.known[p] = str(r)
            else:
                words.append((p, raw))
        if words:
            self.known.update(zip([p for p, _ in words], self.contracted([raw for _, raw in words])))

    def encode(self, texts: list[str]) -> list[str]:
        """For each text its ids in decimal, joined by a space."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > self.cache:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        unknown = set().union(*split).difference(known)
        for p in [p for p in unknown if p in older]:
            known[p] = older[p]
            unknown.remove(p)
        if unknown:
            self.learn(unknown)
        return [" ".join([known[p] for p in pieces]) for pieces in split]

    def decoded_digests(self, ids: list) -> list[str]:
        """SHA-256 of the bytes that each array of ids decodes to."""
        import numpy as np
        import pyarrow as pa

        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(total, dtype=np.int32), "id": np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)}))
        found = self.db.sql(DECODE_SQL).to_arrow_table()
        self.db.unregister("ids")
        out = [hashlib.sha256(b"").hexdigest()] * len(ids)
        for doc, digest in zip(found["doc"].to_pylist(), found["digest"].to_pylist()):
            out[doc] = digest
        return out


def codec(path: str, pattern: str, odd: str, exact: str, near: str) -> Codec:
    """This worker's codec of a vocabulary, made once, until a task of another module needs the worker's memory."""
    codecs = kept(__name__)
    if (path, pattern) not in codecs:
        codecs[path, pattern] = Codec(path, pattern, odd, exact, near)
    return codecs[path, pattern]


def by_size(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of consecutive texts with at most so many characters together, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, most: int = BATCH_CHARS, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int); `most` characters at a time.

    cache: how many pieces a generation of a worker's cache has.
    """
    odd, exact = exact_pattern(pattern)
    near = exact_pattern(pattern, 256)[1]

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = codec(path, pattern, odd, exact, near)
        c.cache = cache
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for part in by_size(texts, most):
                coded = c.encode(texts[part])
                ids = [np.fromstring(x, dtype=np.int32, sep=" ") if x else np.empty(0, np.int32) for x in coded]
                columns = {
                    "doc_id": batch["doc_id"][part],
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in coded],
                    "decoded_sha256": c.decoded_digests(ids),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@pipeline_stage
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids: doc_id, n_tokens, the digests and ids."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True, most=STAGE_CHARS, cache=STAGE_CACHE)
