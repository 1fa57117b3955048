"""Token ids in binary files with Elias-Fano encoded document boundaries.

Documents are dealt by ranges of doc_id, sorted inside each range, tokenized (an end id after each document) and
written as runs of consecutive documents, one file each: header, Elias-Fano end offsets, Elias-Fano doc ids, then
one concatenated array of ids of two or four bytes. Both monotone sequences take about 2 + log2(range / n) bits a
value; a directory of 32-bit counts per 64 bytes of the upper bits finds the i-th value without a table of offsets.
Files hold about FILE_IDS ids (one document at least), so memory is bounded by one file. They are written by
Spark's text sink, which commits or discards whole tasks; the newline it appends lies behind the declared sizes.

Edge cases: null and empty texts are the end id alone; null ids come first; rows of equal ids follow each other in
order of a hash of their texts; an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import bounded_batches, fresh_path, materialize, slices, table, tidied

VOCABULARY, END_ID = "word_bpe_49k.json", 2
FILE_IDS, CACHE, TEXT_BYTES = 4_000_000, 500_000, 1_000_000
MAGIC = b"EFT1"
#: magic, bytes per id, range, file of the range, documents, null ids among them, least id, ids, bytes of both codes
HEADER = struct.Struct("<4sBqqqqqqqq")
BLOCK = 64


def _tables():
    import numpy as np

    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    select = np.zeros((256, 8), np.uint8)
    for b in range(256):
        at = np.flatnonzero(bits[b])
        select[b, : len(at)] = at
    return bits.sum(1).astype(np.int64), select


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, upper: bytes, ones_before: bytes) -> None:
        import numpy as np

        self.n, self.low_bits = n, low_bits
        self.low, self.upper = np.frombuffer(low, np.uint8), np.frombuffer(upper, np.uint8)
        self.ones_before = np.frombuffer(ones_before, np.uint32)
        self.count, self.nth = _tables()

    @staticmethod
    def encode(values) -> bytes:
        import numpy as np

        v = np.asarray(values, np.int64)
        n = len(v)
        low_bits = max(0, int(v[-1] // n).bit_length() - 1) if n else 0
        low = np.packbits((v[:, None] >> np.arange(low_bits)) & 1, bitorder="little") if low_bits else np.empty(0, np.uint8)
        high = (v >> low_bits) + np.arange(n)
        bits = np.zeros(-(-(int(high[-1]) + 1 if n else 0) // (8 * BLOCK)) * 8 * BLOCK, np.uint8)
        bits[high] = 1
        upper = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 8 * BLOCK).sum(1))])[:-1].astype("<u4")
        return struct.pack("<qBqqq", n, low_bits, len(low), len(upper), len(ones) * 4) + low.tobytes() + upper.tobytes() + ones.tobytes()

    @classmethod
    def decode(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<qBqqq", data)
        at = struct.calcsize("<qBqqq")
        return cls(n, low_bits, data[at : at + a], data[at + a : at + a + b], data[at + a + b : at + a + b + c])

    def select(self, i):
        """The values at indices i (an array)."""
        import numpy as np

        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.int64)
        for s in range(0, len(i), 4096):
            k = i[s : s + 4096]
            block = np.searchsorted(self.ones_before, k, side="right") - 1
            around = self.upper[block[:, None] * BLOCK + np.arange(BLOCK)]
            upto = np.cumsum(self.count[around], axis=1)
            left = k - self.ones_before[block]
            byte = (upto <= left[:, None]).sum(1)
            rows = np.arange(len(k))
            before = np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0)
            position = (block * BLOCK + byte) * 8 + self.nth[around[rows, byte], left - before]
            out[s : s + 4096] = (position - k) << self.low_bits
            if self.low_bits:
                bit = k[:, None] * self.low_bits + np.arange(self.low_bits)
                out[s : s + 4096] |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


def pack_file(range_no: int, file_no: int, doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """One file of consecutive documents; null doc ids come first."""
    import numpy as np

    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // width for x in ids])
    ends_code, docs_code = EliasFano.encode(ends), EliasFano.encode(known - least)
    head = HEADER.pack(MAGIC, width, range_no, file_no, len(ids), nulls, least, int(ends[-1]) if len(ends) else 0, len(ends_code), len(docs_code))
    return b"".join([head, ends_code, docs_code, *ids])


class TokenFile:
    """A file's documents by position, or all of them."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.range_no, self.file_no, self.n, self.nulls, self.least, self.n_ids, a, b = HEADER.unpack_from(data)
        if magic != MAGIC or len(data) < HEADER.size + a + b + self.n_ids * self.width:
            raise ValueError("not a whole file of token ids")
        at = HEADER.size
        self.ends, self.docs = EliasFano.decode(data[at : at + a]), EliasFano.decode(data[at + a : at + a + b])
        self.data, self.at = data, at + a + b

    def bounds(self):
        import numpy as np

        ends = self.ends.select(np.arange(self.n))
        return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends

    def ids(self, start: int, end: int):
        import numpy as np

        return np.frombuffer(self.data, f"<u{self.width}", end - start, self.at + start * self.width)

    def doc_ids(self) -> list:
        import numpy as np

        return [None] * self.nulls + (self.docs.select(np.arange(self.docs.n)) + self.least).tolist()


#: By this a token ends a word.
WORD_END = "</w>"
#: Letters and signs of which lower-casing, composition and the tokenizer's pattern are known letter by letter.
LETTERS, SIGNS = "a-zß-öø-ÿ", "¡¿–—‘’“”…"
_beyond = re.compile(f"[^\t-\r -~À-ÖØ-öø-ÿ{SIGNS}]|<\\|")
_near = bytes(k for k in range(256) if not _beyond.search(chr(k)))
_pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")


def is_plain(text: str) -> bool:
    """Does the text hold nothing but those letters and signs? Most texts are told by their bytes, without a search."""
    try:
        return not text.encode("latin-1").translate(None, _near) and "<|" not in text
    except UnicodeEncodeError:
        return not _beyond.search(text)


class WordTokenizer:
    """The tokenizer with a cache of pieces of texts, over which its ids simply follow each other.

    Texts of plain Latin letters fall into the matches of the tokenizer's own pattern. Any other text (or one that may
    hold a special token's string) falls into what stands between spaces: no token holds a space or a line feed.
    Pieces that aren't known go to the library together. The cache has two generations: when the younger is full it
    becomes the older, from which what is met again comes back, so that memory stays bounded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]
        self.ends_word = np.isin(np.arange(self.tokenizer.get_vocab_size()), ends)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str], units: list[str]) -> None:
        """Put pieces into the cache: words, matches of the pattern, are encoded as one text, whose ids a word's last token parts; units one by one."""
        import numpy as np

        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                coded, at = ids.tobytes(), [0, *(ends * self.width).tolist()]
                self.known.update((w, coded[a:b]) for w, a, b in zip(words, at, at[1:]))
            else:  # some word has other than one last token: each for itself
                units = units + words
        for unit, coded in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False)):
            self.known[unit] = np.array(coded.ids, f"<u{self.width}").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers of `width` bytes."""
        plain = [is_plain(x) for x in texts]
        cut = [_pieces.findall(x.lower()) if p else x.replace("\n", " ").split(" ") for x, p in zip(texts, plain)]
        if len(self.known) > CACHE:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        new = []
        for wanted in (True, False):
            found = set().union(*(x for x, p in zip(cut, plain) if p == wanted)).difference(known)
            for unit in [u for u in found if u in older]:
                known[unit] = older[unit]
                found.remove(unit)
            new.append(found)
        self._learn(list(new[0]), list(new[1] - new[0]))
        return [b"".join(map(known.__getitem__, x)) for x in cut]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def write_store(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write the ids of all texts, in ascending order of doc_id, as files below `path`."""

    @tidied
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        t = word_tokenizer(vocabulary)
        end = end_id.to_bytes(t.width, "little")
        range_no, file_no, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                for doc_id, coded in zip(part["doc_id"].to_pylist(), t.encode([x or "" for x in part["text"].to_pylist()])):
                    doc_ids.append(doc_id), ids.append(coded + end)
                    size += len(ids[-1]) // t.width
                    if size >= file_ids:
                        yield pa.RecordBatch.from_pydict({"file": pa.array([pack_file(range_no, file_no, doc_ids, ids, t.width)], pa.binary())})
                        file_no, doc_ids, ids, size = file_no + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pydict({"file": pa.array([pack_file(range_no, file_no, doc_ids, ids, t.width)], pa.binary())})

    bounded_batches(docs.sparkSession)
    # Rows without an id, or of one id, may be many: a hash of the text deals them over several ranges.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_place")).repartitionByRange("doc_id", "_place")
    ordered = dealt.sortWithinPartitions("doc_id", "_place", "text").select("doc_id", "text")
    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), all as longs."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for content in batch["content"]:
                f = TokenFile(content.as_py())
                starts, ends = f.bounds()
                crcs = [zlib.crc32(f.ids(a, b).astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "range_no": np.full(f.n, f.range_no), "file_no": np.full(f.n, f.file_no), "file_ids": np.full(f.n, f.n_ids), "doc_id": pa.array(f.doc_ids(), pa.int64()),
                    "inner": starts, "n_tokens": ends - starts, "ids_crc32": pa.array(crcs, pa.int64()),
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.filter("length > 0").select("content").mapInArrow(run, "range_no long, file_no long, file_ids long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    rows = materialize(rows, "token-store-rows")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_file = rows.groupBy("range_no", "file_no").agg(F.first("file_ids").alias("n"))
    per_range = per_file.groupBy("range_no").agg(F.sum("n").alias("n")).select("range_no", before(Window.orderBy("range_no")).alias("range_before"))
    bases = per_file.join(per_range, "range_no").select("range_no", "file_no", (F.col("range_before") + before(Window.partitionBy("range_no").orderBy("file_no"))).alias("base"))
    return rows.join(bases, ["range_no", "file_no"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), path)
    return read_store(spark, path)
