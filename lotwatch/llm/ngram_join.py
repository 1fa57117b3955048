"""Near duplicates by a Jaccard join on distinct 5-word shingles, exact at a threshold of 80 %.

Shingles are 64-bit hashes of five consecutive lower-cased words (their number is off by as much as hashes collide); a
document's set is a sorted array of them, and documents with the same set are one class, whatever the number of copies.
All later work is on classes.

Candidates. Two sets with Jaccard >= t share a shingle among the first |x| - ceil(t |x|) + 1 of each, in any order
common to all sets. The order used is frequent shingles last (a Bloom filter of fixed size of those with more than
HEAVY documents; a false positive only moves a shingle, for all sets alike), then by hash. So passages that many
documents share make no tiles, but for documents that consist of them. Shingles that only one document has among its
first are dropped by another such filter.

Tiles. Shingles with the same classes are one tile, whose weight is their number: a passage of fifty words or a group
of copies is then a few tiles and not hundreds. (A collision of the sums that stand for the lists of classes joins two
tiles, which only adds candidates.)

Links without all pairs of a group. A class's degree is the number of meetings that it has over all its shingles; the
middle of a group of near copies, from which all others come, has the highest. ROUNDS rounds hold each class against
up to HUBS of the classes of highest degree under other roots in its tiles, those that it shares most shingles with,
and join the roots that link. What can still connect are classes of a tile under different roots. These are compared in
size-banded tiles (tile, size band; each class also visits the next band up, as sets with Jaccard >= t lie in one
band or two neighbours), in blocks of at most TILE rows: each class has a bitmap of its hashed shingles, and
|x| - bits of x missing in y bounds the overlap from above. Pairs that pass, under different roots, are made once, in the
least of the tiles that they share, and verified by
intersecting the sorted arrays. No link between different components is missed, and a group of thousands of near
copies costs a few verifications per member.

Whole sets are made only for classes in pairs that their bitmaps allow; they are found by a Bloom filter of their
documents' ids, so texts aren't shuffled. Edge cases: documents without words have no shingles and are components of their own; with fewer
than five words the whole sequence is one shingle; null texts count as empty; null ids don't name a component unless
there is no other id in it; repeated rows are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import bounded_batches, drop_table, materialize, pipeline_stage, release, slices, table, tidied, with_row

WORDS, PERCENT = 5, 80
HEAVY, TILE = 64, 512
#: Rounds that join roots before tiles are compared in full, and hubs of a tile (and tries of a class) in each.
ROUNDS, HUBS = 2, 2
#: Bytes of text that are hashed at a time.
TEXT_BYTES = 250_000
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
BITMAP_LEAST, BITMAP_MOST = 64, 1 << 17
_MULTIPLIER, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: The base of the words' polynomial hash modulo 2**64, and its inverse.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(h):
    """Splitmix64's finisher over an array of uint64."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX2)
    return h ^ (h >> np.uint64(31))


_powers: list = []


def powers(n: int):
    """The base's first n powers, and its inverse's, modulo 2**64."""
    import numpy as np

    if not _powers or len(_powers[0]) < n:
        size = max(n, TEXT_BYTES + 1)
        factors = np.repeat(np.array([[_BASE], [_INVERSE]], np.uint64), size, axis=1)
        factors[:, 0] = 1
        _powers[:] = np.cumprod(factors, axis=1, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def byte_values():
    """A number for each byte, the same for A and a; and which bytes are white space."""
    import numpy as np

    value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space


def shingle_sets(texts, words: int = WORDS):
    """The sets of the texts of an Arrow array of binaries, each as a sorted array of uint64."""
    import numpy as np
    import pyarrow as pa

    wide = pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return [np.empty(0, np.uint64)] * len(texts)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    value, is_space = byte_values()
    power, inverse = powers(len(data))
    space = np.concatenate([[True], is_space[data], [True]])
    full = ~space[1:-1]
    first, last = full & space[:-2], full & space[2:]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]  # words don't go over them
    first[bounds] |= full[bounds]
    last[bounds - 1] |= full[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * power, dtype=np.uint64)])
    w = mixed((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MIX2))
    cut = np.searchsorted(starts, offsets)
    out = []
    whole = np.full(max(0, len(w) - words + 1), words, np.uint64)
    for i in range(words):
        whole = whole * np.uint64(_MULTIPLIER) + w[i : i + len(whole)]
    whole = mixed(whole)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for x in w[a:b]:
                h = h * np.uint64(_MULTIPLIER) + x
            out.append(mixed(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def rows_with_sets(batches):
    """Slices of the batches and their texts' sets."""
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            yield part, shingle_sets(part["text"])


class Bloom:
    """A Bloom filter of 64-bit keys with two probes; None as bits stands for the filter that holds nothing."""

    def __init__(self, bits, log2: int) -> None:
        self.bits, self.log2 = bits, log2

    def has(self, keys):
        import numpy as np

        if self.bits is None or not len(keys):
            return np.zeros(len(keys), bool)
        mask, out = np.uint64((1 << self.log2) - 1), np.ones(len(keys), bool)
        for at in (keys & mask, (keys >> np.uint64(64 - self.log2)) & mask):
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom_of(keys: DataFrame) -> Bloom:
    """The filter of a one-column table of longs (hashes); at most MOST_BITS / 64 words go to the driver."""
    import numpy as np

    name = keys.columns[0]
    keys = materialize(keys, "filter-keys")
    n = keys.count()
    if not n:
        return Bloom(None, 0)
    log2 = min(max(LEAST_BITS, 16 * n), MOST_BITS).bit_length() - 1
    k = F.col(name)
    places = F.explode(F.array(k.bitwiseAND(F.lit((1 << log2) - 1)), F.shiftrightunsigned(k, 64 - log2)))
    words = keys.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()
    drop_table(keys)
    bits = np.zeros((1 << log2) // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bloom(bits, log2)


def id_key(ids):
    """Hashes of document ids for a filter; null counts as an id of its own."""
    import numpy as np

    known = np.array([0x7FFFFFFFFFFFFFF1 if i is None else i for i in ids], np.int64).view(np.uint64)
    return mixed(known * np.uint64(_MULTIPLIER))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(s) -> bytes:
    """One bit per shingle, hashed into the next power of two from 8 |s| on."""
    import numpy as np

    width = min(max(BITMAP_LEAST, 1 << (8 * len(s) - 1).bit_length()), BITMAP_MOST)
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def with_bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def prefixes(docs: DataFrame, heavy: Bloom, percent: int = PERCENT, with_bits: bool = False) -> DataFrame:
    """doc_id, n, cls (hash of the set, null for the empty one), the first shingles in the common order, the bitmap if asked for."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch, sets in rows_with_sets(batches):
            sizes, classes, first, bits = [], [], [], []
            for s in sets:
                sizes.append(len(s))
                bits.append(bitmap(s) if with_bits and len(s) else None)
                if not len(s):
                    classes.append(None), first.append(s)
                    continue
                classes.append(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))
                k, late = prefix_size(len(s), percent), heavy.has(s)
                first.append(s[:k] if not late[:k].any() else np.concatenate([s[~late], s[late]])[:k])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            values = np.concatenate([*first, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)
            columns = {"doc_id": batch["doc_id"], "n": pa.array(sizes, pa.int64()), "cls": pa.array(classes, pa.int64()), "first": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))}
            yield pa.RecordBatch.from_pydict(columns | {"bits": pa.array(bits, pa.binary())} if with_bits else columns)

    return with_bytes(docs).mapInArrow(run, "doc_id long, n long, cls long, first array<long>" + ", bits binary" * with_bits)


def tokens_of(sketch: DataFrame, more_than: int) -> DataFrame:
    """The first shingles that more than so many documents have."""
    counts = sketch.select(F.explode("first").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.filter(F.col("df") > more_than).select("token")


def shared_entries(sketch: DataFrame, shared: Bloom) -> DataFrame:
    """(token, cls, n) for the first shingles that the filter holds."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            first = batch["first"]
            lengths = np.diff(first.offsets.to_numpy())
            tokens = first.flatten().to_numpy(zero_copy_only=False)
            keep = shared.has(tokens.view(np.uint64))
            row = np.repeat(np.arange(batch.num_rows), lengths)[keep]
            yield pa.RecordBatch.from_pydict({"token": tokens[keep], "cls": batch["cls"].take(pa.array(row)), "n": batch["n"].take(pa.array(row))})

    return sketch.filter("cls IS NOT NULL").select("cls", "n", "first").mapInArrow(run, "token long, cls long, n long")


def sets_of(docs: DataFrame, wanted: Bloom) -> DataFrame:
    """cls, n and the whole set of the documents whose ids the filter holds."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["cls", "n", "shingles"])

        for batch in batches:
            found = wanted.has(id_key(batch["doc_id"].to_pylist()))
            for _, sets in rows_with_sets([batch.filter(pa.array(found))]):
                rows = [(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64), len(s), s.tobytes()) for s in sets if len(s)]
                if rows:
                    yield out(rows)

    return with_bytes(docs).mapInArrow(run, "cls long, n long, shingles binary")


def linked(n: int, m: int, common: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (n + m - common)


def fold(bits, width: int):
    """A bitmap of 64-bit words at a smaller power-of-two width."""
    while len(bits) * 64 > width:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def both_sides(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with what `values` (cls and more) has of each, as columns named by _a and _b."""
    side = lambda s: values.select(*[F.col(c).alias(s if c == "cls" else f"{c}_{s}") for c in values.columns])
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")


def possible(pairs: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes that their bitmaps allow to link; bits: (cls, n, bits)."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            n, m = batch["n_a"].to_pylist(), batch["n_b"].to_pylist()
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch[c][i].as_py(), np.uint64) for c in ("bits_a", "bits_b"))
                width = 64 * min(len(x), len(y))
                x, y = fold(x, width), fold(y, width)
                most = min(n[i] - int(np.bitwise_count(x & ~y).sum()), m[i] - int(np.bitwise_count(y & ~x).sum()))
                if linked(n[i], m[i], most, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep, pa.int64())), batch["b"].take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return both_sides(pairs, bits).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes that link, by intersecting the sorted arrays; sets: (cls, n, shingles)."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            n, m = batch["n_a"].to_pylist(), batch["n_b"].to_pylist()
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch[c][i].as_py(), np.uint64) for c in ("shingles_a", "shingles_b"))
                if linked(n[i], m[i], len(np.intersect1d(a, b, assume_unique=True)), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep, pa.int64())), batch["b"].take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return both_sides(pairs, sets).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b): the least node that each can reach.

    Alternates: all neighbours of a node move to the least of them, until the edges are stars around the least nodes.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seal = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()  # noqa: E731  equal for the same edges
    before = seal(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        now = materialize(small, "edges")
        before, last = seal(now), before
        if before == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def nearer(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected edges (a, b): one that it can reach, the same for a star's nodes.

    Two steps up to the neighbour with most edges; nodes of one label are connected, though not all that are have one.
    """
    both = edges.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).distinct()
    many = both.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    rank = lambda node: F.struct("k", (-F.col(node)).alias("last"))
    above = both.join(many.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.max(rank("v")).alias("above"))
    up = above.join(many, "u").select(F.col("u").alias("node"), (-F.greatest("above", rank("u"))["last"]).alias("label"))
    up = materialize(up, "labels")
    return up.join(up.toDF("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def tiles_of(entries: DataFrame) -> DataFrame:
    """(tile, cls, n, weight, degree): the shingles with the same classes as one tile, named by one of them.

    entries: distinct (token, cls, n). Shingles of one class make no tile.
    """
    place = F.xxhash64("cls")
    tokens = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum(place.bitwiseAND(F.lit((1 << 40) - 1))).alias("seal"), F.bit_xor(place).alias("seal2")).filter("m > 1")
    tiles = materialize(tokens.groupBy("m", "seal", "seal2").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight")).select("token", "weight", "m"), "tiles")
    rows = materialize(entries.join(tiles, "token").select(F.col("token").alias("tile"), "cls", "n", "weight", "m"), "tile-rows")
    degrees = rows.groupBy("cls").agg(F.sum(F.col("weight") * F.col("m")).alias("degree"))
    return materialize(rows.join(degrees, "cls").select("tile", "cls", "n", "weight", "degree"), "entries")


def tile_pairs(entries: DataFrame, bits: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of classes under different roots whose bitmaps allow a link, from size-banded tiles.

    entries: (tile, cls, n, root); bits: (cls, bits). Tiles of the same classes in a band are compared once, and a pair is
    made once, in the least tile that it shares in its band: each class brings its tiles before the one at hand.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-_log(percent / 100)) + F.lit(1e-9)).cast("int")
    rows = entries.withColumn("band", band).withColumn("place", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("place"))
    seal = F.xxhash64("cls")
    tiles = rows.groupBy("tile", "band").agg(F.count(F.lit(1)).alias("m"), F.min("place").alias("home"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum(seal.bitwiseAND(F.lit((1 << 40) - 1))).alias("seal"), F.bit_xor(seal).alias("seal2"))
    tiles = tiles.filter("home = 0 AND m > 1 AND r0 <> r1").groupBy("band", "m", "seal", "seal2").agg(F.min("tile").alias("tile"))
    tiles = materialize(tiles.select("tile", "band", F.ceil(F.col("m") / tile).cast("int").alias("blocks")), "tiles")
    rows = rows.join(tiles, ["tile", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    own = rows.groupBy("cls", "band").agg(F.array_sort(F.collect_list("tile")).alias("own"))
    rows = rows.join(own, ["cls", "band"]).withColumn("earlier", F.slice("own", F.lit(1), F.array_position("own", F.col("tile")).cast("int") - 1))
    # Block i meets each block j; the pair (i, j) is one group, named by the smaller and the larger.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.join(bits, "cls").select("tile", "band", "i", "j", "place", "block", "cls", "n", "root", "bits", "earlier")
    dealt = rows.repartition("tile", "band", "i", "j").sortWithinPartitions("tile", "band", "i", "j", "place", "n", "cls")

    def compare(group):
        import numpy as np

        cls, n, root, place, block = (np.array(group[c], np.int64) for c in ("cls", "n", "root", "place", "block"))
        if len(cls) < 2 or place[0] or (root == root[0]).all():
            return []
        words = [np.frombuffer(x, np.uint64) for x in group["bits"]]
        width = 64 * min(map(len, words))
        b = np.array([fold(x, width) for x in words])
        across = group["i"][0] != group["j"][0]
        out = []
        for x in range(int((place == 0).sum())):
            y = np.arange(x + 1, len(cls))
            y = y[(root[y] != root[x]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))]
            if across:
                y = y[block[y] != block[x]]
            if not len(y):
                continue
            most = np.minimum(n[x] - np.bitwise_count(b[x] & ~b[y]).sum(1, dtype=np.int64), n[y] - np.bitwise_count(b[y] & ~b[x]).sum(1, dtype=np.int64))
            y = y[100 * most >= percent * (n[x] + n[y] - most)]
            before = group["earlier"][x]
            out += [(min(cls[x], cls[k]), max(cls[x], cls[k])) for k in y if not len(np.intersect1d(before, group["earlier"][k], assume_unique=True))]
        return out

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ("cls", "n", "root", "place", "block", "bits", "i", "j", "earlier")
        key, group = None, {c: [] for c in names}

        def flush():
            pairs = sorted(set(compare(group)))
            return pa.RecordBatch.from_pydict({"a": pa.array([int(p[0]) for p in pairs], pa.int64()), "b": pa.array([int(p[1]) for p in pairs], pa.int64())})

        for batch in batches:
            columns = {c: batch[c].to_pylist() for c in names[:-1]}
            columns["earlier"] = np.split(batch["earlier"].flatten().to_numpy().copy(), np.cumsum(np.diff(batch["earlier"].offsets.to_numpy()))[:-1])
            keys = np.column_stack([batch[c].to_numpy() for c in ("tile", "band", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]]) if len(keys) else [0]
            for s, e in zip(starts[:-1], starts[1:]):
                if key is not None and tuple(keys[s]) != key:
                    if len(group["cls"]) > 1 and (found := flush()).num_rows:
                        yield found
                    group = {c: [] for c in names}
                key = tuple(keys[s])
                for c in names:
                    group[c] += columns[c][s:e]
        if len(group["cls"]) > 1 and (found := flush()).num_rows:
            yield found

    return dealt.mapInArrow(run, "a long, b long")


def size_allows(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """Whether sets of these sizes can link at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def hub_pairs(entries: DataFrame, roots: DataFrame, percent: int = PERCENT, hubs: int = HUBS) -> DataFrame:
    """Pairs (a, b) of a class and a hub under another root, at most `hubs` a class: those it shares most shingles with.

    A tile whose classes have different roots has up to `hubs` of them as hubs: those of highest degree, one a root.
    """
    visits = entries.join(roots, "cls")
    mixed_tiles = visits.groupBy("tile").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("tile")
    visits = materialize(visits.join(mixed_tiles, "tile"), "visits")
    heads = visits.groupBy("tile", "root").agg(F.max(F.struct("degree", "cls", "n")).alias("hub"))
    nth = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("hub")))
    heads = heads.withColumn("nth", nth).filter(F.col("nth") <= hubs).select("tile", F.col("root").alias("hub_root"), F.col("hub.cls").alias("b"), F.col("hub.n").alias("m"))
    met = visits.join(heads, "tile").filter((F.col("root") != F.col("hub_root")) & size_allows(F.col("n"), F.col("m"), percent))
    votes = met.groupBy(F.col("cls").alias("a"), "b").agg(F.sum("weight").alias("votes"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("votes"), "b"))
    pairs = votes.withColumn("best", best).filter(F.col("best") <= hubs)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _log(x: float) -> float:
    import math

    return math.log(x)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, heavy: int = HEAVY, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    often = bloom_of(tokens_of(prefixes(docs, Bloom(None, 0), percent), heavy))
    release(spark)
    sketch = materialize(prefixes(docs, often, percent, with_bits=True), "sketch")
    shared = bloom_of(tokens_of(sketch, 1))
    release(spark)
    rows = materialize(sketch.select("doc_id", "n", "cls"), "documents")
    entries = materialize(shared_entries(sketch, shared).distinct(), "token-entries")
    bits = materialize(sketch.select("cls", "n", "bits").join(entries.select("cls").distinct(), "cls", "left_semi").groupBy("cls", "n").agg(F.max("bits").alias("bits")), "bits")
    drop_table(sketch)
    release(spark)
    entries = tiles_of(entries)
    classes = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"))

    def exact(pairs: DataFrame) -> DataFrame:
        """The pairs that link, from the whole sets of just the classes among them."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        reps = classes.join(wanted, "cls").select(F.coalesce("rep", F.lit(0x7FFFFFFFFFFFFFF1)).alias("rep"))
        sets = materialize(sets_of(docs, _bloom_of_ids(reps)), "sets")
        release(spark)
        links = materialize(verified(pairs, sets, percent), "links")
        drop_table(sets)
        release(spark)
        return links

    roots = materialize(entries.select("cls", F.col("cls").alias("root")).distinct(), "roots")

    def bridges(links: DataFrame, roots: DataFrame) -> DataFrame:
        """The links (a, b) between classes as edges between their roots."""
        return links.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))

    def moved(roots: DataFrame, to: DataFrame) -> DataFrame:
        return materialize(roots.join(to.toDF("root", "to"), "root", "left").select("cls", F.coalesce("to", "root").alias("root")), "roots")

    # What is known to link is kept, so that rough labels do until the end.
    edges = None
    for _ in range(rounds):
        tries = materialize(possible(hub_pairs(entries, roots, percent), bits, percent), "tries")
        links = exact(tries)
        crossing = materialize(bridges(links, roots).distinct(), "bridges")
        edges = crossing if edges is None else edges.unionByName(crossing)
        roots = moved(roots, nearer(crossing))
        release(spark)

    rooted = entries.join(roots, "cls").select("tile", "cls", "n", "root")
    candidates = materialize(tile_pairs(rooted, bits.select("cls", "bits"), percent, tile), "candidates")
    release(spark)
    crossing = bridges(exact(candidates), roots)
    edges = crossing if edges is None else edges.unionByName(crossing)
    # A root that moved may be named in edges by its former name, to which its own edges lead.
    roots = moved(roots, components(edges))

    placed = materialize(classes.join(roots, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "component").select("cls", "component_id")
    return rows.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _bloom_of_ids(ids: DataFrame) -> Bloom:
    """The filter of document ids, by the hash that id_key() gives."""

    @tidied
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": id_key(batch["rep"].to_pylist()).view(np.int64)})

    return bloom_of(ids.mapInArrow(run, "key long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@pipeline_stage
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, with the least id in it, in the columns of documents.

    The join runs on row numbers in place of ids, which may be null or repeated.
    """
    rows, row = with_row(docs, "near-rows")
    near = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.col("doc_id").alias("_id")).join(near, row)
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", row)).alias("keep")).select(F.col("keep")[row].alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
