"""Secret scans: pattern spans, plus tokens that a battery of randomness tests takes for random; Spark expressions only.

Base spans come from three patterns (assign, access, hex). The method adds spans of kind "random": each run of 20 or
more key characters that overlaps no base span gets an inferred encoding (hex, base32, base64, base64url), its
characters' places in that alphabet, and three tests of uniform randomness with p-values:

- chi-squared of the places over 4 bins (8 from 40 characters on), by Wilson and Hilferty's normal approximation;
- Wald and Wolfowitz's runs above and below the alphabet's middle;
- serial correlation at lag 1.

The token's p is three times the least (at most 1). Tokens are discarded as ordinary by Benjamini and Hochberg's
procedure at level FDR, within length bands, since power grows with length: of what is thrown out, an expected share
of at most FDR is truly random. What isn't thrown out is reported. (So the bound is on secrets that are missed, as a share
of what is discarded, and not on false reports, whose share moves with the mix of the corpus.) Ranks come from a histogram of -ln p of all tokens
(at most BINS * bands rows), so that no sort of the corpus is needed; a bin counts by its upper edge.

Texts are read once; what goes on is spans and p-values. Edge cases: null text is the empty text (no spans, digest of
the empty string); positions are code points, ends exclusive; repeated rows, null ids and extra columns pass through
unharmed; without candidates nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import materialize, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: These greedy runs with a least length are the runs of any length that are long enough.
ACCESS, HEX, KEY = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
FDR, BINS, STEPS = 0.05, 1600, 16
#: Upper bounds of the length bands but for the last.
BANDS = (32, 48, 96)
DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str, kind: int) -> Column:
    """The matches of a pattern, leftmost and not overlapping, as structs of start, kind, end and the match.

    One walk over the matches and what stands before each adds up the positions.
    """
    none = F.array().cast(SPANS)

    def walk(hits: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, x: F.struct(F.char_length(gap).alias("gap"), x.alias("match")))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            end = start + F.char_length(x["match"])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"))
            return F.struct(end.alias("at"), F.array_append(a["spans"], span).alias("spans"))

        return F.when(F.size(hits) > 0, F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)


def free(keys: Column, base: Column) -> Column:
    """The keys that overlap no base span, by one walk over both in order of their starts."""
    none = F.array().cast(SPANS)
    nobody = F.element_at(F.array(F.lit(None).cast("struct<start:int,kind:int,end:int,match:string>")), 1)
    kept = lambda a: F.when(a["waits"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["waits"]))

    def step(a: Column, x: Column) -> Column:
        is_key = x["kind"] == KINDS.index("random")
        hit = a["waits"].isNotNull() & (x["start"] < a["waits"]["end"])
        return F.struct(
            F.when(is_key, a["upto"]).otherwise(F.greatest(a["upto"], x["end"])).alias("upto"),
            F.when(is_key, F.when(x["start"] >= a["upto"], x)).when(~hit, a["waits"]).alias("waits"),
            F.when(is_key, kept(a)).otherwise(a["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("upto"), nobody.alias("waits"), none.alias("out"))
    return F.when(F.size(base) == 0, keys).otherwise(F.aggregate(F.array_sort(F.concat(base, keys)), zero, step, kept))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by Abramowitz and Stegun's formula 26.2.17 (error below 1e-7 of 1), at least 1e-40."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) / 2.5066282746310002 * poly, F.lit(1e-40))


def two_sided(z: Column) -> Column:
    return F.least(2 * normal_tail(F.abs(z)), F.lit(1.0))


def randomness(token: Column) -> Column:
    """The p-value of a token's being uniformly random over its encoding's alphabet."""
    return let(F.regexp_replace(token, "=+$", ""), randomness_of)


def randomness_of(bare: Column) -> Column:
    """That p-value of a token without its padding."""
    folded = F.when(bare.rlike("^[0-9a-f]+$") | bare.rlike("^[0-9A-F]+$"), F.lower(bare)).otherwise(F.translate(bare, "-_=", "+//"))
    is_hex = bare.rlike("^[0-9a-f]+$") | bare.rlike("^[0-9A-F]+$")
    is_32 = bare.rlike("^[A-Z2-7]+$")
    alphabet = F.when(is_hex, DIGITS).when(is_32, BASE32).otherwise(BASE64)
    size = F.when(is_hex, 16.0).when(is_32, 32.0).otherwise(64.0)
    n = F.char_length(bare).cast("double")
    place = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.coalesce(F.instr(alphabet, c), F.lit(1)).cast("double") - 1)
    base = F.struct(place.alias("v"), size.alias("k"), n.alias("n"))
    total = lambda a, f=lambda x: x: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))

    def tests(b: Column) -> Column:
        v, k, n = b["v"], b["k"], b["n"]
        bins = F.when(n < 40, 4.0).otherwise(8.0)
        binned = F.transform(v, lambda x: F.floor(x * bins / k).cast("double"))
        counts = F.transform(F.sequence(F.lit(0), bins.cast("int") - 1), lambda i: F.size(F.filter(binned, lambda x: x == i.cast("double"))).cast("double"))
        chi, df = total(counts, lambda c: c * c) * bins / n - n, bins - 1
        p_chi = F.when(chi <= 0, 1.0).otherwise(
            F.when((w := (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))) >= 0, normal_tail(w)).otherwise(1 - normal_tail(-w))
        )
        high = F.transform(v, lambda x: (x >= k / 2).cast("double"))
        n1 = total(high)
        n0 = n - n1
        next_high = F.slice(high, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
        runs = 1 + total(F.zip_with(next_high, F.slice(high, F.lit(1), F.size(v) - 1), lambda a, b: F.abs(a - b)))
        mean = 2 * n1 * n0 / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when((n1 == 0) | (n0 == 0) | (spread <= 0), two_sided(F.sqrt(n))).otherwise(two_sided((runs - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))))
        off = let(total(v) / n, lambda m: F.transform(v, lambda x: x - m))
        next_off = F.slice(off, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
        lag = total(F.zip_with(next_off, F.slice(off, F.lit(1), F.size(v) - 1), lambda a, b: a * b))
        square = total(off, lambda x: x * x)
        p_serial = F.when(square <= 0, 1e-40).otherwise(two_sided((lag / F.greatest(square, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    return F.when(n < 16, 1e-40).otherwise(let(base, tests))


def band(length: Column) -> Column:
    out = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        out = F.when(length < BANDS[i], i).otherwise(out)
    return out


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, n_random, spans."""
    text = F.coalesce("text", F.lit(""))
    assigned = F.filter(found(text, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    both = F.struct(F.concat(assigned, found(text, ACCESS, 1), found(text, HEX, 2)).alias("base"), found(text, KEY, 3).alias("keys"))
    # Bound once: spans named inside a function of spans would be searched for anew at each of them.
    apart = let(both, lambda b: F.struct(F.transform(b["base"], lambda s: s.dropFields("match")).alias("base"), free(b["keys"], b["base"]).alias("keys")))
    judged = lambda k: F.struct(k["start"].alias("start"), k["kind"].alias("kind"), k["end"].alias("end"), band(k["end"] - k["start"]).alias("band"), F.least(F.floor(-F.log(randomness(k["match"])) * STEPS), F.lit(BINS)).cast("int").alias("bin"))
    rows = materialize(docs.select("doc_id", let(apart, lambda x: F.struct(x["base"].alias("base"), F.transform(x["keys"], judged).alias("keys"))).alias("x")).select("doc_id", "x.base", "x.keys"), "secrets")

    bins = rows.select(F.explode("keys").alias("k")).groupBy("k.band", "k.bin").agg(F.count(F.lit(1)).alias("n"))
    most = Window.partitionBy("band").orderBy(F.desc("bin"))
    ranked = bins.withColumn("rank", F.sum("n").over(most)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    cuts = ranked.filter(F.exp(-F.col("bin") / STEPS) <= fdr * F.col("rank") / F.col("all")).groupBy("band").agg(F.min("bin").alias("bin"))
    # One number for each band goes through the driver.
    limit = {r["band"]: r["bin"] for r in cuts.collect()}
    limits = F.array(*[F.lit(limit.get(i, BINS + 1)) for i in range(len(BANDS) + 1)])
    random = F.transform(F.filter("keys", lambda k: k["bin"] < F.element_at(limits, k["band"] + 1)), lambda k: k.dropFields("band", "bin"))
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        F.size(random).cast("long").alias("n_random"), written(F.concat("base", random)).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
