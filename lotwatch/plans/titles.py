"""Titles and platforms on stand-ins: lines named after parts, searches of brands, platforms that are words of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.functions import platforms as P
from lotwatch.functions import text as X
from lotwatch.operators import rules, titles
from lotwatch.plans.base import Tables, query

#: What follows a part's name and a number in a line's title, by the line's supplier.
ENDINGS = ("new", "discs", "disc only", "Collection", "from my collection", "of the ECONOMY", "STANDARD", "promo plate")
_ENDING = "([" + ", ".join(f"'{x}'" for x in ENDINGS) + "])[1 + l_suppkey % 8]"

_STOP = "'" + "','".join(X.TITLE_STOPWORDS) + "'"
_QUANTITY = "'" + "','".join(rules.QUANTITY_WORDS) + "'"
_KEPT = "'" + "','".join(X.COMPILATION_WORDS) + "'"


def _tokens(text: str) -> str:
    """title_tokens() of titles that have no apostrophes, Roman numerals or platforms."""
    return rf"list_filter(string_split(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"


_COMPILED = f"""list_filter(range(1, len({{0}}) + 1), lambda i: {{0}}[i] IN ({_KEPT}) AND NOT ({{0}}[i] IN ('collection', 'collections') AND i > 1 AND {{0}}[i - 1] IN ('my', 'personal', 'private')))"""
_JOIN12 = rf"""
WITH lines AS (SELECT l_orderkey, l_linenumber, (l_suppkey % 25 + 1)::INTEGER AS search, p_name || ' ' || l_linenumber || ' ' || {_ENDING} AS title FROM lineitem JOIN part ON l_partkey = p_partkey),
texts AS MATERIALIZED (SELECT search, title, {_tokens('title')} AS w FROM (SELECT DISTINCT search, title FROM lines)),
targets AS (SELECT replace(p_brand, 'Brand#', '')::INTEGER AS search, p_name || CASE WHEN p_size % 3 = 0 THEN ': ' || p_type ELSE '' END AS name, CASE WHEN p_size % 5 = 0 THEN reverse(p_name) || ' of ' || p_type ELSE p_name || ' Collection' END AS alias, min(p_partkey) AS target FROM part GROUP BY 1, 2, 3),
names AS (SELECT search, target, 0 AS a, name AS n FROM targets UNION ALL SELECT search, target, 1, alias FROM targets),
parsed AS MATERIALIZED (SELECT *, list_distinct(core || sub) AS every FROM (SELECT search, target, a, {_tokens("split_part(n, ':', 1)")} AS core, {_tokens("split_part(n, ':', 2)")} AS sub FROM names)),
series AS MATERIALIZED (SELECT p.*, len(sub) > 0 AND EXISTS (SELECT 1 FROM parsed o WHERE o.search = p.search AND o.target <> p.target AND list_has_all(o.every, p.core)) AS series FROM parsed p),
named AS (SELECT t.search, t.title, t.w, s.*, CASE WHEN list_has_all(w, sub) THEN core || sub ELSE core END AS nm FROM texts t JOIN series s ON s.search = t.search
  WHERE (list_has_all(w, core) AND (NOT series OR list_has_any(sub, w))) OR (len(sub) > 0 AND list_has_all(w, sub) AND list_has_any(core, w))),
ends AS (SELECT *, list_transform(list_filter(range(1, greatest(len(w) - len(nm) + 2, 2)), lambda i: w[i : i + len(nm) - 1] = nm), lambda i: i + len(nm)) AS e FROM named),
fits AS (SELECT * FROM ends WHERE NOT (NOT regexp_matches(nm[-1], '\d$') AND len(e) > 0 AND len(list_filter(e, lambda i: NOT (coalesce(w[i], '') IN ('2','3','4','5','6','7','8','9')
    AND CASE WHEN w[i + 1] IS NULL THEN true WHEN w[i + 1] = 'in' AND regexp_matches(coalesce(w[i + 2], ''), '^\d+$') THEN false
        WHEN w[i + 1] IN ({_QUANTITY}) THEN w[i + 1] IN ('disc', 'disk', 'cd') AND coalesce(w[i + 2], '') = 'only' ELSE true END))) = 0)
  AND len(list_filter({_COMPILED.format('w')}, lambda i: NOT list_contains(list_transform(core || sub, lambda c: replace(c, 'collections', 'collection')), replace(w[i], 'collections', 'collection')))) = 0),
best AS (SELECT search, title, target, len(list_intersect(every, w)) AS shared, len(core) AS core_words, row_number() OVER (PARTITION BY search, title ORDER BY len(list_intersect(every, w)) DESC, len(core) DESC, target, a) AS rn FROM fits)
SELECT l_orderkey, l_linenumber, lines.search, title, target, shared, core_words AS core FROM lines LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (search, title)
"""


@query("join12_title_targets", _JOIN12)
def join12(t: Tables) -> DataFrame:
    """Lines titled by their part, a number and an ending, each held against the titles that one brand's parts give."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (1 + F.col("l_suppkey") % 8).cast("int"))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 25 + 1).cast("int").alias("search"), F.concat_ws(" ", "p_name", "l_linenumber", ending).alias("title"))
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(": "), "p_type")).otherwise(""))
    alias = F.when(F.col("p_size") % 5 == 0, F.concat(F.reverse("p_name"), F.lit(" of "), "p_type")).otherwise(F.concat("p_name", F.lit(" Collection")))
    targets = t.part.groupBy(F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("search"), name.alias("name"), alias.alias("alias")).agg(F.min("p_partkey").alias("target"))
    targets = targets.select("search", "name", F.array("alias").alias("aliases"), "target", F.col("target").alias("place"))
    return titles.attributed(lines, targets, ["search"], "title", "target", "name", "aliases", "place")


#: Words and phrases of the texts as names of platforms, some within others and some that overlap.
STAND_INS = {"article": ("the", "les", "der", "los"), "pair": ("and the", "of the", "et les", "und der"), "joint": ("and", "und", "et"), "long": ("of the and", "the and of"), "and": ("the and",), "y": ("y", "de los")}


def _sql_keys(text: str) -> str:
    """Names replaced by marks in the order of their preference, then the marks in order of appearance."""
    out = f"(' ' || replace({text}, ' ', '  ') || ' ')"
    for phrase, key in P.Phrases(STAND_INS).ranked:
        out = f"replace({out}, ' {phrase.replace(' ', '  ')} ', ' #{key}# ')"
    return f"list_transform(regexp_extract_all({out}, '#([a-z]+)#', 1), lambda k: k)"


_NORM = "trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"
_KEYS = f"WITH k AS (SELECT doc_id, {_sql_keys(_NORM)} AS k FROM documents), f AS (SELECT doc_id, k, list_filter(range(1, len(k) + 1), lambda i: list_position(k, k[i]) = i) AS firsts FROM k) "


@query("strf13_platforms_in_text", _KEYS + "SELECT doc_id, array_to_string(list_transform(firsts, lambda i: k[i]), ',') AS platforms, len(k) AS mentions FROM f")
def strf13(t: Tables) -> DataFrame:
    """Platforms that a text names, in order, and how often it names any."""
    known = P.Phrases(STAND_INS)
    # A text that isn't there names nothing, not even no platform.
    found = t.documents.select("doc_id", F.when(F.col("text").isNotNull(), X.normalize(F.col("text"))).alias("n"))
    return found.select("doc_id", F.array_join(known.keys(F.col("n")), ",").alias("platforms"), F.size(known.found(F.col("n"))).cast("long").alias("mentions"))


_DECLARED = "([p.label, p.key, 'my ' || p.label || ' games', p.label || ' or saturn', 'Board  Games', NULL])[1 + s_suppkey % 6]"


@query(
    "strf14_platform_payload",
    "WITH p AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{p.key}', '{p.label}', '{p.family}', '{p.medium}', {len(p.requires)}, {p.key in P.phrases().key_of})" for i, p in enumerate(P.PLATFORMS))
    + f""") AS p(i, key, label, family, medium, n, self)),
    s AS (SELECT s_suppkey, s_suppkey % 6 AS c, p.*, {_DECLARED} AS declared FROM supplier JOIN p ON p.i = s_suppkey % {len(P.PLATFORMS)}),
    k AS (SELECT *, c IN (0, 2) OR (c = 1 AND self) OR (c = 3 AND key = 'saturn') AS known FROM s)
    SELECT s_suppkey, CASE WHEN known THEN key ELSE trim(regexp_replace(lower(coalesce(declared, '')), '[^a-z0-9]+', ' ', 'g')) END AS key,
      CASE WHEN known THEN label ELSE replace(coalesce(declared, ''), '  ', ' ') END AS label, CASE WHEN known THEN i ELSE {len(P.PLATFORMS)} END AS place,
      CASE WHEN c <= 3 THEN key ELSE 'ps2' END AS resolved, CASE WHEN c <= 3 THEN family ELSE 'home' END AS family, CASE WHEN c <= 3 THEN n ELSE 2 END AS needs FROM k""",
)
def strf14(t: Tables) -> DataFrame:
    """Platforms as suppliers might write them down, with what they stand for and what the title adds where they don't."""
    n = len(P.PLATFORMS)
    at = (1 + F.col("s_suppkey") % n).cast("int")
    label, key = (F.element_at(F.array(*[F.lit(getattr(p, c)) for p in P.PLATFORMS]), at) for c in ("label", "key"))
    written = F.array(label, key, F.concat(F.lit("my "), label, F.lit(" games")), F.concat(label, F.lit(" or saturn")), F.lit("Board  Games"), F.lit(None))
    s = t.supplier.select("s_suppkey", F.element_at(written, (1 + F.col("s_suppkey") % 6).cast("int")).alias("declared"), label.alias("label"))
    title = F.when(F.col("s_suppkey") % 6 == 3, F.concat(F.lit("Lot "), F.col("label"))).otherwise(F.lit("Sony PlayStation 2 slim and PSP"))
    s = s.select("s_suppkey", P.platform_payload(F.col("declared")).alias("p"), P.resolve_platform(F.col("declared"), title).alias("resolved"))
    return s.select("s_suppkey", "p.*", "resolved", P.platform_attribute(F.col("resolved"), "family").alias("family"), F.size(P.platform_attribute(F.col("resolved"), "requires")).alias("needs"))
