"""Text, keyword and HTML queries over documents, pages and parts.

The driver's texts name no consoles, so the keyword queries use a dictionary of words that they do hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.functions import text as X
from lotwatch.operators import match as M
from lotwatch.operators.collection import inverted_index
from lotwatch.plans.base import Tables, query

STRONG, FRANCHISES, GENERIC = ("entre", "haste", "thing", "ention"), ("an ed", "onan"), ("the", "and", "les", "und")
TERMS = (*STRONG, *FRANCHISES, *GENERIC)
RISKS, POSITIVES = ("stea", "nder"), ("able", "tion", "ment", "keit")
SHADOWS = {"ention": ("entre",), "onan": ("thing",)}
RESTRICTED, ANCHORS = {"the": "article", "les": "article", "and": "joint", "und": "joint"}, ("the", "und")

_FOLD = "strip_accents(lower({0}))"
_SPACES = f"trim(regexp_replace({_FOLD.format('text')}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_NORM = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"


def _sql_list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _sql_hits(terms, text: str = "t") -> str:
    return rf"list_filter({_sql_list(terms)}, lambda k: regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_])' || replace(k, ' ', '\s+') || '([^\p{{L}}\p{{N}}_]|$)'))"


def _sql_flags(terms, text: str = "t") -> str:
    return f"list_filter({_sql_list(terms)}, lambda k: contains({text}, k))"


_SCORED = f"""
WITH d AS (SELECT doc_id, {_SPACES} AS t FROM documents),
h AS (SELECT doc_id, {_sql_hits(TERMS)} AS hits, {_sql_flags(RISKS)} AS risks, {_sql_flags(POSITIVES)} AS positives FROM d),
s AS (SELECT *, (6 * len(hits) + CASE WHEN list_has_any(hits, {_sql_list(STRONG)}) THEN 12 ELSE 0 END + CASE WHEN list_has_any(hits, {_sql_list(FRANCHISES)}) THEN 8 ELSE 0 END
  + CASE WHEN list_has_any(hits, {_sql_list(GENERIC)}) THEN 4 ELSE 0 END + least(2 * len(positives), 6) - 8 * len(risks))::INTEGER AS score FROM h)
"""


def scored_documents(docs: DataFrame) -> DataFrame:
    """doc_id, hits, risks, positives, score of the demonstration dictionary."""
    found = docs.select("doc_id", X.fold_spaces(F.col("text")).alias("t"))
    hits = found.select("doc_id", M.raw_hits(F.col("t"), TERMS).alias("hits"), M.flags(F.col("t"), RISKS).alias("risks"), M.flags(F.col("t"), POSITIVES).alias("positives"))
    score = M.match_score(F.col("hits"), F.col("risks"), F.col("positives"), strong=STRONG, franchises=FRANCHISES, generic=GENERIC)
    return hits.withColumn("score", score)


@query("slice_keyword_matches", _SCORED + "SELECT doc_id, array_to_string(hits, ',') AS hits, array_to_string(risks, ',') AS risks, array_to_string(positives, ',') AS positives, score FROM s WHERE len(hits) > 0")
def slice_keyword_matches(t: Tables) -> DataFrame:
    """Scan, match, flag, score and keep what matches: the auction watch end to end."""
    x = scored_documents(t.documents).filter(F.size("hits") > 0)
    return x.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("hits", "risks", "positives")], "score")


@query("math01_match_score", _SCORED + "SELECT doc_id, score FROM s")
def math01(t: Tables) -> DataFrame:
    return scored_documents(t.documents).select("doc_id", "score")


@query("srt09_match_order", _SCORED + "SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS place, doc_id, score FROM s WHERE len(hits) > 0 ORDER BY score DESC, doc_id LIMIT 50")
def srt09(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    best = scored_documents(t.documents).filter(F.size("hits") > 0).orderBy(F.desc("score"), "doc_id").limit(50)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("place"), "doc_id", "score")


@query("strf01_normalize", f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents")
def strf01(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize(F.col("text")).alias("normalized"))


@query("strf02_fold_spaces", f"SELECT doc_id, {_SPACES} AS folded FROM documents")
def strf02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.fold_spaces(F.col("text")).alias("folded"))


@query("strf03_slug", "SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(p_name || ' / ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def strf03(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("strf04_contains_term", f"WITH d AS (SELECT doc_id, {_NORM.format('text')} AS n FROM documents) SELECT doc_id, contains(' ' || n || ' ', ' of the ') AS has_two, contains(' ' || n || ' ', ' und ') AS has_one FROM d")
def strf04(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", X.normalize(F.col("text")).alias("n"))
    return d.select("doc_id", X.contains_term(F.col("n"), "Of the").alias("has_two"), X.contains_term(F.col("n"), "und").alias("has_one"))


_SIGNALS = ("onerth", "thing", "les", "und", "the")


@query("strf05_first_signal", f"WITH d AS (SELECT doc_id, {_NORM.format('text')} AS n FROM documents) SELECT doc_id, coalesce(list_filter({_sql_list(_SIGNALS)}, lambda k: contains(' ' || n || ' ', ' ' || k || ' '))[1], '') AS signal FROM d")
def strf05(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", X.normalize(F.col("text")).alias("n"))
    return d.select("doc_id", X.first_signal(F.col("n"), _SIGNALS).alias("signal"))


def _sql_class(classes, text: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(' ' || {text} || ' ', ' {X.py_normalize(s)} ')" for s in signals) + f" THEN '{name}'" for name, signals in classes.items())
    return f"CASE {whens} ELSE '' END"


_PIECES = ("japan", "pal", "usa", "sealed", "cib", "loose", "boxed", "not sealed")
_TITLE = f"p_name || ' ' || ({_sql_list(_PIECES)})[1 + p_partkey % 8] || ' ' || ({_sql_list(_PIECES)})[1 + (p_partkey // 8) % 8]"


def _titles(t: Tables) -> DataFrame:
    words = F.array(*map(F.lit, _PIECES))
    pick = lambda n: F.element_at(words, (1 + n % 8).cast("int"))
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", pick(F.col("p_partkey")), pick(F.floor(F.col("p_partkey") / 8))).alias("title"))


@query("strf06_region", f"WITH p AS (SELECT p_partkey, {_NORM.format(_TITLE)} AS n FROM part) SELECT p_partkey, {_sql_class(X.REGION_SIGNALS, 'n')} AS region FROM p")
def strf06(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", X.detect_region(F.col("title")).alias("region"))


@query("strf07_completeness", rf"WITH p AS (SELECT p_partkey, regexp_replace({_NORM.format(_TITLE)}, '\b(?:not|no|non)\s+(?:cib|sealed|boxed|complete)\b', ' ', 'g') AS n FROM part) SELECT p_partkey, {_sql_class(X.COMPLETENESS_SIGNALS, 'n')} AS completeness FROM p")
def strf07(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", X.detect_completeness(F.col("title")).alias("completeness"))


@query(
    "strf09_title_tokens",
    f"""WITH p AS (SELECT p_partkey, string_split(regexp_replace({_NORM.format("p_name || ' of the II ' || p_type || ' playstation ' || p_size")}, '\\b(playstation|ps) ([1-5])\\b', '\\1\\2', 'g'), ' ') AS w FROM part)
    SELECT p_partkey, array_to_string(list_transform(list_filter(w, lambda x: x <> '' AND NOT list_contains({_sql_list(X.TITLE_STOPWORDS)}, x)), lambda x: CASE x {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.ROMAN_NUMERALS.items())} ELSE x END), ' ') AS tokens FROM p""",
)
def strf09(t: Tables) -> DataFrame:
    title = F.concat(F.col("p_name"), F.lit(" of the II "), F.col("p_type"), F.lit(" playstation "), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.array_join(X.title_tokens(title), " ").alias("tokens"))


@query("strf17_lot_size", f"WITH p AS (SELECT p_partkey, p_name || ' lot of ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' with 5 games' ELSE '' END AS x FROM part) SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size <> 5 THEN NULL WHEN p_size BETWEEN 1 AND 500 THEN p_size END AS lot_size FROM p JOIN part USING (p_partkey)")
def strf17(t: Tables) -> DataFrame:
    title = F.concat(F.col("p_name"), F.lit(" lot of "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " with 5 games").otherwise(""))
    # Much work for few bytes: the rows are dealt out, as a small file would be one task's.
    return t.part.repartition("p_partkey").select("p_partkey", X.lot_size(title).alias("lot_size"))


@query("strf27_keyword_hits", f"WITH d AS (SELECT doc_id, {_SPACES} AS t FROM documents) SELECT doc_id, array_to_string({_sql_hits(TERMS)}, ',') AS hits FROM d")
def strf27(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(M.raw_hits(X.fold_spaces(F.col("text")), TERMS), ",").alias("hits"))


@query(
    "strf28_restricted_terms",
    f"""WITH d AS (SELECT doc_id, {_SPACES} AS t FROM documents), h AS (SELECT doc_id, {_sql_hits(TERMS)} AS hits FROM d),
    f AS (SELECT *, len(list_filter(hits, lambda k: NOT list_contains({_sql_list(RESTRICTED)}, k))) > 0 AS others,
      CASE WHEN list_has_any(hits, ['the', 'les']) THEN 1 ELSE 0 END + CASE WHEN list_has_any(hits, ['and', 'und']) THEN 1 ELSE 0 END AS families FROM h)
    SELECT doc_id, CASE WHEN others OR (families >= 2 AND list_has_any(hits, {_sql_list(ANCHORS)})) THEN array_to_string(hits, ',') ELSE '' END AS hits FROM f""",
)
def strf28(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", M.raw_hits(X.fold_spaces(F.col("text")), TERMS).alias("h"))
    return hits.select("doc_id", F.array_join(M.drop_restricted(F.col("h"), RESTRICTED, ANCHORS), ",").alias("hits"))


@query(
    "strf29_drop_shadowed",
    f"""WITH d AS (SELECT doc_id, {_SPACES} AS t FROM documents), h AS (SELECT doc_id, {_sql_hits(TERMS)} AS hits FROM d)
    SELECT doc_id, array_to_string(list_filter(hits, lambda k: NOT ((k = 'entre' AND list_contains(hits, 'ention')) OR (k = 'thing' AND list_contains(hits, 'onan')))), ',') AS hits FROM h""",
)
def strf29(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", M.raw_hits(X.fold_spaces(F.col("text")), TERMS).alias("h"))
    return hits.select("doc_id", F.array_join(M.drop_shadowed(F.col("h"), SHADOWS), ",").alias("hits"))


@query("strf30_flags", f"WITH d AS (SELECT doc_id, {_SPACES} AS t FROM documents) SELECT doc_id, array_to_string({_sql_flags(RISKS)}, ',') AS risks, array_to_string({_sql_flags(POSITIVES)}, ',') AS positives FROM d")
def strf30(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(M.flags(F.col("text"), RISKS), ",").alias("risks"), F.array_join(M.flags(F.col("text"), POSITIVES), ",").alias("positives"))


_STRIP = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'))".replace('\\"', '"')


@query("strf31_strip_html", f"SELECT page_id, {_STRIP} AS body, {_STRIP}[1:6000] AS preview FROM pages")
def strf31(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.strip_html(F.col("html")).alias("body"), X.strip_html(F.col("html"), X.PREVIEW).alias("preview"))


@query("strf32_html_fields", r"""SELECT page_id, regexp_extract(html, '<html\b[^>]*\slang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def strf32(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.tag_attribute(F.col("html"), "html", "lang").alias("lang"), X.tag_text(F.col("html"), "title").alias("title"))


@query("src23_page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS times FROM l GROUP BY 1, 2""")
def src23(t: Tables) -> DataFrame:
    """Objects embedded in pages, exploded and counted."""
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("times"))


@query("prj18_public_url", r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#\s]+') THEN url ELSE '' END AS public_url, regexp_extract(url, '^https?://([^/?#:\s]+)', 1) AS host FROM pages""")
def prj18(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.when(F.col("url").rlike(r"^https?://[^/?#\s]+"), F.col("url")).otherwise("").alias("public_url"), F.regexp_extract("url", r"^https?://([^/?#:\s]+)", 1).alias("host"))


@query("strf33_split_list", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ' , ') || ', ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def strf33(t: Tables) -> DataFrame:
    raw = F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit(" , ")), F.lit(", ,"))
    return t.part.select("p_partkey", F.array_join(X.split_list(raw), "|").alias("parts"))


@query("strf40_shorten", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(text[1:57], ' ') || '...' END AS short FROM documents")
def strf40(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.shorten(F.col("text"), 60).alias("short"))


@query("agg34_inverted_index", "WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS term FROM part) SELECT term, count(*) AS keys, min(p_partkey) AS first_key FROM w GROUP BY term")
def agg34(t: Tables) -> DataFrame:
    return inverted_index(t.part, "p_partkey", F.split("p_type", " "))


@query("flt19_rate_by_label", "SELECT l.toxic, count(*) AS docs, count(*) FILTER (contains(strip_accents(lower(d.text)), 'the')) AS marked, round(avg(d.n_chars), 2) AS mean_chars FROM labels l JOIN documents d USING (doc_id) GROUP BY l.toxic")
def flt19(t: Tables) -> DataFrame:
    """Rates per human label, as a calibration of the flags."""
    j = t.labels.join(t.documents, "doc_id")
    return j.groupBy("toxic").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.contains(X.fold(F.col("text")), F.lit("the"))).alias("marked"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))
