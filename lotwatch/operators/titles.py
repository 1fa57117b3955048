"""Which of a search's titles a listing names: a containment join over words.

A title is named where all its identifying words are in the listing's title. No listing meets all titles: sets are
reached through their rarest word only, so that a series' common words cost nothing while any rarer word is there, and
rows of a word that can't be avoided are dealt over SALTS tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions.text import compilation_words, title_tokens
from lotwatch.operators.rules import SEQUEL_NUMBERS, names_a_sequel

#: Tasks over which the texts of one word are dealt.
SALTS = 16


def containments(texts: DataFrame, words: str, sets: DataFrame, needed: str, by: Sequence[str]) -> DataFrame:
    """Pairs of rows of texts and sets, equal in `by`, where all `needed` words are among the text's `words`.

    Rows of texts and rows of sets are distinct; empty sets are contained in nothing. Columns of both, which have other
    names, and `by` once.
    """
    wanted = sets.select(*by, F.explode(F.array_distinct(needed)).alias("_word")).distinct()
    each = texts.withColumn("_word", F.explode(F.array_distinct(words))).join(wanted.hint("merge"), [*by, "_word"], "left_semi")
    counts = each.groupBy(*by, "_word").agg(F.count(F.lit(1)).alias("_n"))
    own = sets.withColumn("_word", F.explode(F.array_distinct(needed))).join(counts.hint("merge"), [*by, "_word"], "left")
    # A word that no text has rules its set out.
    rarest = own.groupBy(*sets.columns).agg(F.min_by("_word", F.struct("_n", "_word")).alias("_word"), F.count_if(F.col("_n").isNull()).alias("_lost"))
    keyed = rarest.filter("_lost = 0").drop("_lost").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = each.withColumn("_salt", F.pmod(F.xxhash64(words), F.lit(SALTS)).cast("int"))
    pairs = dealt.join(keyed.hint("merge"), [*by, "_word", "_salt"]).drop("_word", "_salt")
    return pairs.filter(F.size(F.array_except(needed, words)) == 0)


def parsed_names(targets: DataFrame, by: Sequence[str], target: str, name: str, aliases: str, position: str) -> DataFrame:
    """A row for each name of each target: by, target, _order, _core (words before the colon), _subtitle, _all.

    Targets without a name have no aliases either; names without a word before the colon are left out. _order is that
    of the targets, a target's own name before its aliases.
    """
    known = targets.filter(F.coalesce(F.col(name), F.lit("")) != "")
    every = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    each = known.select(*by, target, position, F.posexplode(every).alias("_alias", "_name"))
    halves = F.split(F.coalesce("_name", F.lit("")), ":", 2)
    cut = each.select(*by, target, F.struct(position, "_alias").alias("_order"), title_tokens(halves[0]).alias("_core"), title_tokens(F.get(halves, 1)).alias("_subtitle"))
    every = F.concat("_core", "_subtitle")
    return cut.filter(F.size("_core") > 0).withColumn("_all", F.array_distinct(every)).withColumn("_compiled", compilation_words(every))


def with_series(names: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """Adds _series: does another target of the search have a name with all words of this core?"""
    cores = names.filter(F.size("_subtitle") > 0).select(*by, F.array_sort(F.array_distinct("_core")).alias("_needed")).distinct()
    held = containments(names.select(*by, F.col(target).alias("_holder"), "_all").distinct(), "_all", cores, "_needed", by)
    # With the least and the greatest holder, whether there is one besides the own target needs no pairs of targets.
    holders = held.groupBy(*by, "_needed").agg(F.min("_holder").alias("_least"), F.max("_holder").alias("_most"))
    joined = names.withColumn("_needed", F.array_sort(F.array_distinct("_core"))).join(holders, [*by, "_needed"], "left")
    others = (F.col("_least") != F.col(target)) | (F.col("_most") != F.col(target))
    return joined.withColumn("_series", (F.size("_subtitle") > 0) & F.coalesce(others, F.lit(False))).drop("_needed", "_least", "_most")


def title_targets(titles: DataFrame, targets: DataFrame, by: Sequence[str], title: str, target: str, name: str, aliases: str, position: str) -> DataFrame:
    """The target that each distinct title names: by, title, target, shared (words) and core (words of its main part).

    A name is named by all words of its main part, with one of the subtitle's too where the main part is a series that
    another target has as well; or by the whole subtitle and a word of the main part. A number that makes it a sequel
    and a compilation that it isn't speak against it. The name with most shared words wins, then that with the longer
    main part, then the first. Titles that name none are left out. Nulls of `by` and of the title name nothing.
    """
    names = with_series(parsed_names(targets, by, target, name, aliases, position), by, target)
    texts = titles.filter(F.col(title).isNotNull()).select(*by, title).distinct().withColumn("_words", title_tokens(F.col(title)))
    words = F.col("_words")
    texts = texts.withColumn("_numbered", F.arrays_overlap(words, F.array(*map(F.lit, SEQUEL_NUMBERS)))).withColumn("_compiles", compilation_words(words))
    either = F.explode(F.array(F.struct(F.lit(True).alias("_whole"), F.col("_core").alias("_needed")), F.struct(F.lit(False).alias("_whole"), F.col("_subtitle").alias("_needed"))))
    sets = names.select("*", either.alias("_way")).select(*names.columns, "_way.*").filter(F.size("_needed") > 0)
    by_core, by_subtitle = ~F.col("_series") | F.arrays_overlap("_subtitle", "_words"), F.arrays_overlap("_core", "_words")
    found = containments(texts, "_words", sets, "_needed", by).filter(F.when(F.col("_whole"), by_core).otherwise(by_subtitle))
    # A compilation that the target isn't, or a number behind each mention that makes it a sequel.
    compiled = F.size(F.array_except("_compiles", "_compiled")) > 0
    sequel = F.col("_numbered") & F.coalesce(names_a_sequel(words, F.col("_core"), F.col("_subtitle")), F.lit(False))
    shared = F.size(F.array_intersect("_all", "_words"))
    best = F.min_by(F.struct(target, shared.alias("shared"), F.size("_core").alias("core")), F.struct(-shared, -F.size("_core"), "_order"))
    return found.filter(~compiled).filter(~sequel).groupBy(*by, title).agg(best.alias("_best")).select(*by, title, "_best.*")


def attributed(listings: DataFrame, targets: DataFrame, by: Sequence[str], title: str, target: str, name: str, aliases: str, position: str) -> DataFrame:
    """Every listing with its title's target, shared and core; null where it names none."""
    return listings.join(title_targets(listings, targets, by, title, target, name, aliases, position), [*by, title], "left")
