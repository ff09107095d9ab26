"""Brands and blocked domains from tables of any length, by equi-joins.

A dictionary entry is a phrase and a way it may stand in a text:

=========  ==============================================================
``words``  as whole words, anywhere
``begin``  its first words whole, its last one perhaps the beginning of a longer word, anywhere
``start``  at the start of the text
``whole``  as the text
=========  ==============================================================

The texts' own candidates are listed (stretches of words, and beginnings of the lengths that the
dictionary has) and joined with the phrases, so the work follows the texts and not texts times entries. Each
distinct text is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.brands import GENDER_WORDS, brand_texts
from pricelens.functions.urls import domain_suffixes, host_of
from pricelens.operators.lookup import lookup

ENTRIES = "entry INT, brand STRING, kind STRING, phrase STRING"
_WORD_OR_GAP = r"(?U)(\w+|\W+)"

# The phrases of BRAND_PATTERNS and how they stand, in the same order.
BRAND_PHRASES = [
    ("Jordan", "words", "jordan"),
    ("Nike", "words", "nike"),
    ("adidas", "words", "adidas"),
    ("HOKA", "words", "hoka"),
    ("New Balance", "words", "new balance"),
    ("New Balance", "start", "new-balance"),
    ("Asics", "words", "asics"),
    ("Brooks", "words", "brooks"),
    ("Saucony", "words", "saucony"),
    ("Puma", "words", "puma"),
    ("Under Armour", "words", "under armour"),
    ("Under Armour", "start", "under-armour"),
    ("Reebok", "words", "reebok"),
    ("Skechers", "words", "skechers"),
    ("Mizuno", "words", "mizuno"),
    ("Salomon", "words", "salomon"),
    ("On", "begin", "on cloud"),
    ("On", "words", "on running"),
    ("On", "start", "on-"),
    ("On", "whole", "on"),
]


def brand_dictionary(spark: SparkSession) -> DataFrame:
    """The known brands as a table; the entry with the least number wins."""
    return spark.createDataFrame([(n, *entry) for n, entry in enumerate(BRAND_PHRASES)], ENTRIES)


def _words_in(text: Column) -> Column:
    """The text cut into words and what stands between them, in turn."""
    return F.regexp_extract_all(text, F.lit(_WORD_OR_GAP), 1)


def _candidates(text: Column, parts: Column, most_words: int, lengths: dict[str, list[int]]) -> Column:
    """Everything in a text that an entry may be, as (kind, phrase)."""

    def entry(kind: str, phrase: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), phrase.alias("phrase"))

    is_word = lambda part: part.rlike(r"(?U)^\w")
    places = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: is_word(F.element_at(parts, i)))
    spans = F.flatten(
        F.transform(places, lambda i: F.transform(F.sequence(F.lit(0), F.lit(most_words - 1)), lambda n: F.struct(i.alias("i"), n.alias("n"))))
    )
    inside = F.filter(spans, lambda s: s["i"] + 2 * s["n"] <= F.size(parts))
    found = F.transform(inside, lambda s: entry("words", F.array_join(F.slice(parts, s["i"], 2 * s["n"] + 1), "")))
    kinds = [found]
    if lengths["begin"]:
        # The words before the last one, and as much of that as some entry has.
        ends = F.array(*[F.lit(n) for n in lengths["begin"]])
        cut = F.flatten(
            F.transform(
                inside,
                lambda s: F.transform(
                    F.filter(ends, lambda n: n <= F.length(F.element_at(parts, s["i"] + 2 * s["n"]))),
                    lambda n: entry(
                        "begin",
                        F.concat(
                            F.array_join(F.slice(parts, s["i"], 2 * s["n"]), ""), F.substring(F.element_at(parts, s["i"] + 2 * s["n"]), F.lit(1), n)
                        ),
                    ),
                ),
            )
        )
        kinds.append(cut)
    if lengths["start"]:
        starts = F.filter(F.array(*[F.lit(n) for n in lengths["start"]]), lambda n: n <= F.length(text))
        kinds.append(F.transform(starts, lambda n: entry("start", F.substring(text, F.lit(1), n))))
    # As for a pattern's end, a last line break does not count.
    kinds.append(F.array(entry("whole", text), entry("whole", F.regexp_replace(text, r"(\r\n|[\n\r\x85\u2028\u2029])\z", ""))))
    return F.array_distinct(F.concat(*kinds))


def _shape(entries: DataFrame) -> tuple[int, dict[str, list[int]]]:
    """The most words of a phrase, and the lengths of beginnings: a handful of numbers, whatever the table's length."""
    words = F.filter(_words_in(F.col("phrase")), lambda part: part.rlike(r"(?U)^\w"))
    last = F.length(F.element_at(words, -1))
    shape = entries.agg(
        F.coalesce(F.max(F.size(words)), F.lit(1)).alias("most"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "begin", last))).alias("begin"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "start", F.length("phrase")))).alias("start"),
    ).first()
    return max(shape.most, 1), {"begin": list(shape.begin), "start": list(shape.start)}


def with_brand(rows: DataFrame, name: Column, given: Column, url: Column, entries: DataFrame) -> DataFrame:
    """``rows`` with ``brand``: of the entries that stand in the name, the given brand or the URL words, the one with
    the least number; without one the given brand, unless it is a gender word. Phrases are in lower case, and
    their words are separated as in the texts."""
    most_words, lengths = _shape(entries)
    texts = brand_texts(name, given, url)
    keys = ["_name", "_given", "_words"]
    prepared = rows.select(*rows.columns, texts.alias("_texts")).select(
        *rows.columns, *[F.col(f"_texts.{k[1:]}").alias(k) for k in keys], F.col("_texts.fallback").alias("_fallback")
    )
    # Each distinct text once, whichever of the three it is, and then each distinct triple.
    triples = prepared.select(*keys).distinct()
    of_triple = triples.select(*keys, F.explode(F.array_distinct(F.array(*keys))).alias("text")).where("text <> ''")
    cut = of_triple.select("text").distinct().withColumn("parts", _words_in(F.col("text")))
    candidates = cut.select("text", F.inline(_candidates(F.col("text"), F.col("parts"), most_words, lengths)))
    best = entries.groupBy("kind", "phrase").agg(F.min(F.struct("entry", "brand")).alias("best"))
    by_text = lookup(candidates, best, ["kind", "phrase"]).where("best IS NOT NULL").groupBy("text").agg(F.min("best").alias("best"))
    by_triple = lookup(of_triple, by_text, ["text"]).where("best IS NOT NULL").groupBy(*keys).agg(F.min("best").alias("_best"))
    without = F.when(~F.col("_given").isin(GENDER_WORDS), F.col("_fallback"))
    found = lookup(prepared, by_triple, keys)
    return found.select(*rows.columns, F.coalesce(F.col("_best.brand"), without).alias("brand"))


def with_blocked(rows: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """``rows`` with ``blocked``: the URL's host is a ``domain`` of the table or lies below one. Text that is no URL, and
    no text, are not. Each distinct host is looked up once, by itself and its parents."""
    known = domains.select(F.lower("domain").alias("domain")).where("domain <> ''").distinct()
    hosted = rows.withColumn("_host", host_of(F.col(url)))
    hosts = hosted.select("_host").where("_host IS NOT NULL").distinct()
    parents = hosts.select("_host", F.explode(domain_suffixes(F.col("_host"))).alias("domain"))
    blocked = parents.join(known, "domain", "left_semi").select("_host").distinct().withColumn("_blocked", F.lit(True))
    return lookup(hosted, blocked, ["_host"]).select(*rows.columns, F.coalesce("_blocked", F.lit(False)).alias("blocked"))
