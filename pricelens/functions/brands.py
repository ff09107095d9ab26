"""Brand of a product from its name, the brand the retailer gave and its URL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.json_values import bind, strip

# Brand and pattern, in the order they are tried.
BRAND_PATTERNS = [
    ("Jordan", r"\bjordan\b"),
    ("Nike", r"\bnike\b"),
    ("adidas", r"\badidas\b"),
    ("HOKA", r"\bhoka\b"),
    ("New Balance", r"\bnew balance\b|^new-balance"),
    ("Asics", r"\basics\b"),
    ("Brooks", r"\bbrooks\b"),
    ("Saucony", r"\bsaucony\b"),
    ("Puma", r"\bpuma\b"),
    ("Under Armour", r"\bunder armour\b|^under-armour"),
    ("Reebok", r"\breebok\b"),
    ("Skechers", r"\bskechers\b"),
    ("Mizuno", r"\bmizuno\b"),
    ("Salomon", r"\bsalomon\b"),
    ("On", r"\bon cloud|\bon running\b|^on-|^on$"),
]

# Given "brands" that only name who the product is for.
GENDER_WORDS = ["men's", "mens", "women's", "womens", "unisex", "kids"]

# Fixed value: product path of a marketplace URL; the part before /dp/ holds the product's words.
SLUG_PATTERN = r"amazon\.com/([^/]+)/dp/"


def url_words(url: Column) -> Column:
    """Words of the product slug, ``''`` when the URL has none."""
    slug = F.regexp_extract(F.coalesce(url, F.lit("")), SLUG_PATTERN, 1)
    return F.replace(F.lower(slug), F.lit("-"), F.lit(" "))


def brand_texts(name: Column, given: Column, url: Column) -> Column:
    """What the patterns are tried on: a struct of the lower-case name, the lower-case given brand,
    the URL words, and the stripped given brand, which is NULL when none was given."""
    return F.struct(
        F.lower(F.coalesce(name, F.lit(""))).alias("name"),
        F.lower(strip(F.coalesce(given, F.lit("")))).alias("given"),
        url_words(url).alias("words"),
        F.when(given != "", strip(given)).alias("fallback"),
    )


#: A piece of a pattern that is a word or more between borders.
_PLAIN_PIECE = re.compile(r"(?:\\b|\^)*([a-z0-9' -]+)(?:\\b|\$)*")


def _words_of(pattern: str) -> list[str]:
    """Texts of which one must occur where the pattern matches; none if the pattern is not made of plain pieces."""
    pieces = [_PLAIN_PIECE.fullmatch(piece) for piece in pattern.split("|")]
    return [piece[1] for piece in pieces] if all(pieces) else []


def _occurs(text: Column, pattern: str) -> Column:
    """Whether the pattern matches in the text. Its words are searched for first, which costs much less."""
    found = text.rlike(f"(?U){pattern}")
    words = [text.contains(word) for word in _words_of(pattern)]
    if not words:
        return found
    some = words[0]
    for word in words[1:]:
        some = some | word
    return some & found


def brand_from(texts: Column, patterns: Sequence[tuple[str, str]] = BRAND_PATTERNS) -> Column:
    """First brand whose pattern occurs in the name, the given brand or the URL words.

    Without a match the given brand itself, unless it is a gender word. The dictionary becomes one
    CASE chain, so the lookup stays inside the projection. ``texts`` should be a column of its own
    (``brand_texts`` in an earlier select), so that it is computed once and not once per pattern.
    """
    name, given, words = texts["name"], texts["given"], texts["words"]
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for brand, pattern in patterns:
        found = (
            _occurs(name, pattern)
            | ((given != "") & _occurs(given, pattern))
            | ((words != "") & _occurs(words, pattern))
        )
        chain = chain.when(found, F.lit(brand))
    # Bound, because the chain as part of one generated method would be longer than the JVM compiles.
    return chain.otherwise(bind(texts["fallback"], lambda own: F.when(~given.isin(GENDER_WORDS), own)))


def brand_of(
    name: Column,
    given: Column,
    url: Column,
    patterns: Sequence[tuple[str, str]] = BRAND_PATTERNS,
) -> Column:
    """``brand_from`` on the texts of a name, a given brand and a URL."""
    return brand_from(brand_texts(name, given, url), patterns)
