"""Reads of JSON values whose type varies from row to row.

Retailers send the same field as number, text, boolean, null, empty text or empty list. A *loose
value* is a struct of the value's ``text`` and the value itself as VARIANT (``json``). The text is
enough for nearly every rule; the VARIANT tells the few cases apart where it is not, such as the
number -5 from the text "-5". Its kind is looked at only then, because the text is much cheaper.

A field that is missing has no text and no VARIANT; a JSON null has a VARIANT but no text.

A cast of unreadable text to a number is an exception inside Spark, even where it ends as NULL, and
costs more than the rest of the row. So text is matched against a pattern before it is cast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_KINDS = r"^(BIGINT|DOUBLE|DECIMAL)"
PLAIN_NUMBER = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"
FLOAT_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
ZERO_NUMBER = r"^-?[0.]+$"

# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


#: How a JSON string begins in raw JSON that, read as text, looks like a list or an object; the last one stands
#: for the first character as an escape. A quote that ends a string is never followed by these.
STRING_LIKE_JSON = ['"[', '"{', '"\\u00']


def may_mislead(json: Column) -> Column:
    """Whether some string in the JSON may begin like a list or an object. Only then does telling them apart
    need the kinds, which cost a second parse. Plain searches, because a pattern costs more than the parse."""
    found = [json.contains(start) for start in STRING_LIKE_JSON]
    return found[0] | found[1] | found[2]


def read_fields(item: str, keys: Iterable[str]) -> Column:
    """The named fields of a JSON object, once as text and once as VARIANT.

    Only these keys are converted, and of a repeated key the last value counts. Select this as a
    column of its own before taking fields out of it, so that an item is parsed once.
    """
    keys = list(keys)
    return F.struct(
        F.from_json(item, text_struct(keys)).alias("text"),
        F.from_json(item, variant_struct(keys)).alias("json"),
    )


def text_struct(keys: Iterable[str]) -> str:
    """DDL that reads each key as text."""
    return ", ".join(f"`{key}` STRING" for key in keys)


def variant_struct(keys: Iterable[str]) -> str:
    """DDL that reads each key as VARIANT."""
    return ", ".join(f"`{key}` VARIANT" for key in keys)


def field(fields: Column, key: str) -> Column:
    """Loose value of one field of ``read_fields``."""
    return F.struct(fields["text"][key].alias("text"), fields["json"][key].alias("json"))


def text(value: Column) -> Column:
    """Text of a loose value; JSON text for lists and objects."""
    return value["text"]


def kind(value: Column) -> Column:
    """SQL type name of a loose value."""
    return F.schema_of_variant(value["json"])


def strip(value: Column) -> Column:
    """Text without leading and trailing white space of any sort (``trim`` removes spaces only)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def is_empty(value: Column) -> Column:
    """True for missing, null, empty text and the empty list; false for 0, false and ``{}``."""
    empty_list = (text(value) == "[]") & kind(value).startswith("ARRAY")
    return text(value).isNull() | (text(value) == "") | empty_list


def first_present(*values: Column) -> Column:
    """First loose value that is not empty."""
    return F.get(F.filter(F.array(*values), lambda value: ~is_empty(value)), F.lit(0))


def is_truthy(value: Column) -> Column:
    """False for every empty value and for 0, false and ``{}``; true otherwise."""
    nothing = text(value).isin("{}", "false") | text(value).rlike(ZERO_NUMBER)
    return ~is_empty(value) & ~(nothing & (kind(value) != "STRING"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    It also keeps the projection out of whole-stage code: with dozens of branches there the one
    generated method passes the size up to which the JVM compiles it, and runs interpreted.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read_digits(value: Column) -> Column:
    """DOUBLE from the digits and points of a text, NULL when they are no number."""
    return bind(
        F.regexp_replace(value, "[^0-9.]", ""),
        lambda digits: F.when(digits.rlike(PLAIN_NUMBER), digits.try_cast("double")),
    )


def to_number(value: Column) -> Column:
    """DOUBLE: a JSON number as it is, text by its digits and points, boolean and null as NULL.

    Text that keeps two points after the other characters are removed is no number, so
    ``"49.99 - $59.99"`` is NULL while ``"$10 - $20"`` is 1020.
    """
    signed = value["json"].isNotNull() & text(value).rlike(FLOAT_TEXT) & kind(value).rlike(NUMERIC_KINDS)
    as_it_is = text(value).rlike(PLAIN_NUMBER) | signed
    return F.when(as_it_is, text(value).try_cast("double")).otherwise(read_digits(text(value)))


def truncate_to_int(number: Column) -> Column:
    """INT without the fraction, NULL when out of range."""
    return number.try_cast("int")


def to_integer(value: Column) -> Column:
    """INT: ``to_number`` with the fraction cut off."""
    return truncate_to_int(to_number(value))


def to_boolean(value: Column) -> Column:
    """BOOLEAN: null stays NULL; true, 1 and yes in any case are true; all else is false."""
    return F.lower(strip(text(value))).isin("true", "1", "yes")


def research_number(value: Column) -> Column:
    """DOUBLE from a number, a boolean or text that is a number as a whole; nothing is stripped."""
    truth = F.when(kind(value) == "BOOLEAN", F.when(text(value) == "true", 1.0).otherwise(0.0))
    return F.when(text(value).rlike(FLOAT_TEXT), F.trim(text(value)).try_cast("double")).otherwise(truth)


def research_integer(value: Column) -> Column:
    """INT from a number (fraction cut off), a boolean or whole-number text; ``"4.0"`` is NULL."""
    whole_text = text(value).rlike(INTEGER_TEXT)
    number = F.when(whole_text | (kind(value) != "STRING"), research_number(value))
    return truncate_to_int(number)
