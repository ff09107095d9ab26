"""Rows, claims and citations of research runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricelens.functions.claims import ROW_PATH, claim_row, high_share
from pricelens.functions.json_values import (
    NUMERIC_KINDS,
    STRING_LIKE_JSON,
    bind,
    field,
    is_empty,
    kind,
    read_fields,
    research_integer,
    research_number,
    text,
    text_struct,
    variant_struct,
)
from pricelens.functions.urls import is_blocked
from pricelens.schemas import EARNINGS_DDL, REVIEWS_DDL

_CONTENT = "output STRUCT<content: STRING, trust: STRUCT<confidence: STRING>>"
_CLAIM_TEXTS = "output STRUCT<trust: STRUCT<claims: ARRAY<STRING>>>"
_CLAIM = "STRUCT<path: STRING, confidence: STRING, citations: ARRAY<STRUCT<url: STRING>>>"
_CLAIMS = f"output STRUCT<trust: STRUCT<claims: ARRAY<{_CLAIM}>>>"
_TEXTS = "array<string>"


def members_of(content: Column) -> Column:
    """Texts of an object's members, NULL for anything else. Better a column of its own, as it is used several times."""
    return F.when(content.startswith("{"), F.map_values(F.from_json(content, "MAP<STRING, STRING>")))


def envelope_rows(content: Column, kinds: Column | None = None, members: Column | None = None) -> Column:
    """Rows of an envelope's content, as an array of JSON texts.

    A list is the rows. An object gives its first list-valued member in document order, or is itself
    the one row. Anything else gives none. ``kinds`` is the content as VARIANT, where a string in it
    looks like a list or an object: a string is neither. Where it is NULL the texts are taken at sight.
    """
    kinds = F.lit(None).cast("variant") if kinds is None else kinds
    members = members_of(content) if members is None else members
    member_kinds = F.map_values(F.try_variant_get(kinds, "$", "map<string, variant>"))
    names = F.json_object_keys(content)
    kind_names = F.map_keys(F.try_variant_get(kinds, "$", "map<string, variant>"))

    def is_text(name: Column) -> Column:
        found = F.get(member_kinds, (F.array_position(kind_names, name) - 1).cast("int"))
        return F.coalesce(F.schema_of_variant(found) == "STRING", F.lit(False))

    lists = F.filter(
        F.transform(
            members,
            lambda member, at: F.when(
                member.startswith("[") & (kinds.isNull() | ~is_text(F.get(names, at))), _as_list(member)
            ),
        ),
        lambda rows: rows.isNotNull(),
    )
    a_text = F.coalesce(F.schema_of_variant(kinds) == "STRING", F.lit(False))
    return (
        F.when(content.startswith("[") & ~a_text, _as_list(content))
        .when(
            content.startswith("{") & members.isNotNull() & ~a_text,
            F.coalesce(F.get(lists, F.lit(0)), F.array(content)),
        )
        .otherwise(F.array().cast(_TEXTS))
    )


def _as_list(value: Column) -> Column:
    return F.from_json(value, "ARRAY<STRING>")


def run_result(runs: DataFrame) -> DataFrame:
    """One row per researched item from ``run_id``, ``status`` and ``envelope`` (JSON text).

    Each row has its index, its JSON, the run's confidence, its distinct cited URLs in first-seen
    order, the share of its graded claims that are graded high, and its claims as JSON. A run that
    has not completed is one row with its status and NULLs; a completed run without rows gives none.

    Claims find their row without comparing all claims with all rows: the claims are sorted by row
    index together with one marker per row, so each row's claims are the slice behind its marker.
    All of it happens inside the envelope's own row; nothing is shuffled. The rows and what the claims
    say of them are columns of their own until the rows are opened, and the claims and their texts are
    parses of their own, so that whoever reads the rows alone pays for neither, and whoever reads the sources
    or shares does not pay for the texts. Claims of an envelope without rows are not parsed, and of a claim about
    no row only the path is looked at. Claims among which some are no objects do not read as a list of
    structs; only then those that are objects are read from their texts.
    """
    kept = [name for name in runs.columns if name != "envelope"]
    output, completed = F.col("output"), F.col("status").eqNullSafe("completed")
    parsed = runs.select(
        *kept, "envelope", F.when(completed, F.from_json("envelope", _CONTENT)["output"]).alias("output")
    )
    variant = F.try_variant_get(F.try_parse_json("envelope"), "$.output.content", "variant")
    located = parsed.select(
        *kept,
        "envelope",
        output["trust"]["confidence"].alias("confidence"),
        output["content"].alias("content"),
        F.when(_unclear(output["content"], F.col("envelope")), variant).alias("kinds"),
        members_of(output["content"]).alias("members"),
    )
    items = F.coalesce(envelope_rows(F.col("content"), F.col("kinds"), F.col("members")), F.array().cast(_TEXTS))
    opened = located.select(
        *kept,
        "envelope",
        "confidence",
        F.when(completed, items).otherwise(F.array(F.lit(None).cast("string"))).alias("items"),
    )
    # Parsed claims are bound to a name and not made a column, which Spark would write as a row and read from it slowly.
    has_rows = completed & (F.size("items") > 0)
    looked_at = opened.select(
        *kept,
        "envelope",
        "confidence",
        "items",
        F.when(has_rows, bind(_claims("envelope", _CLAIMS), _looked_at)).alias("looked"),
    )
    texts = _claims("envelope", _CLAIM_TEXTS)
    objects = F.coalesce(F.filter(texts, lambda claim: claim.startswith("{")), F.array().cast(_TEXTS))
    told_apart = looked_at.select(
        *kept,
        "envelope",
        "confidence",
        "items",
        "looked",
        F.when(has_rows & F.col("looked")["places"].isNull(), objects).alias("mixed_texts"),
    )
    from_texts = F.from_json(_json_list(F.col("mixed_texts")), f"ARRAY<{_CLAIM}>")
    placed = told_apart.select(
        *kept,
        "envelope",
        "confidence",
        "items",
        "mixed_texts",
        F.when(F.col("mixed_texts").isNull(), F.col("looked")).otherwise(bind(from_texts, _looked_at)).alias("looked"),
    )
    claim_texts = F.coalesce("mixed_texts", texts)
    told = placed.select(
        *kept,
        "confidence",
        "items",
        F.col("looked")["told"].alias("told"),
        F.when(
            has_rows, bind(claim_texts, lambda known: _per_row(F.col("looked")["places"], known, _json_list))
        ).alias("texts"),
    )
    # The outer form, because for the plain one Spark evaluates all of the above a second time, in a
    # filter on the size of the list. Completed runs without rows are dropped here instead.
    exploded = told.select(
        *kept, "confidence", "told", "texts", F.posexplode_outer("items").alias("at", "item_json")
    ).filter("at IS NOT NULL")
    return exploded.select(
        *kept,
        F.when(completed, F.col("confidence")).alias("confidence"),
        F.when(completed, F.col("at")).alias("item_index"),
        "item_json",
        F.get("told", F.col("at"))["sources"].alias("source_urls"),
        F.get("told", F.col("at"))["share"].alias("high_confidence_share"),
        F.get("texts", F.col("at")).alias("claims_json"),
    )


def _claims(envelope: str, schema: str) -> Column:
    return F.from_json(envelope, schema)["output"]["trust"]["claims"]


def _unclear(content: Column, envelope: Column) -> Column:
    """Whether the content, read as text, may be a string that looks like a list or an object, or an object with a
    string member that looks like a list. A quote inside a JSON string stands behind a backslash, so an envelope
    without one holds no string with quotes; that search is much cheaper than those for how a string begins."""

    def is_text(first: str) -> Column:
        begins = envelope.contains(f'"{first}') | envelope.contains(STRING_LIKE_JSON[-1])
        return (~content.contains('"') | envelope.contains("\\")) & begins

    return F.when(content.startswith("["), is_text("[")).when(
        content.startswith("{"), content.contains('"[') | is_text("{")
    )


#: Sorted together, a claim is its row and its number from 1 on, and a marker is its row and 0.
_ROW = 1 << 32


def _looked_at(claims: Column) -> Column:
    """Where the claims of each row of ``items`` are, and what they tell of the row. Both are NULL without claims."""
    return bind(
        _places(claims),
        lambda places: F.struct(places.alias("places"), _per_row(places, claims, _told).alias("told")),
    )


def _places(claims: Column) -> Column:
    """The claims sorted by the row they are about, each row behind its marker, and where the markers are. One more
    marker stands behind all rows; claims about none of them follow it."""
    rows = F.size("items")
    indexes = F.transform(claims["path"], lambda path: F.regexp_extract(path, ROW_PATH, 1))

    def place(index: Column, at: Column) -> Column:
        row = F.least(F.when(index != "", index.try_cast("int")), rows)
        return row.cast("long") * _ROW + at + 1

    def marked(places: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda at: _number(F.get(places, at)) == 0)
        return F.when(places.isNotNull(), F.struct(places.alias("claims"), found.alias("markers")))

    markers = F.sequence(F.lit(0).cast("long"), rows.cast("long") * _ROW, F.lit(_ROW))
    return bind(F.sort_array(F.concat(markers, F.transform(indexes, place))), marked)


def _number(place: Column) -> Column:
    return place.bitwiseAND(F.lit(_ROW - 1))


def _per_row(places: Column, values: Column, use: Callable[[Column], Column]) -> Column:
    """For each row ``use`` of the values of its claims. ``values`` has one for each claim, under a name: an expression
    in the body of a transform is computed again for each element."""

    def of_row(marker: Column, row: Column) -> Column:
        own = F.slice(places["claims"], marker + 2, F.get(places["markers"], row + 1) - marker - 1)
        return use(F.transform(own, lambda place: F.get(values, _number(place).cast("int") - 1)))

    return F.transform(places["markers"], of_row)


def _told(claims: Column) -> Column:
    """The distinct cited URLs of a row's claims in first-seen order, and the share of graded claims graded high."""

    def of(own: Column) -> Column:
        cited = F.coalesce(F.flatten(own["citations"]), F.flatten(F.array_compact(own["citations"])))
        urls = F.array_except(cited["url"], F.array(F.lit(""), F.lit(None)))
        graded = F.filter(own["confidence"], lambda grade: grade != "")
        return F.struct(urls.alias("sources"), bind(graded, _share).alias("share"))

    return bind(claims, of)


def _share(graded: Column) -> Column:
    return high_share(F.size(graded) - F.size(F.array_remove(graded, "high")), F.size(graded))


def _json_list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def claim_match(claims: DataFrame) -> DataFrame:
    """Per row of a run: its claims, their grades and how many distinct URLs they cite.

    ``claims`` holds one row per claim (``run_id``, ``path``, ``confidence``, ``url``), for claims
    that are merged from many envelopes. The row index comes out of the path, so finding the row is
    grouping by it, with partial sums before the shuffle.
    """
    graded = F.when(F.col("confidence") != "", F.col("confidence"))
    cited = F.when(F.col("url") != "", F.col("url"))
    return (
        claims.select("run_id", claim_row(F.col("path")).alias("item_index"), graded.alias("grade"), cited.alias("url"))
        .filter(F.col("item_index").isNotNull())
        .groupBy("run_id", "item_index")
        .agg(
            F.count(F.lit(1)).alias("claims"),
            F.count("grade").alias("graded"),
            F.count_if(F.col("grade") == "high").alias("high"),
            F.countDistinct("url").alias("sources"),
        )
    )


def high_confidence_share(claims: DataFrame) -> DataFrame:
    """Share of high grades per row of a run, NULL where nothing is graded."""
    return claim_match(claims).select(
        "run_id", "item_index", high_share(F.col("high"), F.col("graded")).alias("high_confidence_share")
    )


def row_sources(claims: DataFrame) -> DataFrame:
    """Distinct cited URLs per row of a run, one row each, with the claim that cites it first.

    ``first_seen`` orders the URLs as they were met. One row per URL instead of one list per row: a
    row with very many citations stays spread over tasks.
    """
    return (
        claims.select("run_id", claim_row(F.col("path")).alias("item_index"), "url", "claim_pos")
        .filter(F.col("item_index").isNotNull() & (F.col("url") != ""))
        .groupBy("run_id", "item_index", "url")
        .agg(F.min("claim_pos").alias("first_seen"))
    )


def flag_blocked_sources(df: DataFrame, url: str, domains: Sequence[str]) -> DataFrame:
    """Adds ``blocked``: the URL's host is one of ``domains`` or lies below one."""
    return df.withColumn("blocked", is_blocked(F.col(url), domains))


_MATCHES = {
    "string": lambda k: k == "STRING",
    "number": lambda k: k.rlike(NUMERIC_KINDS),
    "integer": lambda k: k.rlike(r"^BIGINT$|^DECIMAL\([0-9]+,0\)$"),
    "array": lambda k: k.startswith("ARRAY"),
    "boolean": lambda k: k == "BOOLEAN",
    "null": lambda k: k == "VOID",
}


def validate_rows(df: DataFrame, spec: Mapping, item: str = "item_json") -> DataFrame:
    """Adds ``violations``: what in each row's JSON breaks the spec, empty when nothing does.

    The spec names the required fields and the JSON types each field may have.
    """
    fields = F.col("_fields")
    parsed = df.withColumn("_fields", F.from_json(item, variant_struct(spec["types"])))

    def check(name: str, types: Sequence[str], kind: Column) -> Column:
        allowed = F.lit(False)
        for json_type in types:
            allowed = allowed | _MATCHES[json_type](kind)
        wrong = F.when(kind.isNotNull() & ~allowed, F.lit(f"type of {name}"))
        return wrong.when(kind.isNull(), F.lit(f"missing {name}")) if name in spec["required"] else wrong

    # The kind of a field is bound to a name, as it is looked at several times.
    checks = [bind(F.schema_of_variant(fields[name]), partial(check, name, types)) for name, types in spec["types"].items()]
    return parsed.withColumn("violations", F.array_compact(F.array(*checks))).drop("_fields")


def type_earnings(rows: DataFrame, loaded_at: Column) -> DataFrame:
    """Earnings rows of ``run_result`` in the columns of the earnings table.

    Kept are rows with a company and with some revenue in the JSON; a revenue that is no number
    passes that test and becomes NULL, as does a quarter end that is no date.
    """
    texts = ["company", "ticker", "fiscal_quarter_label", "currency", "source_url", "source_type"]
    numbers = ["revenue_millions", "revenue_growth_yoy_pct", "gross_margin_pct", "operating_income_millions"]
    raw, read, names = F.col("raw"), F.col("_texts"), [*texts, *numbers, "quarter_end_date"]
    # Kinds tell a list from its text and a boolean from its; no other value needs the second parse.
    unclear = read["company"] == "[]"
    for name in numbers:
        unclear = unclear | F.coalesce(read[name].isin("true", "false"), F.lit(False))
    kinds = F.when(unclear, F.from_json("item_json", variant_struct(names)))
    parsed = (
        rows.withColumn("_texts", F.from_json("item_json", text_struct(names)))
        .withColumn("raw", F.struct(read.alias("text"), kinds.alias("json")))
        .filter(~is_empty(field(raw, "company")) & text(field(raw, "revenue_millions")).isNotNull())
    )
    columns = {name: text(field(raw, name)) for name in texts}
    columns |= {name: research_number(field(raw, name)) for name in numbers}
    columns |= _citation_columns(loaded_at)
    columns["quarter_end_date"] = text(field(raw, "quarter_end_date")).try_cast("date")
    order = _columns_of(EARNINGS_DDL)
    return parsed.select(*[columns[name].alias(name) for name in order])


def type_reviews(rows: DataFrame, loaded_at: Column) -> DataFrame:
    """Review rows of ``run_result`` in the columns of the review table; missing lists are empty."""
    texts = ["brand", "model", "category", "retailer", "product_url"]
    lists = ["top_praise", "top_complaints"]
    raw = F.col("raw")

    def phrases(value: Column) -> Column:
        is_list = text(value).startswith("[") & kind(value).startswith("ARRAY")
        known = F.when(is_list, F.from_json(text(value), "ARRAY<STRING>"))
        return F.coalesce(known, F.array().cast(_TEXTS))

    columns = {name: text(field(raw, name)) for name in texts}
    columns |= {name: research_number(field(raw, name)) for name in ("rating", "price_usd")}
    columns |= {"review_count": research_integer(field(raw, "review_count"))}
    columns |= {name: phrases(field(raw, name)) for name in lists}
    columns |= _citation_columns(loaded_at)
    order = _columns_of(REVIEWS_DDL)
    return (
        rows.filter(F.col("item_json").isNotNull())
        .withColumn("raw", read_fields("item_json", [*texts, "rating", "review_count", "price_usd", *lists]))
        .select(*[columns[name].alias(name) for name in order])
    )


def _columns_of(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names


def _citation_columns(loaded_at: Column) -> dict[str, Column]:
    return {
        "source_urls": F.col("source_urls"),
        "high_confidence_share": F.col("high_confidence_share"),
        "claims_json": F.col("claims_json"),
        "run_confidence": F.col("confidence"),
        "run_id": F.col("run_id"),
        "loaded_at": loaded_at,
    }
