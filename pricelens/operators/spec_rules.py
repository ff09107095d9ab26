"""Checks compiled from the JSON specification of a researched row.

The specification says of each value which JSON types it may have, of an object its properties and which
of them are required, of a list what its items are, and of any value which constants it may be. It is
read as text, from a file or a table, and compiled to one expression over the row as VARIANT, whatever the
nesting: objects become paths, lists a transform over their items. A violation names its path.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.json_values import NUMERIC_KINDS, bind

_KINDS = {
    "string": lambda k: k == "STRING",
    "number": lambda k: k.rlike(NUMERIC_KINDS),
    "integer": lambda k: k.rlike(r"^BIGINT$|^DECIMAL\([0-9]+,0\)$"),
    "array": lambda k: k.startswith("ARRAY"),
    "object": lambda k: k.startswith("OBJECT"),
    "boolean": lambda k: k == "BOOLEAN",
    "null": lambda k: k == "VOID",
}


def _one_of(constants: list[Any], value: Column, kind: Column) -> Column:
    """Whether a value is one of the constants, which may be texts, numbers, truth values or null."""
    out = F.lit(False)
    for constant in constants:
        if constant is None:
            same = kind == "VOID"
        elif isinstance(constant, bool):
            same = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == constant)
        elif isinstance(constant, (int, float)):
            same = kind.rlike(NUMERIC_KINDS) & (F.try_variant_get(value, "$", "double") == float(constant))
        else:
            same = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == str(constant))
        out = out | F.coalesce(same, F.lit(False))
    return out


def _member(name: str) -> str:
    """Path of an object's member, whatever its name holds but a quote of both kinds."""
    return f"$['{name}']" if "'" not in name else f'$["{name}"]'


def _allowed(types: list[str], kind: Column) -> Column:
    allowed = F.lit(False)
    for t in types:
        allowed = allowed | _KINDS[t](kind)
    return allowed


def _checks(spec: Mapping, value: Column, kind: Column, path: Column) -> list[tuple[bool, Column]]:
    """Violations of a value that is there, each with whether it is a list of them; a value that is not (NULL, as is
    its kind) has none. The kind is a name, not an expression: it is asked for once and looked at often."""
    out = []
    types = _types(spec)
    if types:
        out.append((False, F.when(kind.isNotNull() & ~_allowed(types, kind), F.concat(F.lit("type of "), path))))
    if "enum" in spec:
        out.append((False, F.when(value.isNotNull() & ~_one_of(list(spec["enum"]), value, kind), F.concat(F.lit("value of "), path))))
    properties = spec.get("properties", {})
    for name in [*properties, *[n for n in spec.get("required", []) if n not in properties]]:
        out += _member_checks(name, properties.get(name, {}), name in spec.get("required", []), value, kind, path)
    if "items" in spec and _has_checks(spec["items"]):
        items = F.when(_KINDS["array"](kind), F.try_variant_get(value, "$", "array<variant>"))

        def of_item(item: Column, at: Column) -> Column:
            below = F.concat(path, F.lit("["), at.cast("string"), F.lit("]"))
            return bind(_with_kind(item), lambda m: _joined(_checks(spec["items"], m["value"], m["kind"], below)))

        out.append((True, F.coalesce(F.flatten(F.transform(items, of_item)), F.array().cast("array<string>"))))
    return out


def _member_checks(name: str, spec: Mapping, required: bool, value: Column, kind: Column, path: Column) -> list[tuple[bool, Column]]:
    member = F.try_variant_get(value, _member(name), "variant")
    below = F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
    missing = _KINDS["object"](kind) if required else F.lit(False)

    def of_kind(own: Column) -> Column:
        wrong = F.when(own.isNull() & missing, F.concat(F.lit("missing "), below))
        types = _types(spec)
        return wrong.when(own.isNotNull() & ~_allowed(types, own), F.concat(F.lit("type of "), below)) if types else wrong

    if not any(spec.get(key) for key in ("enum", "properties", "required", "items")) and "enum" not in spec:
        return [(False, bind(F.schema_of_variant(member), of_kind))] if required or _types(spec) else []

    def of_member(m: Column) -> Column:
        absent = [(False, F.when(m["kind"].isNull() & missing, F.concat(F.lit("missing "), below)))] if required else []
        return _joined([*absent, *_checks(spec, m["value"], m["kind"], below)])

    return [(True, bind(_with_kind(member), of_member))]


def _types(spec: Mapping) -> list[str]:
    types = spec.get("type", [])
    types = [types] if isinstance(types, str) else list(types)
    unknown = [t for t in types if t not in _KINDS]
    if unknown:
        raise ValueError(f"unknown JSON types: {', '.join(unknown)}")
    return types


def _with_kind(value: Column) -> Column:
    return F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind"))


def _joined(checks: list[tuple[bool, Column]]) -> Column:
    """One list of all violations, with NULLs between them. Neighbours that are no lists become one."""
    lists: list[Column] = []
    for is_list, group in itertools.groupby(checks, lambda check: check[0]):
        columns = [column for _, column in group]
        lists += columns if is_list else [F.array(*columns)]
    return F.concat(*lists) if lists else F.array().cast("array<string>")


def _has_checks(spec: Mapping) -> bool:
    return any(spec.get(key) for key in ("type", "enum", "properties", "required", "items"))


def violations(spec: Mapping, value: Column) -> Column:
    """What in a VARIANT value breaks the specification, as texts with paths; empty when nothing does, and for NULL."""
    if not _has_checks(spec):
        return F.array().cast("array<string>")
    return bind(_with_kind(value), lambda m: F.array_compact(_joined(_checks(spec, m["value"], m["kind"], F.lit("")))))


def row_spec(text: str) -> dict:
    """The specification of one row from that of an agent: its ``output_schema`` lists rows, whose ``items`` it is."""
    spec = json.loads(text)
    spec = spec.get("output_schema", spec)
    return spec["items"] if spec.get("type") == "array" else spec


def specs_from_files(spark: SparkSession, path: str) -> DataFrame:
    """The specifications in the ``.json`` files of a folder as a table: ``name`` (the file's) and ``spec``."""
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    file = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # Spark gives it as in a URL
    name = F.regexp_extract(file, r"^(.*)\.json$", 1)
    return texts.select(name.alias("name"), F.col("value").alias("spec"))


def validate_by_spec(rows: DataFrame, specs: DataFrame, name: str, item: str = "item_json") -> DataFrame:
    """``rows`` with ``violations`` by the specification ``name`` of a table with ``name`` and ``spec`` (JSON text). A row
    that is no JSON is ``not JSON``."""
    found = specs.where(F.col("name") == name).select("spec").take(2)
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} specifications are named {name}")
    parsed = rows.withColumn("_row", F.try_parse_json(item))
    checked = F.when(F.col("_row").isNull(), F.array(F.lit("not JSON"))).otherwise(violations(row_spec(found[0].spec), F.col("_row")))
    return parsed.withColumn("violations", checked).drop("_row")
