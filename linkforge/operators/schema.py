"""Schema-driven projections and validation: configuration becomes lists of columns, one select each."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import joined, slugify, strip, text_of
from linkforge.functions.values import year_text


@dataclass(frozen=True)
class Field:
    name: str
    required: bool = False
    data_type: str = "string"
    null_behavior: str = "empty_string"
    default_value: str = ""
    rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    version: str
    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    transformation: str


def load_schema(path: str, version: str | None = None) -> Schema:
    """Fields in order from JSON; another version than the one asked for, or gaps in the order, are errors."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if version is not None and data["schema_version"] != version:
        raise ValueError(f"unsupported schema version {data['schema_version']}")
    if [c["order"] for c in data["columns"]] != list(range(1, len(data["columns"]) + 1)):
        raise ValueError("column order must run from 1 without gaps")
    fields = (Field(c["name"], bool(c["required"]), c["data_type"], c["null_behavior"], str(c["default_value"]), tuple(c["validation_rules"])) for c in data["columns"])
    return Schema(data["schema_version"], tuple(fields))


def load_mapping(path: str) -> list[Mapping]:
    """Mapping rows; the two field names of a row are found by what they end in."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    pick = lambda row, end: next(v for k, v in row.items() if k.endswith(end))
    return [Mapping(pick(m, "source_field"), pick(m, "destination_field"), m["transformation"]) for m in data["mappings"]]


def cell(df: DataFrame, name: str) -> Column:
    """A column of any type as stripped text; arrays are joined by '; ', a missing column is NULL."""
    kinds = dict(df.dtypes)
    if name not in kinds:
        return F.lit(None).cast("string")
    return joined(F.col(name)) if kinds[name].startswith("array") else strip(F.col(name).cast("string"))


def transformed(df: DataFrame, m: Mapping) -> Column:
    """One mapping's value."""
    if m.transformation.startswith("default:"):
        return F.lit(m.transformation.split(":", 1)[1])
    value = text_of(cell(df, m.source))
    kinds = {
        "copy": value,
        "url": value,
        "url_or_empty": value,
        "slugify": slugify(value),
        "integer_string": year_text(value),
        "collective_or_empty": F.when(value != "", "Collective project").otherwise(""),
        "artist_contribution_title": F.when(value != "", F.concat(F.lit("Artist contribution to "), value)).otherwise(""),
    }
    if m.transformation not in kinds:
        raise ValueError(f"unknown transformation {m.transformation}")
    return kinds[m.transformation]


def project(df: DataFrame, schema: Schema, mappings: list[Mapping], keep: list[str] = ()) -> DataFrame:
    """Defaults, overlaid by mappings (a later one of the same target wins), in the schema's order."""
    values = {f.name: F.lit(f.default_value) for f in schema.fields}
    for m in mappings:
        if m.target not in values:
            raise ValueError(f"mapping to unknown field {m.target}")
        values[m.target] = transformed(df, m)
    return df.select(*keep, *[values[n].alias(n) for n in schema.names])


def unmapped(df: DataFrame, mappings: list[Mapping]) -> list[str]:
    return sorted(set(df.columns) - {m.source for m in mappings})


def formatted(df: DataFrame, schema: Schema, keep: list[str] = ()) -> DataFrame:
    """Rows in schema order: missing columns take defaults, NULL becomes '' or 'null', arrays are joined."""
    unknown = set(df.columns) - set(schema.names) - set(keep)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    out = []
    for f in schema.fields:
        value = cell(df, f.name) if f.name in df.columns else F.lit(f.default_value)
        if dict(df.dtypes).get(f.name, "").startswith("string"):
            value = F.col(f.name)
        out.append(F.coalesce(value, F.lit("" if f.null_behavior == "empty_string" else "null")).alias(f.name))
    return df.select(*keep, *out)


SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def field_errors(f: Field) -> Column:
    """Messages for one field of a formatted row. An optional empty field has none."""
    v = F.col(f"`{f.name}`")
    absolute = v.rlike("^https?://[^/?#]+")
    checks: list[tuple[Column, str]] = []
    if f.required:
        checks.append((v == "", "required value missing"))
    if f.data_type == "integer":
        checks.append((~v.rlike("^[0-9]+$"), "expected integer"))
    elif f.data_type == "url":
        checks.append(((v != "") & ~absolute, "expected absolute http(s) URL"))
    rules = {
        "non_empty": (v == "", "must be non-empty"),
        "slug": (~v.rlike(SLUG), "expected slug"),
        "slug_or_empty": ((v != "") & ~v.rlike(SLUG), "expected slug or empty"),
        "year_or_empty": ((v != "") & ~v.rlike(r"^(19|20)\d{2}$"), "expected four-digit year or empty"),
        "url": (~absolute, "expected absolute http(s) URL"),
        "url_or_empty": ((v != "") & ~absolute, "expected absolute http(s) URL or empty"),
    }
    for rule in f.rules:
        if rule.startswith("one_of:"):
            choices = rule.split(":", 1)[1].split(",")
            checks.append(((v != "") & ~v.isin(*choices), f"expected one of {sorted(set(choices))}"))
        elif rule in rules:
            checks.append(rules[rule])
    if not checks:
        return F.array().cast("array<string>")
    found = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))
    return found if f.required else F.when(v == "", F.array().cast("array<string>")).otherwise(found)


def validate(df: DataFrame, schema: Schema) -> DataFrame:
    """Add ``errors``: an array of (field, message) structs; a row is valid when it is empty."""
    def tagged(f: Field) -> Column:
        return F.transform(field_errors(f), lambda m: F.struct(F.lit(f.name).alias("field"), m.alias("message")))

    per = [tagged(f) for f in schema.fields]
    return df.withColumn("errors", F.flatten(F.array(*per)))


def first_failures(validated: DataFrame, row: str, most: int = 25) -> DataFrame:
    """The first failing rows; their number is capped, so it is a lower bound of all failures."""
    return validated.where(F.size("errors") > 0).orderBy(row).limit(most)
