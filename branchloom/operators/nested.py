"""Deeply nested, unevenly shaped JSON turned into related flat tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchloom.plans.lineage import materialize

#: Value of one span: a pair or an object with start and end; numbers may be texts; a missing side reads NA.
SPAN = (
    "concat(coalesce(CAST(coalesce(try_variant_get(x, '$.start', 'bigint'), try_variant_get(x, '$[0]', 'bigint')) AS STRING), 'NA'), '-', "
    "coalesce(CAST(coalesce(try_variant_get(x, '$.end', 'bigint'), try_variant_get(x, '$[1]', 'bigint')) AS STRING), 'NA'))"
)
#: Value of one text, trimmed.
TEXT = "trim(BOTH ' \\t\\r\\n' FROM try_variant_get(x, '$', 'string'))"


@dataclass(frozen=True)
class ValueArray:
    """An array of leaf values inside every object: ``kind`` in the result, the ``key`` it lies under, SQL for the value of an element ``x``; ``pairs`` if two bare numbers are one value."""

    kind: str
    key: str
    value: str
    pairs: bool = False


@dataclass
class FlatTables:
    """Related flat tables.

    ``objects``: key, path (surrogate key), parent_path, ordinal, depth, object (variant).
    ``values``: key, path of the owning object, kind, ordinal, value.
    ``schemas``: the merged schema found at each depth.
    ``fields``: everything else, whatever its name: key, path of the owning
    object, field (names from the object down, joined by dots), place
    (ordinals of the arrays passed, joined by ``/``), value as text.
    """

    objects: DataFrame
    values: DataFrame
    schemas: list[str]
    fields: DataFrame


def whole_json(text: str) -> str:
    """SQL for the variant of a text that is one valid JSON value and nothing else, else null.

    The parser stops after the first value, so the text is parsed once as the
    first of two elements; the second one is the text's own digest, which the
    text can't hold to close the list early.
    """
    listed = f"try_variant_get(try_parse_json(concat('[', {text}, ',\"', md5({text}), '\"]')), '$', 'array<variant>')"
    return f"try_element_at(filter(array({listed}), l -> size(l) = 2 AND try_variant_get(l[1], '$', 'string') = md5({text})), 1)[0]"


def _list(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def _object(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def unwrap(df: DataFrame, column: str, wrapper: str | None, rounds: int = 3) -> DataFrame:
    """Take layers off a variant column: a text that itself holds a list or object is parsed, an object with the key ``wrapper`` gives that key's value."""
    parsed = f"try_parse_json(try_variant_get({column}, '$', 'string'))"
    take = f"WHEN {_object(column)}['{wrapper}'] IS NOT NULL THEN {_object(column)}['{wrapper}']" if wrapper else ""
    for _ in range(rounds):
        df = df.withColumn(
            column,
            F.expr(f"CASE WHEN {column} IS NULL OR is_variant_null({column}) OR {_list(column)} IS NOT NULL THEN {column} {take} WHEN {_object(column)} IS NOT NULL THEN {column} WHEN {_list(parsed)} IS NOT NULL OR {_object(parsed)} IS NOT NULL THEN {parsed} ELSE {column} END"),
        )
    return df


def elements(column: str, pairs: bool = False) -> str:
    """SQL for the non-null elements of a variant; a lone value is a list of one, and so are two bare numbers if ``pairs``."""
    one = f"array({column})"
    pair = f"WHEN size({_list(column)}) = 2 AND forall({_list(column)}, x -> try_variant_get(x, '$', 'bigint') IS NOT NULL) THEN {one}" if pairs else ""
    return f"filter(CASE {pair} WHEN {_list(column)} IS NOT NULL THEN {_list(column)} ELSE {one} END, x -> x IS NOT NULL AND NOT is_variant_null(x))"


def top_keys(schema: str) -> set[str]:
    """Keys of the outermost object in the text of a merged variant schema."""
    if not schema or not schema.startswith("OBJECT<"):
        return set()
    depth, start, parts = 0, 0, []
    body = schema[len("OBJECT<") : -1]
    for i, ch in enumerate(body):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    parts.append(body[start:])
    return {re.sub(r"^`|`$", "", p.strip().split(":")[0].strip()) for p in parts if p.strip()}


def depth_of(schema: str) -> int:
    """How many objects and arrays lie within each other in the text of a merged variant schema."""
    deepest = at = 0
    for ch in schema or "":
        at += (ch == "<") - (ch == ">")
        deepest = max(deepest, at)
    return deepest


def flatten(df: DataFrame, key: str, root: str, recursive: str, values: list[ValueArray], wrapper: str | None = None) -> FlatTables:
    """Flat tables of the objects in the variant column ``root`` and, at any depth, in their key ``recursive``.

    Level by level, the merged schema of all objects is inferred; while it
    has ``recursive``, that array is exploded to the next child table. Each
    object gets the surrogate key ``path`` (its ordinals from the root, joined
    by ``/``), its parent's path and its ordinal among the non-null elements.
    Arrays named in ``values`` become rows of leaf values. Every other key the
    merged schemas show, named beforehand or not, goes to ``fields``: arrays
    and objects in it are exploded to the depth the schema has.

    Uneven shapes are accepted everywhere: a lone object for an array of one,
    an array under ``wrapper``, an array encoded once more as text. Elements
    that are no objects keep their ordinal but give no row. A null or absent
    array gives no rows; so does an empty table.
    """
    level = unwrap(df.select(F.col(key).alias("key"), F.col(root).alias("v")), "v", wrapper)
    level = level.select("key", F.lit("").alias("parent_path"), F.posexplode(F.expr(elements("v"))).alias("ordinal", "object"))
    level = level.select("key", "parent_path", F.col("ordinal").cast("string").alias("path"), "ordinal", "object")
    tables, schemas, depth = [], [], 0
    while True:
        level = materialize(unwrap(level, "object", None, 1).filter(f"{_object('object')} IS NOT NULL").withColumn("depth", F.lit(depth)), f"nested{depth}")
        found = level.agg(F.expr("schema_of_variant_agg(object)")).first()[0]
        tables.append(level)
        schemas.append(found or "")
        if recursive not in top_keys(found):
            break
        inner = level.select("key", F.col("path").alias("parent_path"), F.expr(_member("object", recursive)).alias("v")).filter("v IS NOT NULL")
        inner = unwrap(inner, "v", wrapper).select("key", "parent_path", F.posexplode(F.expr(elements("v"))).alias("ordinal", "object"))
        level = inner.select("key", "parent_path", F.concat_ws("/", "parent_path", F.col("ordinal").cast("string")).alias("path"), "ordinal", "object")
        depth += 1
    objects = tables[0]
    for t in tables[1:]:
        objects = objects.unionByName(t)
    return FlatTables(objects, leaf_values(objects, values), schemas, other_fields(objects, [recursive, *(v.key for v in values)], max(map(depth_of, schemas))))


def _member(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$.{key}', 'variant')"


def leaf_values(objects: DataFrame, specs: list[ValueArray]) -> DataFrame:
    """key, path, kind, ordinal, value of the leaf arrays of every object, all kinds in one pass."""
    kinds = ", ".join(f"struct('{v.kind}' AS kind, {_member('object', v.key)} AS v)" for v in specs)
    d = objects.select("key", "path", F.expr(f"inline(array({kinds}))")).filter("v IS NOT NULL")
    listed = " ".join(f"WHEN kind = '{v.kind}' THEN transform({elements('v', v.pairs)}, x -> {v.value})" for v in specs)
    return unwrap(d, "v", None, 1).select("key", "path", "kind", F.posexplode(F.expr(f"CASE {listed} END")).alias("ordinal", "value"))


def other_fields(objects: DataFrame, skip: list[str], depth: int) -> DataFrame:
    """Every member of the objects but those in ``skip``, nested ones exploded ``depth`` times at most; nulls are left out."""
    members = "filter(map_entries({0}), e -> e.value IS NOT NULL AND NOT is_variant_null(e.value))"
    left = ", ".join(f"'{k}'" for k in skip)
    d = objects.select("key", "path", F.explode(F.expr(f"filter({members.format(_object('object'))}, e -> e.key NOT IN ({left}))")).alias("e")).select("key", "path", F.col("e.key").alias("field"), F.lit("").alias("place"), F.col("e.value").alias("v"))
    for _ in range(max(0, depth - 1)):
        # a scalar is handed on as it is, so every round is one narrow pass
        parts = f"""CASE WHEN {_list('v')} IS NOT NULL THEN filter(transform({_list('v')}, (x, i) -> struct(field AS field, concat_ws('/', nullif(place, ''), CAST(i AS string)) AS place, x AS v)), y -> y.v IS NOT NULL AND NOT is_variant_null(y.v))
          WHEN {_object('v')} IS NOT NULL THEN transform({members.format(_object('v'))}, e -> struct(concat(field, '.', e.key) AS field, place AS place, e.value AS v)) ELSE array(struct(field AS field, place AS place, v AS v)) END"""
        d = d.select("key", "path", F.expr(f"inline({parts})"))
    return d.select("key", "path", "field", "place", F.expr("try_variant_get(v, '$', 'string')").alias("value"))
