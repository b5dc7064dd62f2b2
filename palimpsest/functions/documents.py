"""Nested JSON objects to flat columns and back, with an open tail.

A spec is a list of fields. A field is a ``Leaf`` with a column, a ``Group`` of fields, a key to
keep in the residual (``Extra``) or a key to forget (``Ignored``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.scalars import col, format_iso_millis, parse_iso_millis
from palimpsest.plans.spread import spread

# What a stored NULL means. Without a policy the leaf is required.
ABSENT, NULL, EMPTY_ARRAY = "absent", "null", "empty_array"


@dataclass(frozen=True)
class Leaf:
    name: str
    kind: str
    null: str | None = None


@dataclass(frozen=True)
class Group:
    name: str
    fields: tuple
    null: str | None = None


@dataclass(frozen=True)
class Extra:
    name: str
    null: str | None = ABSENT


@dataclass(frozen=True)
class Ignored:
    name: str


Spec = Sequence[Leaf | Group | Extra | Ignored]

# Value kinds and the Spark type of their column.
KIND_TYPES = {
    "string": "string", "hash": "string", "integer": "bigint", "id": "bigint", "float": "double",
    "boolean": "boolean", "strict_boolean": "boolean", "base64": "binary",
    "ids": "array<bigint>", "timestamp": "bigint", "json": "string", "present": "boolean",
}
STRICT_KINDS = ("strict_boolean", "present")


def _leaves(spec: Spec, path: tuple[str, ...] = ()):
    for field in spec:
        if isinstance(field, Leaf):
            yield path + (field.name,), field
        elif isinstance(field, Group):
            yield from _leaves(field.fields, path + (field.name,))


def column_name(path: Sequence[str]) -> str:
    return "__".join(path)


def flat_columns(spec: Spec) -> list[str]:
    return [column_name(path) for path, _ in _leaves(spec)]


def payload_schema(spec: Spec) -> T.StructType:
    """Text-only schema of the parts of a payload that have columns."""
    fields = []
    for field in spec:
        if isinstance(field, Group):
            fields.append(T.StructField(field.name, payload_schema(field.fields)))
        elif isinstance(field, Leaf):
            kind = T.ArrayType(T.StringType()) if field.kind == "ids" else T.StringType()
            fields.append(T.StructField(field.name, kind))
    return T.StructType(fields)


def _decode(raw: Column, leaf: Leaf, present: Column) -> Column:
    kind = leaf.kind
    if kind == "strict_boolean":
        return F.when(present, F.coalesce(raw.try_cast("boolean"), F.lit(False)))
    if kind == "timestamp":
        return parse_iso_millis(raw)
    if kind == "base64":
        return F.unbase64(raw)
    if kind == "ids":
        ids = raw.cast("array<bigint>")
        return F.when(F.size(ids) > 0, ids) if leaf.null == EMPTY_ARRAY else ids
    if kind in ("string", "hash", "json"):
        return F.when(raw != "[]", raw) if leaf.null == EMPTY_ARRAY else raw
    return raw.try_cast(KIND_TYPES[kind])


def flatten_object(
    df: DataFrame, payload: str, spec: Spec, keep: Sequence[str] = (), *, dealt: bool = False
) -> DataFrame:
    """Columns ``a__b`` for the leaves of a JSON document; ignored keys vanish.

    Leaves of an absent sub-object are NULL, strict booleans included. ``dealt``: the rows are spread already.
    """
    parsed = (df if dealt else spread(df)).withColumn("_doc", F.from_json(payload, payload_schema(spec)))
    columns = []
    for path, leaf in _leaves(spec):
        parent = F.col(".".join(["_doc", *path[:-1]]))
        raw = parent[path[-1]]
        if leaf.kind == "present":
            # The key holds an explicit null when set, so only a look at the text can tell.
            route = "$" + "".join(f".{p}" for p in path)
            value = F.try_variant_get(F.try_parse_json(payload), route, "variant").isNotNull()
        else:
            value = _decode(raw, leaf, parent.isNotNull())
        columns.append(value.alias(column_name(path)))
    return parsed.select(*keep, *columns)


def canonical_json(text: str | Column) -> Column:
    """JSON text that does not depend on key order; text that is no JSON stays as it is."""
    c = col(text)
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def _residual_map(document: Column, spec: Spec) -> Column:
    entries = F.coalesce(
        document.try_cast("map<string,variant>"), F.expr("map()").cast("map<string,variant>")
    )
    known = [f.name for f in spec if not isinstance(f, Extra)]
    quiet_null = [f.name for f in spec if isinstance(f, Extra) and f.null == NULL]
    quiet_empty = [f.name for f in spec if isinstance(f, Extra) and f.null == EMPTY_ARRAY]

    def open_key(key: Column, value: Column) -> Column:
        keep = ~key.isin(*known) if known else F.lit(True)
        if quiet_null:
            keep = keep & ~(key.isin(*quiet_null) & F.is_variant_null(value))
        if quiet_empty:
            keep = keep & ~(key.isin(*quiet_empty) & (F.to_json(value) == "[]"))
        return keep

    rest = F.map_filter(entries, open_key)
    below = [
        F.struct(
            F.lit(field.name).alias("k"),
            F.parse_json(F.nullif(
                F.to_json(_residual_map(F.try_variant_get(document, f"$.{field.name}", "variant"), field.fields)),
                F.lit("{}"),
            )).alias("v"),
        )
        for field in spec
        if isinstance(field, Group)
    ]
    if below:
        # Each child is named once: an expression used twice would be computed twice per level.
        found = F.filter(F.array(*below), lambda e: e["v"].isNotNull())
        rest = F.map_concat(rest, F.map_from_entries(found))
    return rest


def residual_json(payload: str | Column, spec: Spec) -> Column:
    """Keys without a column, at every level, as canonical JSON; NULL when there are none.

    An explicit null survives, an absent key does not.
    """
    rest = F.nullif(F.to_json(_residual_map(F.try_parse_json(col(payload)), spec)), F.lit("{}"))
    return F.to_json(F.parse_json(rest))


def _encode(value: Column, leaf: Leaf) -> Column:
    kind = leaf.kind
    if kind == "id":
        return value.cast("string").cast("variant")
    if kind == "ids":
        return F.to_variant_object(value.cast("array<string>"))
    if kind == "timestamp":
        return format_iso_millis(value).cast("variant")
    if kind == "base64":
        return F.base64(value).cast("variant")
    if kind == "json":
        return F.try_parse_json(value)
    if kind == "present":
        return F.parse_json(F.lit("null"))
    return value.cast("variant")


def _missing(policy: str | None) -> Column:
    if policy == NULL:
        return F.parse_json(F.lit("null"))
    if policy == EMPTY_ARRAY:
        return F.parse_json(F.lit("[]"))
    return F.lit(None).cast("variant")


def _export_map(spec: Spec, residual: Column, path: tuple[str, ...]) -> tuple[Column, Column]:
    """(map of the object, whether the object exists)."""
    entries, exists, known = [], F.lit(True), []
    for field in spec:
        if not isinstance(field, Ignored):
            known.append(field.name)
        if isinstance(field, Leaf):
            stored = F.col(column_name(path + (field.name,)))
            if field.kind == "present":
                value = F.when(stored, F.parse_json(F.lit("null")))
            else:
                value = F.when(stored.isNull(), _missing(field.null)).otherwise(_encode(stored, field))
            if field.null is None:
                exists = exists & stored.isNotNull()
        elif isinstance(field, Extra):
            kept = F.try_variant_get(residual, f"$.{field.name}", "variant")
            value = F.coalesce(kept, _missing(field.null))
            if field.null is None:
                exists = exists & kept.isNotNull()
        elif isinstance(field, Group):
            below = F.try_variant_get(residual, f"$.{field.name}", "variant")
            child, child_exists = _export_map(field.fields, below, path + (field.name,))
            value = F.when(child_exists, F.parse_json(F.to_json(child))).otherwise(_missing(field.null))
        else:
            continue
        entries.append(F.struct(F.lit(field.name).alias("k"), value.alias("v")))
    own = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
    rest = F.coalesce(
        residual.try_cast("map<string,variant>"), F.expr("map()").cast("map<string,variant>")
    )
    rest = F.map_filter(rest, lambda key, _: ~key.isin(*known))
    return F.map_concat(own, rest), exists


def export_documents(
    df: DataFrame, spec: Spec, extra: str = "_extra", id_: str = "id", *, dealt: bool = False
) -> DataFrame:
    """(id, json): the nested document with the residual merged in and the null policy undone.

    ``dealt``: the rows are spread already.
    """
    document, _ = _export_map(spec, F.try_parse_json(F.col(extra)), ())
    # Through a variant once more, which sorts the keys.
    text = F.to_json(F.parse_json(F.to_json(document)))
    return (df if dealt else spread(df)).select(F.col(id_).alias("id"), text.alias("json"))


def known_paths(spec: Spec, path: str = "") -> list[tuple[str, str]]:
    """(path of the object, key) for every key the spec names."""
    result = []
    for field in spec:
        result.append((path, field.name))
        if isinstance(field, Group):
            result += known_paths(field.fields, f"{path}.{field.name}" if path else field.name)
    return result


def group_paths(spec: Spec, path: str = "") -> list[str]:
    """Paths of all objects of the spec, the root (empty path) first."""
    result = [path]
    for field in spec:
        if isinstance(field, Group):
            result += group_paths(field.fields, f"{path}.{field.name}" if path else field.name)
    return result
