"""Documents of the object types, made from their specs: round trips and the report of unknown keys.

A document is one SQL expression of a row number that Spark and DuckDB read alike. Leaf n of row i has a value, or is missing in the way its
spec allows: null, absent or an empty list. Every object holds a key that no spec names, and the input
has the ignored keys as well, in reverse order; what comes back has sorted keys.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import documents as D
from palimpsest.operators import quality as Q
from palimpsest.plans.spread import spread
from palimpsest.plans.staging import staged
from palimpsest.spec import OBJECT_TYPES
from workload.registry import query

UNKNOWN = "zz_unknown"
VALUES = {
    "string": """'"s' || ({i} % 7) || '"'""",
    "hash": """'"a_' || ({i} % 9) || '"'""",
    "integer": "'' || ({i} % 1000)",
    "id": """'"' || ({i} * 1000 + {n}) || '"'""",
    "float": "({i} % 10) || '.5'",
    "boolean": "CASE WHEN {i} % 2 = 0 THEN 'true' ELSE 'false' END",
    "strict_boolean": "CASE WHEN {i} % 3 = 0 THEN 'true' ELSE 'false' END",
    "base64": """'"QUJD"'""",
    "ids": """'["' || ({i} % 5) || '","' || {i} || '"]'""",
    "timestamp": """'"2024-01-1' || ({i} % 10) || 'T00:00:00.000Z"'""",
    "json": """'{{"a":' || ({i} % 4) || '}}'""",
    "present": "'null'",
}
MISSING = {D.NULL: "'null'", D.EMPTY_ARRAY: "'[]'", D.ABSENT: "NULL"}


def has_required(spec) -> bool:
    return any(getattr(f, "null", D.ABSENT) is None and not isinstance(f, D.Ignored) for f in spec)


def members(spec, given: bool, numbers) -> dict[str, str]:
    """SQL of the value of each key, NULL where the key is absent."""
    found = {UNKNOWN: "'' || i"}
    for field in spec:
        n = next(numbers)
        if isinstance(field, D.Ignored):
            if given:
                found[field.name] = "'0'"
            continue
        if isinstance(field, D.Group):
            value = document(field.fields, given, numbers)
            # Without a required leaf a missing group can't be told from one whose leaves are missing.
            missing = field.null is not None and has_required(field.fields)
        elif isinstance(field, D.Extra):
            value, missing = VALUES["string"].format(i="i", n=n), field.null is not None
        else:
            value = VALUES[field.kind].format(i="i", n=n)
            missing = field.null is not None or field.kind == "present"
        otherwise = MISSING.get(field.null, "NULL")
        found[field.name] = f"CASE WHEN (i + {n}) % 4 = 0 THEN {otherwise} ELSE {value} END" if missing else value
    return found


def document(spec, given: bool, numbers=None) -> str:
    held = members(spec, given, numbers if numbers is not None else count())
    # A NULL value makes its part NULL, and concat_ws leaves that out.
    parts = [f"""'"{key}":' || ({sql})""" for key, sql in sorted(held.items(), reverse=given)]
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


def payloads(t, kind):
    # Spread before the documents are made, as ids are all that has to move.
    return spread(t.customer.select(F.col("c_custkey").alias("i"))).select("i", F.expr(document(OBJECT_TYPES[kind].fields, True)).alias("payload"))


def round_trip(kind):
    spec = OBJECT_TYPES[kind].fields

    def run(t):
        flat = D.flatten_object(
            payloads(t, kind).withColumn("_rest", D.residual_json("payload", spec)), "payload", spec, ["i", "_rest"],
            dealt=True)
        return D.export_documents(flat, spec, extra="_rest", id_="i", dealt=True)

    query(f"S6_round_trip_{kind}", f"SELECT c_custkey AS id, {document(spec, False)} AS json FROM (SELECT *, c_custkey AS i FROM customer)")(run)


for _kind in OBJECT_TYPES:
    round_trip(_kind)


def unknown_counts(spec, numbers, path="", present="true"):
    """(path, condition) of every object of a document."""
    yield path, present
    for field in spec:
        n = next(numbers)
        if isinstance(field, D.Group):
            here = f"(i + {n}) % 4 <> 0" if field.null is not None and has_required(field.fields) else "true"
            yield from unknown_counts(field.fields, numbers, f"{path}.{field.name}" if path else field.name, f"{present} AND {here}")


def report_sql() -> str:
    parts = [
        f"SELECT '{kind}' AS type, '{path}' AS path, '{UNKNOWN}' AS key, count(*) AS n FROM rows WHERE {present}"
        for kind, held in OBJECT_TYPES.items() for path, present in unknown_counts(held.fields, count())
    ]
    return "WITH rows AS (SELECT c_custkey AS i FROM customer) SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query("F7_unknown_keys_of_types", report_sql())
def _(t):
    # Documents of all types side by side, as they land.
    docs = reduce(DataFrame.unionByName, [payloads(t, kind).select(F.lit(kind).alias("type"), "payload") for kind in OBJECT_TYPES])
    return Q.unknown_keys_of_types(staged(docs, "documents"), {kind: held.fields for kind, held in OBJECT_TYPES.items()})
