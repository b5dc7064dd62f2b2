"""Ordered per-key computations that survive hot keys.

A window over ``partitionBy(key)`` puts all rows of a key in one task. Here each key whose
row count is above ``spark.palimpsest.hotKeyRows`` is cut into time slices of about equal row
count. The slices are separate window groups, and what has to cross a slice border (the last
value seen so far) travels as one small row per slice:

1. exact counts of the keys, combined before the shuffle, give a table of the hot ones with the
   number of slices of each; without any, the plan is one shuffle and one plain window;
2. ``percentile_approx`` gives the borders of the slices of the hot keys;
3. ``max_by`` per slice, combined before the shuffle, gives the value at its end; a window over
   the slice rows gives the value each slice starts with;
4. rows and slice starts meet on two hashes of the key and the slice, and the window over the same
   columns reuses that partitioning, so the wide rows are shuffled once in both plans. Hashes are
   never NULL, so NULL is a key like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.plans.staging import staged

HOT_ROWS_SETTING = "spark.palimpsest.hotKeyRows"
DEFAULT_HOT_ROWS = 4_000_000
# Borders of a hot key are searched in two steps of 64, so 4096 slices cost 128 comparisons.
STEP = 64
# There are at most two slices for each DEFAULT_HOT_ROWS rows. Up to this many borders (32 MB) are sent to
# all executors; beyond that rows and borders are joined by key.
BROADCAST_SLICES = 4_000_000
# Rows that lack a join key are dealt to so many groups; a few digits cost a shuffle less than a whole hash.
LACKING = 4096

KEY_HASH = "_key_hash"
KEY_CHECK = "_key_check"
SLICE = "_slice"


@dataclass(frozen=True)
class HotKeys:
    """Keys with too many rows for one task.

    ``table`` (written; key hashes, _doublings) names them: a key is cut into 2 ** doublings slices. ``doublings`` are
    the numbers that occur, ``slices`` is the sum of all slices.
    """

    table: DataFrame | None = None
    doublings: tuple[int, ...] = ()
    slices: int = 0

    def __bool__(self) -> bool:
        return self.table is not None


NO_HOT_KEYS = HotKeys()


def join_by_key(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "left") -> DataFrame:
    """A join on key columns where NULL equals NULL; of the right side only further columns stay."""
    renamed = {c: f"_right_{c}" for c in key}
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()])
    met = left.join(right.withColumnsRenamed(renamed), on, how)
    if how in ("left_semi", "left_anti"):
        return met
    if how == "full_outer":
        met = met.withColumns({c: F.coalesce(c, r) for c, r in renamed.items()})
    return met.drop(*renamed.values())


def join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on a key that many rows lack: these meet nothing and are dealt by their other columns, not to one task.

    Both sides are joined on (key, number), where the number is 0 unless the key is NULL.
    """
    simple = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DatetimeType)
    others = [f"`{f.name}`" for f in left.schema if isinstance(f.dataType, simple) and f.name != key]
    dealt = F.when(F.col(key).isNull(), 1 + F.pmod(F.xxhash64(F.lit(0), *others), F.lit(LACKING))).otherwise(0).cast("long")
    rows = left.withColumn("_known", F.struct(F.col(key).alias("key"), dealt.alias("dealt")))
    # Structs of NULL are equal, so the right side must not hold one.
    known = right.where(F.col(key).isNotNull()).withColumn(
        "_known", F.struct(F.col(key).alias("key"), F.lit(0).cast("long").alias("dealt")))
    met = rows.join(known.drop(key), "_known", "left").drop("_known")
    return met.select(key, *[f"`{c}`" for c in met.columns if c != key])


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(DEFAULT_HOT_ROWS)))


def key_hashes(key: Sequence[str]) -> list[Column]:
    return [F.xxhash64(*key).alias(KEY_HASH), F.xxhash64(F.lit(1), *key).alias(KEY_CHECK)]


def find_hot_keys(df: DataFrame, *keys: Sequence[str]) -> list[HotKeys]:
    """Hot keys for each of several key column lists, from exact counts in one pass over those columns."""
    limit = hot_rows(df)
    hashed = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_list"), *key_hashes(key)) for i, key in enumerate(keys)
    ])).alias("k")).select("k.*")
    counted = hashed.groupBy("_list", KEY_HASH, KEY_CHECK).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    hot = staged(counted.withColumn("_doublings", F.ceil(F.log2(F.col("_rows") / limit)).cast("int")), "hot-keys")
    # One row for each list and number of doublings.
    sizes = hot.groupBy("_list", "_doublings").agg(F.count("*").alias("n")).collect()
    result = []
    for i in range(len(keys)):
        own = [r for r in sizes if r["_list"] == i]
        result.append(HotKeys(
            hot.where(F.col("_list") == i).select(KEY_HASH, KEY_CHECK, "_doublings"),
            tuple(sorted(r["_doublings"] for r in own)), sum(r["n"] << r["_doublings"] for r in own),
        ) if own else NO_HOT_KEYS)
    return result


@dataclass(frozen=True)
class Pass:
    """One ordered look along the rows of each key.

    For each name in ``values``: the last non-null value among the earlier rows. ``order`` must
    give a total order; its columns are numbers. ``backward`` takes the nearest later row instead;
    ``inclusive`` lets a row see its own value; ``strict`` shows only rows with a smaller first
    order column, so that tied rows all see the same (they always share a slice). ``sums`` adds up
    numbers of the seen rows instead of taking the last one.
    """

    key: Sequence[str]
    order: Sequence[str]
    values: Mapping[str, Column]
    backward: bool = False
    inclusive: bool = False
    strict: bool = False
    sums: Mapping[str, Column] = field(default_factory=dict)

    def with_values(self, df: DataFrame) -> DataFrame:
        # A struct around each value, so that a value may be a struct of NULLs and still count.
        lasts = {f"_v_{n}": F.when(v.isNotNull(), F.struct(v.alias("v"))) for n, v in self.values.items()}
        return df.withColumns(lasts | {f"_v_{n}": v for n, v in self.sums.items()})

    def window(self, group: Sequence[str]) -> Window:
        if self.strict:
            return Window.partitionBy(*group).orderBy(self.order[0]).rangeBetween(Window.unboundedPreceding, -1)
        direction = [F.col(c).desc() if self.backward else F.col(c).asc() for c in self.order]
        end = Window.currentRow if self.inclusive else -1
        return Window.partitionBy(*group).orderBy(*direction).rowsBetween(Window.unboundedPreceding, end)


def carry(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    *,
    hot: HotKeys | None = None,
    stored: bool = False,
    **how,
) -> DataFrame:
    """A single ``Pass``."""
    return carry_passes(df, [Pass(key, order, values, **how)], None if hot is None else [hot], stored)


def carry_passes(
    df: DataFrame, passes: Sequence[Pass], hot: Sequence[HotKeys] | None = None, stored: bool = False
) -> DataFrame:
    """Add the columns of all passes; their values come from the columns of ``df``.

    With hot keys ``df`` is written once, unless it is ``stored`` already, since slices and slice
    ends read it again; they read that table and not the passes before them, so the plan grows
    with the number of passes.
    """
    if hot is None:
        keys = list(dict.fromkeys(tuple(p.key) for p in passes))
        by_key = dict(zip(keys, find_hot_keys(df, *keys)))
        hot = [by_key[tuple(p.key)] for p in passes]
    base = staged(df, "ordered") if any(hot) and not stored else df
    frame = base
    for one, hot_keys in zip(passes, hot):
        frame = _sliced_pass(frame, base, one, hot_keys) if hot_keys else _plain_pass(frame, one, one.key)
    return frame


def _plain_pass(df: DataFrame, one: Pass, group: Sequence[str], starts: bool = False) -> DataFrame:
    rows = df if starts else one.with_values(df)
    window = one.window(group)
    seen = {}
    for n in one.values:
        value = F.last(f"_v_{n}", ignorenulls=True).over(window)
        seen[n] = (F.coalesce(value, F.col(f"_s_{n}")) if starts else value)["v"]
    for n in one.sums:
        total = F.coalesce(F.sum(f"_v_{n}").over(window), F.lit(0))
        seen[n] = total + F.coalesce(F.col(f"_s_{n}"), F.lit(0)) if starts else total
    return rows.withColumns(seen).drop(*[f"_v_{n}" for n in seen], *[f"_s_{n}" for n in seen])


def _borders(base: DataFrame, one: Pass, hot: HotKeys) -> DataFrame:
    """(key hashes, ascending slice borders) of the hot keys; keys with equally many slices go together."""
    at = base.select(*key_hashes(one.key), F.col(one.order[0]).alias("_at"))
    parts = []
    for doublings in hot.doublings:
        slices = 1 << doublings
        keys = hot.table.where(F.col("_doublings") == doublings)
        parts.append(
            at.join(keys, [KEY_HASH, KEY_CHECK], "left_semi").groupBy(KEY_HASH, KEY_CHECK)
            .agg(F.percentile_approx("_at", [i / slices for i in range(1, slices)], 10 * slices).alias("_borders"))
        )
    return reduce(DataFrame.unionByName, parts)


def _with_slices(df: DataFrame, one: Pass, borders: DataFrame, hot: HotKeys) -> DataFrame:
    """Add the key hashes and the slice number: 0 for cold keys, else the place of the row between the borders."""
    at = F.col(one.order[0])
    side = F.broadcast(borders) if hot.slices <= BROADCAST_SLICES else borders
    hashed = df.withColumns(dict(zip((KEY_HASH, KEY_CHECK), key_hashes(one.key))))
    joined = hashed.join(side, [KEY_HASH, KEY_CHECK], "left")
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size("_borders") / STEP)).cast("int")),
        lambda i: F.try_element_at("_borders", i * STEP),
    )
    coarse = F.size(F.filter(every, lambda b: b < at))
    fine = F.size(F.filter(F.slice("_borders", coarse * STEP + 1, STEP), lambda b: b < at))
    return joined.withColumn(
        SLICE, F.when(F.col("_borders").isNull(), 0).otherwise(coarse * STEP + fine)
    ).drop("_borders")


def _sliced_pass(df: DataFrame, base: DataFrame, one: Pass, hot: HotKeys) -> DataFrame:
    borders = _borders(base, one, hot)
    nearest = F.min_by if one.backward else F.max_by
    place = F.struct(*one.order)
    held = [
        nearest(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_v_{n}") for n in one.values
    ] + [F.sum(f"_v_{n}").alias(f"_v_{n}") for n in one.sums]
    group = [KEY_HASH, KEY_CHECK, SLICE]
    # Cold keys have slice 0 only and need no starts.
    ends = (
        _with_slices(one.with_values(base), one, borders, hot)
        .join(hot.table, [KEY_HASH, KEY_CHECK], "left_semi").groupBy(*group).agg(*held)
    )
    before = (
        Window.partitionBy(KEY_HASH, KEY_CHECK)
        .orderBy(F.col(SLICE).desc() if one.backward else F.col(SLICE).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = ends.select(
        *group,
        *[F.last(f"_v_{n}", ignorenulls=True).over(before).alias(f"_s_{n}") for n in one.values],
        *[F.sum(f"_v_{n}").over(before).alias(f"_s_{n}") for n in one.sums],
    )
    met = _with_slices(one.with_values(df), one, borders, hot).join(starts, group, "left")
    return _plain_pass(met, one, [*group, *one.key], starts=True).drop(*group)


def newest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, combined before the shuffle, so a hot key costs no more."""
    return _pick(df, key, order, F.max_by)


def oldest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return _pick(df, key, order, F.min_by)


def _pick(df, key, order, chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)
