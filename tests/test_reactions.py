from __future__ import annotations

import random

import pytest

from palimpsest.operators import reactions as R

LOG = "message_id long, emoji string, type int, user_id long, action string, ts long, seq long"


def fold(spark, rows):
    return sorted((tuple(r) for r in R.fold_reaction_log(spark.createDataFrame(rows, LOG)).collect()), key=str)


def one_by_one(rows):
    open_, out = {}, []
    for m, e, t, u, action, ts, seq in sorted(rows, key=lambda r: (r[5], r[6])):
        key = (m, e, t, u)
        if action == "add":
            open_.setdefault(key, ts)
        elif action == "remove":
            if key in open_:
                out.append((*key, open_.pop(key), ts))
        else:
            for k in [k for k in open_ if k[0] == m and (e is None or k[1] == e)]:
                out.append((*k, open_.pop(k), ts))
    return sorted(out + [(*k, s, None) for k, s in open_.items()], key=str)


def test_each_step_repeated(spark, hot_mode):
    steps = [
        (1, "x", 0, 5, "add"), (1, "x", 1, 5, "add"), (1, "y", 0, 6, "add"), (1, "x", 0, 5, "remove"),
        (1, "x", 0, 5, "add"), (1, "x", None, None, "clear"), (1, None, None, None, "clear"), (2, "y", 0, 5, "add"),
    ]
    rows = [(*s, 2 * (i // 2) + 2 + i % 2, i) for i, s in enumerate(s for s in steps for _ in (0, 1))]
    assert fold(spark, rows) == one_by_one(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_row_by_row(spark, hot_mode, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(300):
        m = 0 if rng.random() < 0.34 else rng.randrange(1, 5)
        action = rng.choices(["add", "remove", "clear"], [6, 3, 1])[0]
        if action == "clear":
            rows.append((m, rng.choice(["x", None]), None, None, action, seq // 2, seq))
        else:
            rows.append((m, rng.choice("xy"), rng.randrange(2), rng.randrange(3), action, seq // 2, seq))
    assert fold(spark, rows) == one_by_one(rows)


def test_place(spark, hot_mode):
    intervals = spark.createDataFrame(
        [(1, "x", 0, 5, 50, None), (1, "y", 0, 5, 2, 4)], "message_id long, emoji string, type int, user_id long, start long, end long"
    )
    events = spark.createDataFrame([
        (1, "x", 0, 5, 10, 1, True), (1, "y", 0, 5, 10, 2, True), (1, "y", 0, 5, 11, 3, True),
        (9, "x", 0, 5, 10, 4, True), (1, "x", 0, 77, 10, 5, False), (1, "x", 0, 77, 10, 6, True),
    ], "message_id long, emoji string, type int, user_id long, ts long, seq long, has_user boolean")
    messages = spark.createDataFrame([(1,)], "id long")
    users = spark.createDataFrame([(5,)], "id long")
    got = {r["seq"]: r["result"] for r in R.place_reaction(intervals, events, messages, users).collect()}
    assert got == {1: "exists", 2: "added", 3: "exists", 4: "missing message", 5: "missing user", 6: "added"}


def test_remove_and_clear(spark):
    intervals = spark.createDataFrame(
        [(1, "x", 0, 5, 2, None), (1, "x", 1, 5, 2, None), (1, "y", 0, 6, 2, None), (1, "y", 0, 7, 2, 3)],
        "message_id long, emoji string, type int, user_id long, start long, end long",
    )
    removes = spark.createDataFrame([(1, "x", 0, 5, 8, 1), (1, "y", 0, 7, 9, 2)],
                                    "message_id long, emoji string, type int, user_id long, ts long, seq long")
    got = {tuple(r)[1:4]: r["end"] for r in R.remove_reaction(intervals, removes).collect()}
    assert got == {("x", 0, 5): 8, ("x", 1, 5): None, ("y", 0, 6): None, ("y", 0, 7): 3}
    assert {r["seq"]: r["removed"] for r in R.removal_results(intervals, removes).collect()} == {1: True, 2: False}
    clear_x = spark.createDataFrame([(1, "x", 8, 1)], "message_id long, emoji string, ts long, seq long")
    closed = R.clear_reactions(intervals, clear_x)
    assert {tuple(r)[1:4]: r["end"] for r in closed.collect()} == {
        ("x", 0, 5): 8, ("x", 1, 5): 8, ("y", 0, 6): None, ("y", 0, 7): 3}
    assert [tuple(r) for r in R.clear_counts(intervals, closed).collect()] == [(1, 2)]


def test_open_at(spark):
    intervals = spark.createDataFrame(
        [(1, "x", 0, 1, 20, None), (1, "x", 0, 2, 20, 30), (1, "x", 0, 3, 40, None)],
        "message_id long, emoji string, type int, user_id long, start long, end long",
    )
    def at(t):
        return [r["n"] for r in R.reactions_at(intervals, t).collect()]

    assert at(9) == [] and at(10) == [2] and at(15) == [1] and at(20) == [2]
