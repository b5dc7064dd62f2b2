"""Streams in several micro-batches mean what the batch functions mean."""

from __future__ import annotations

import json
import os
import random

from pyspark.sql import functions as F

from palimpsest.operators.capture import members_append
from palimpsest.operators.reactions import fold_reaction_log
from palimpsest.sources.landing import DISPATCH_SCHEMA, read_dispatches
from palimpsest.streaming import dispatch as S
from palimpsest.streaming import keyed as K
from palimpsest.streaming.decode import decode_members, decode_reactions
from palimpsest.streaming.keyed import snapshots, start_snapshots
from palimpsest.streaming.state import BatchState, runs_before


def land(folder, batches):
    """One file per micro-batch: rows (t, document, seq, received_at, realtime)."""
    folder.mkdir()
    for n, batch in enumerate(batches):
        lines = [json.dumps(dict(zip(("t", "d", "seq", "received_at", "realtime"), row))) for row in batch]
        file = folder / f"{n:03}.json"
        file.write_text("\n".join(lines))
        # The source takes files in order of their time.
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


def run(spark, tmp_path, batches, rows, start):
    """One file a micro-batch, so that state crosses them."""
    stream = read_dispatches(spark, land(tmp_path / "in", batches), maxFilesPerTrigger="1")
    start(rows(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return K.written(spark, str(tmp_path / "out"))


def observed(stream):
    return S.packed_time(stream).select(
        F.get_json_object("d", "$.id").cast("long").alias("id"), F.get_json_object("d", "$.v").alias("v"),
        F.get_json_object("d", "$.x").alias("x"), "ts", "seq",
    )


def test_snapshots_keep_state_and_reject_late(spark, tmp_path):
    def event(name, id_, v, seq, at):
        return (name, {"id": id_, "v": v}, seq, at, True)

    big = 9007199254740993  # not a double
    batches = [
        [event("MESSAGE_CREATE", big, "a", 1, 10), event("MESSAGE_UPDATE", big, "a", 2, 11)],
        [event("MESSAGE_UPDATE", big, "b", 3, 12), event("MESSAGE_UPDATE", 2, None, 4, 12)],
        [event("MESSAGE_UPDATE", big, "c", 5, 9), event("MESSAGE_UPDATE", big, "b", 6, 8), event("MESSAGE_UPDATE", 2, "x", 7, 13)],
    ]
    stream = observed(read_dispatches(spark, land(tmp_path / "in", batches), maxFilesPerTrigger="1"))
    for _ in range(2):  # starting again changes nothing
        start_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["id"], ["v"]).awaitTermination()
    table = snapshots(spark, str(tmp_path / "out"))
    assert sorted((r["seq"], r["id"], r["ts"], r["result"]) for r in table.collect()) == [
        (1, big, 0, "first"), (3, big, 25, "another"), (4, 2, 25, "first"), (5, big, 19, "rejected"), (7, 2, 27, "another"),
    ]
    kept, late = K.split_results(table)
    assert kept.count() == 4 and late.count() == 1


def test_snapshots_start_from_an_archive_and_compare_canonically(spark, tmp_path):
    def event(id_, v, x, seq, at):
        return ("MESSAGE_UPDATE", {"id": id_, "v": v, "x": x}, seq, at, True)

    batches = [
        [event(1, "a", {"p": 1, "q": [2]}, 1, 20), event(2, "a", {"q": [2], "p": 1}, 2, 20)],
        [event(2, "a", {"p": 1, "q": [2]}, 3, 21), event(1, "a", {"p": 1, "q": [3]}, 4, 22), event(1, "z", None, 5, 1)],
    ]
    archive = spark.createDataFrame([(1, 4, "a", '{"q":[2],"p":1}'), (9, 4, "k", None)], "id long, ts long, v string, x string")
    stream = observed(read_dispatches(spark, land(tmp_path / "in", batches), maxFilesPerTrigger="1"))
    start_snapshots(
        stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["id"], ["v"], extra="x", archive=archive).awaitTermination()
    got = snapshots(spark, str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.id, r.result) for r in got) == [(2, 2, "first"), (4, 1, "another"), (5, 1, "rejected")]


def test_reactions_across_batches(spark, tmp_path):
    def event(action, emoji, user, seq):
        d = {"message_id": 1, "emoji": emoji, "type": 0, "user_id": user, "action": action, "ts": seq, "seq": seq}
        return ("R", d, seq, seq, True)

    batches = [
        [event("add", "x", 5, 1), event("add", "y", 6, 2)],
        [event("add", "x", 5, 3), event("clear", "x", None, 4)],
        [event("remove", "x", 5, 5), event("add", "x", 5, 6), event("clear", None, None, 7)],
    ]

    rows = K.intervals_from_log(run(spark, tmp_path, batches, documents(REACTION), K.start_reactions)).collect()
    assert sorted((r["emoji"], r["user_id"], r["start"], r["end"]) for r in rows) == [
        ("x", 5, 1, 4), ("x", 5, 6, 7), ("y", 6, 2, 7),
    ]


REACTION = "message_id long, emoji string, type int, user_id long, action string, ts long, seq long"
MEMBER = "guild_id long, user_id long, ts long, seq long, deaf boolean, mute boolean, nick string, joined_at long"


def documents(schema):
    return lambda stream: stream.select(F.from_json("d", schema).alias("d")).select("d.*")


def as_batches(rows, names, sizes):
    """Rows as events, in micro-batches of some sizes."""
    batches, at = [], 0
    for size in sizes:
        batches.append([("R", dict(zip(names, r)), n, n, True) for n, r in enumerate(rows[at : at + size], at)])
        at += size
    return batches


def test_reactions_in_micro_batches_equal_the_fold(spark, tmp_path, hot_mode):
    rng, rows = random.Random(5), []
    for seq in range(90):
        action = rng.choices(["add", "remove", "clear"], [6, 3, 1])[0]
        own = (rng.choice("xy"), rng.randrange(2), rng.randrange(3)) if action != "clear" else (rng.choice(["x", None]), None, None)
        rows.append((rng.choice([None, 0, 0, 1]), *own, action, seq // 2, seq))
    names = [c.split()[0] for c in REACTION.split(", ")]
    got = K.intervals_from_log(run(spark, tmp_path, as_batches(rows, names, [30, 30, 30]), documents(REACTION), K.start_reactions))
    want = fold_reaction_log(spark.createDataFrame(rows, REACTION)).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_members_in_micro_batches_equal_the_batch(spark, tmp_path, hot_mode):
    rng, rows = random.Random(6), []
    for seq in range(60):
        leave = rng.random() < 0.2
        flags = [None, None] if leave else [rng.choice([None, True, False]) for _ in range(2)]
        rows.append((1, rng.choice([None, 7, 8]), seq, seq, *flags, None if leave else rng.choice("ab"), None if leave else 5))
    names = [c.split()[0] for c in MEMBER.split(", ")]
    got = run(spark, tmp_path, as_batches(rows, names, [20, 20, 20]), documents(MEMBER), lambda s, *at: K.start_members(s, *at, ["nick"]))
    every = spark.createDataFrame(rows, MEMBER)
    gone = F.col("joined_at").isNull()
    want = members_append(None, every.where(~gone), every.where(gone), ["joined_at", "nick", "deaf", "mute"])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.result for r in got.collect()} == {"first", "another"}


def lists_one_by_one(lists):
    known, out = {}, []
    for guild, ts, seq, items in lists:
        ids = {i["id"] for i in items}
        for k in known:
            if k[0] == guild and not known[k][2] and k[1] not in ids:
                known[k][2] = True
                out.append((guild, int(k[1]), seq, "deleted"))
        for i in items:
            old = known.get((guild, i["id"]))
            if old is None or old[1] != i["name"]:
                change = "first" if old is None else "another" if ts > old[0] else "rejected"
                if change != "rejected":
                    known[guild, i["id"]] = [ts, i["name"], bool(old and old[2])]
                out.append((guild, int(i["id"]), seq, change))
    return sorted(out)


def test_lists_equal_a_row_by_row_archive(spark, tmp_path):
    rng, lists = random.Random(7), []
    for seq in range(40):
        ids = rng.sample(range(1, 7), rng.randrange(0, 7))
        lists.append((rng.randrange(2), 2 * seq, seq, [{"id": str(i), "name": rng.choice("ab")} for i in ids]))
    rows = [(g, ts, seq, [json.dumps(i) for i in items]) for g, ts, seq, items in lists]
    got = run(spark, tmp_path, as_batches(rows, ["guild_id", "ts", "seq", "items"], [13, 13, 14]),
              documents("guild_id long, ts long, seq long, items array<string>"), K.start_lists)
    assert sorted((r.guild_id, r.id, r.seq, r.change) for r in got.collect()) == lists_one_by_one(lists)


def test_lists_of_many_items(spark, tmp_path):
    """Two servers of 10,000 items each; the second list of each lacks every third."""
    def items(server, keep):
        return [json.dumps({"id": str(server * 100_000 + i)}) for i in range(10_000) if keep or i % 3]

    rows = [(s, 2 * n, n, items(s, not late)) for n, (late, s) in enumerate([(0, 1), (0, 2), (1, 1), (1, 2)])]
    got = run(spark, tmp_path, as_batches(rows, ["guild_id", "ts", "seq", "items"], [2, 2]),
              documents("guild_id long, ts long, seq long, items array<string>"), K.start_lists)
    counts = {(r.guild_id, r.change): r["count"] for r in got.groupBy("guild_id", "change").count().collect()}
    assert counts == {(s, c): n for s in (1, 2) for c, n in (("first", 10_000), ("deleted", 3334))}


def test_runs_make_up_all_batches():
    for fan in (2, 3, 8):
        for n in range(200):
            runs = runs_before(n, fan)
            assert [k for a, z in runs for k in range(a, z + 1)] == list(range(n))
            assert len(runs) <= (fan - 1) * 9


def test_state_stays_bounded_and_survives_restarts(spark, tmp_path):
    """50 micro-batches: few runs are open, only buckets of the keys are read, a merge that broke off is done again."""
    def state():
        return BatchState(spark, str(tmp_path / "state"), "id long, v long, open boolean", ["id"], alive=F.col("open"), buckets=8, fan=4)

    truth, most = {}, 0
    for n in range(50):
        held = state()  # as after a restart
        if n == 32:
            # The merge of 16 to 31 broke off: files, but no mark.
            held._write(spark.createDataFrame([(1, -1, True, 0)], "id long, v long, open boolean, batch long"), (16, 31))
            os.remove(tmp_path / "state" / "000000016-000000031" / "_SUCCESS")
        held.prepare(n)
        ids = [None, n % 5, 10 + n % 3] if n % 10 == 9 else [n % 5]
        if n in (9, 31, 32, 49):
            keys = spark.createDataFrame([(i,) for i in ids], "id long")
            got = {r.id: r.v for r in held.known(keys, n).where("open").collect()}
            assert got == {i: truth[i] for i in ids if truth.get(i) is not None}
            touched = {r.b for r in keys.select(held._bucket().alias("b")).collect()}
            assert {int(p.rsplit("=", 1)[1]) for p in held.opened} <= touched
            most = max(most, len(held.opened))
        rows = [(i, None if (n + (i or 0)) % 4 == 0 else n) for i in ids]
        truth.update(dict(rows))
        put = spark.createDataFrame([(i, v, v is not None) for i, v in rows], "id long, v long, open boolean")
        for _ in range(2 if n % 16 == 15 else 1):  # a repeated micro-batch
            held.put(put, n)
    assert most <= 9 * 3 and len(os.listdir(tmp_path / "state")) <= 9
    state().prepare(50)
    assert len(os.listdir(tmp_path / "state")) == len(runs_before(50, 4))


def test_events_are_decoded_and_set_apart(spark):
    def event(name, doc, seq):
        return (name, json.dumps(doc), seq, 5, True)

    member = {"user": {"id": "9"}, "nick": None, "roles": ["3"], "joined_at": "2024-01-15T10:00:00.000000+00:00", "flags": 2, "deaf": True}
    rows = spark.createDataFrame([
        event("GUILD_MEMBER_ADD", {"guild_id": "1", **member}, 1),
        event("VOICE_STATE_UPDATE", {"guild_id": "1", "user_id": "9", "member": {**member, "mute": False}}, 2),
        event("GUILD_MEMBER_REMOVE", {"guild_id": "1", "user": {"id": "9"}}, 3),
        event("VOICE_STATE_UPDATE", {"guild_id": None, "user_id": "9", "member": member}, 4),
        event("VOICE_STATE_UPDATE", {"guild_id": "1", "user_id": "9"}, 5),
        event("GUILD_MEMBER_UPDATE", member, 6),
        event("MESSAGE_REACTION_ADD", {"message_id": "4", "user_id": "9", "burst": True, "emoji": {"id": "77", "name": "x"}}, 7),
        event("MESSAGE_REACTION_REMOVE", {"message_id": "4", "user_id": "9", "burst": False, "emoji": {"id": None, "name": "y"}}, 8),
        event("MESSAGE_REACTION_REMOVE_EMOJI", {"message_id": "4", "emoji": {"id": "77", "name": None}}, 9),
        event("MESSAGE_REACTION_REMOVE_ALL", {"message_id": "4"}, 10),
        event("MESSAGE_REACTION_ADD", {"message_id": None, "user_id": "9", "emoji": {"name": "y"}}, 11),
        event("MESSAGE_REACTION_ADD", {"message_id": "4", "emoji": {"name": "y"}}, 12),
        ("GUILD_MEMBER_ADD", "no json", 13, 5, True), ("TYPING_START", "{}", 14, 5, True),
    ], DISPATCH_SCHEMA)
    members, apart = decode_members(rows)
    got = [(r.seq, r.guild_id, r.user_id, r.ts, r.joined_at, r.roles, r.deaf, r.mute, r.pending) for r in members.orderBy("seq").collect()]
    joined = 1_705_312_800_000
    assert got == [(1, 1, 9, 11, joined, [3], True, None, False), (2, 1, 9, 11, joined, [3], True, False, False),
                   (3, 1, 9, 11, None, None, None, None, None)]
    assert sorted(r.seq for r in apart.collect()) == [4, 5, 6, 13]
    log, apart = decode_reactions(rows)
    assert [tuple(r) for r in log.orderBy("seq").collect()] == [
        (4, "custom:77", 1, 9, "add", 11, 7), (4, "unicode:y", 0, 9, "remove", 11, 8),
        (4, "custom:77", None, None, "clear", 11, 9), (4, None, None, None, "clear", 11, 10),
    ]
    assert sorted(r.seq for r in apart.collect()) == [11, 12]


def test_deletions_need_no_state(spark):
    rows = spark.createDataFrame([
        ("GUILD_ROLE_DELETE", '{"guild_id":"1","role_id":"2"}', 1, 5, True), ("MESSAGE_DELETE", '{"id":"3"}', 2, 6, False),
        ("MESSAGE_CREATE", '{"id":"4"}', 3, 7, True),
    ], DISPATCH_SCHEMA)
    assert [tuple(r) for r in S.stream_deletions(rows).collect()] == [("role", 2, 11, 1), ("message", 3, 12, 2)]


def test_replay_flag(spark, hot_mode):
    rows = [(1, i, True, "RESUMED" if i == 4 else "X") for i in range(8)] + [(2, i, False, "X") for i in range(3)]
    df = spark.createDataFrame(rows, "connection long, seq long, resumed boolean, t string")
    got = {(r["connection"], r["seq"]): r["realtime"] for r in S.replay_flag(df).collect()}
    # The RESUMED event itself is still part of the replay.
    assert got == {(1, i): i > 4 for i in range(8)} | {(2, i): True for i in range(3)}
