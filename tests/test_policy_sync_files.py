from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import files as M
from palimpsest.operators import policy as A
from palimpsest.operators import quality as Q
from palimpsest.operators import sync as I
from palimpsest.sources import archive, landing

VIEW, READ = A.VIEW_CHANNEL, A.READ_MESSAGE_HISTORY


def server(spark):
    accounts = spark.createDataFrame(
        [(1, 100, []), (1, 101, [11]), (1, 102, [12]), (1, 103, [13, 14])], "guild_id long, user_id long, roles array<long>"
    )
    roles = spark.createDataFrame([(1, READ), (11, A.ADMINISTRATOR), (12, VIEW), (13, 2), (14, 4)], "id long, permissions long")
    guilds = spark.createDataFrame([(1, 100)], "id long, owner_id long")
    return A.server_permissions(accounts, roles, guilds)


def test_server_permissions(spark):
    got = {r["user_id"]: r["permissions"] for r in server(spark).collect()}
    assert got == {100: -1, 101: -1, 102: READ | VIEW, 103: READ | 6}


def test_channel_permissions(spark):
    channels = spark.createDataFrame([(50, 1, 0), (51, 1, 2)], "id long, guild_id long, type int")
    overwrites = spark.createDataFrame([
        (50, 1, VIEW, READ),            # everyone: deny read, allow view
        (50, 13, 0, VIEW), (50, 14, VIEW, 0),  # allow of one role beats deny of another
        (50, 102, READ, VIEW),          # the member comes last
    ], "channel_id long, target_id long, allow long, deny long")
    rows = A.channel_permissions(server(spark), channels, overwrites)
    got = {(r["user_id"], r["channel_id"]): r["permissions"] for r in rows.collect()}
    assert got[(100, 50)] == -1 and got[(101, 51)] == -1
    assert got[(102, 50)] == READ and got[(103, 50)] == VIEW | 6 and got[(102, 51)] == READ | VIEW
    access = {(r["user_id"], r["channel_id"]): r["can_read"] for r in A.access_matrix(rows).collect()}
    # A voice channel also needs the right to connect.
    assert access[(102, 50)] is False and access[(102, 51)] is False and access[(100, 51)] is True


def test_options(spark):
    servers = spark.createDataFrame([(1,), (2,)], "id long")
    channels = spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id long, guild_id long")
    threads = spark.createDataFrame([(11, 10), (21, 20)], "id long, parent_id long")
    overrides = spark.createDataFrame([
        (0, "server", 1, False, None, None), (1, "channel", 10, None, True, True), (2, "thread", 21, None, None, True),
        (3, "thread", 21, None, None, False),
    ], "seq long, type string, id long, archiveServers boolean, archiveChannels boolean, downloadAttachments boolean")
    rows = {(r["type"], r["id"]): r for r in A.resolve_options(servers, channels, threads, overrides).collect()}
    assert not rows[("server", 1)]["archive"] and not rows[("channel", 10)]["downloadAttachments"]
    assert not rows[("thread", 11)]["archive"]
    assert rows[("thread", 21)]["downloadAttachments"] and rows[("channel", 30)]["archive"]
    assert rows[("channel", 20)]["storeMessageEdits"] and not rows[("channel", 10)]["storeMessageEdits"]


def test_marks(spark):
    marks = spark.createDataFrame([(1, 10), (2, 5), (3, 7)], "channel_id long, last_synced_id long")
    page = spark.createDataFrame([(1, 11), (1, 12), (2, 6)], "channel_id long, id long")
    newest = spark.createDataFrame([(1, 99), (2, 50), (3, None)], "channel_id long, newest_id long")
    got = {r["channel_id"]: r["last_synced_id"] for r in I.advance_mark(marks, page, newest, 2).collect()}
    # Full page; short page up to a deleted newest message; nothing known.
    assert got == {1: 12, 2: 50, 3: 7}
    ids = spark.createDataFrame([(1,), (4,), (5,)], "channel_id long")
    known = spark.createDataFrame([(1,), (4,)], "channel_id long")
    assert {tuple(r) for r in I.high_water_mark(ids, known, marks).collect()} == {(1, 10), (4, 0), (5, None)}
    created = spark.createDataFrame([(1, 20), (2, 3), (3, 99)], "channel_id long, id long")
    live = I.raise_live_marks(marks, created, F.col("channel_id") < 3)
    assert {tuple(r) for r in live.collect()} == {(1, 20), (2, 5), (3, 7)}


def test_chunks(spark):
    chunks = spark.createDataFrame(
        [(1, 1, 0, 2, 5), (1, 1, 1, 2, 6), (1, 2, 0, 2, 7)],
        "guild_id long, request long, chunk_index int, chunk_count int, user_id long",
    )
    complete, members = I.assemble_chunks(chunks)
    assert [tuple(r) for r in complete.collect()] == [(1, 1)]
    assert sorted(r["user_id"] for r in members.collect()) == [5, 6]


def test_registry_first_wins(spark):
    registry = spark.createDataFrame([("a", "h1", None)], "url string, hash string, error_code int")
    results = spark.createDataFrame(
        [("a", "h2", None, 1), ("b", None, 404, 2), ("b", "h3", None, 3), ("c", "h", 5, 4), ("d", None, None, 5)],
        "url string, hash string, error_code int, seq long",
    )
    added, rejected = M.register_files(registry, results)
    assert [tuple(r) for r in added.collect()] == [("b", None, 404)]
    assert sorted(r["url"] for r in rejected.collect()) == ["c", "d"]


def test_store_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    assert M.store_listing(spark, path).count() == 0
    contents = {f"{i % 7:02x}{i:04x}": b"x" * i for i in range(60)} | {"ff": b""}
    rows = spark.createDataFrame([*contents.items(), (None, b"a"), ("0000", None)], "hash string, content binary")
    # A file that two tasks write is one file.
    written = M.store_files(rows.unionByName(rows), path)
    assert written.count() == 2 * len(contents) and written.agg(F.sum("size")).first()[0] == 2 * sum(map(len, contents.values()))
    assert {tuple(r) for r in M.store_listing(spark, path).collect()} == {(h, len(c)) for h, c in contents.items()}
    assert (tmp_path / "store" / "03" / "03000a").read_bytes() == b"x" * 10
    (tmp_path / "store" / "00" / "abcd").write_bytes(b"misplaced")
    (tmp_path / "store" / "stray").write_bytes(b"?")
    (tmp_path / "store" / "01" / "010001").unlink()
    registry = spark.createDataFrame([(h,) for h in contents] + [("9999",), (None,)], "hash string")
    found = {tuple(r) for r in M.store_consistency(registry, M.store_listing(spark, path)).collect()}
    assert found == {("010001", "missing"), ("9999", "missing"), ("00/abcd", "extra"), ("stray/stray", "extra")}


def test_checks(spark):
    users = spark.createDataFrame([(1, 5, 5), (2, 5, None), (3, None, 7)], "id long, flags long, public_flags long")
    assert [r["id"] for r in Q.flags_mismatch(users).collect()] == [2]
    pages = spark.createDataFrame([("p", 0, 9), ("p", 1, 7), ("p", 2, 7), ("q", 0, 8)], "page string, position long, id long")
    assert [(r["position"], r["id"]) for r in Q.page_order_check(pages, ["page"], "position").collect()] == [(2, 7)]


def test_archive_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, None, "c")], "id long, guild_id long, name string")
    path = str(tmp_path / "archive")
    archive.write_archive({"channel": (rows, "guild_id", ["id"])}, path, buckets=4)
    assert sorted(archive.read_latest(spark, path, "channel", ["id"]).collect()) == [(1,), (2,), (3,)]
    assert sorted(r["id"] for r in archive.read_children(spark, path, "channel", 10).collect()) == [1, 2]
    assert [r["id"] for r in archive.read_children(spark, path, "channel", None).collect()] == [3]
    archive.write_archive({"channel": (rows.limit(1), "guild_id", ["id"])}, path, buckets=4)
    assert archive.read_latest(spark, path, "channel").count() == 1


def test_payload_pages(spark, tmp_path):
    rows = spark.createDataFrame([(5, "page", '[{"id":1},{"id":2}]'), (6, "user", '{"id":3}')],
                                 "received_at long, kind string, payload string")
    path = str(tmp_path / "landing")
    landing.write_payloads(rows, path)
    assert landing.read_payloads(spark, path).count() == 3
    assert [r["payload"] for r in landing.read_payloads(spark, path, "user").collect()] == ['{"id":3}']
