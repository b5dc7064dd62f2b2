from __future__ import annotations

import json

from pyspark.sql import functions as F

from palimpsest.functions import documents as D
from palimpsest.functions import scalars as P
from palimpsest.spec import MESSAGE, OBJECT_TYPES, USER
from workload import ALL_QUERIES
from workload.registry import Tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_timing_round_trip(spark):
    assert value(spark, P.encode_timing(F.lit(5), F.lit(True))) == 11
    assert value(spark, P.encode_timing(F.lit(None), F.lit(True))) == 0
    assert value(spark, P.decode_timing(F.lit(11))).asDict() == {"timestamp_ms": 5, "realtime": True}
    assert value(spark, P.decode_timing(F.lit(0))) is None


def test_tags_and_urls(spark):
    assert value(spark, P.user_tag(F.lit("a"), F.lit("0013"))) == "@a#0013"
    assert value(spark, P.user_tag(F.lit("a"), F.lit("0"))) == "@a"
    signed = "https://cdn.discordapp.com/attachments/1/2/x.png?ex=1"
    assert value(spark, P.normalize_media_url(F.lit(signed))) == signed.split("?")[0]
    assert value(spark, P.normalize_media_url(F.lit("https://x.org/a?b"))) == "https://x.org/a?b"
    assert value(spark, P.link_name(F.lit("https://x.org/a/b.tar.gz?c"), F.lit("abcdef"))) == "b.tar-abcd.gz"
    assert value(spark, P.link_name(F.lit("https://x.org/a/b"), F.lit("abcdef"))) == "b-abcd"


def test_emojis_in_text(spark):
    found = value(spark, P.extract_custom_emojis(F.lit("hi <a:wave:12> and <:b_c:3> <x:1>")))
    assert [tuple(e) for e in found] == [(True, "wave", "12"), (False, "b_c", "3")]


def test_iso_times(spark):
    assert value(spark, P.parse_iso_millis(F.lit("2024-01-15T10:00:00.123456+00:00"))) == 1705312800123
    assert value(spark, P.format_iso_millis(F.lit(1705312800123))) == "2024-01-15T10:00:00.123Z"
    assert value(spark, P.format_iso_millis(F.lit(-1))) == "1969-12-31T23:59:59.999Z"


USER_DOCUMENT = {
    "id": "7", "username": "u", "discriminator": "0", "global_name": None, "avatar": "a_1",
    "primary_guild": None, "public_flags": 64, "flags": 64,
    "collectibles": {"nameplate": {"asset": "x", "sku_id": "5", "label": "", "palette": "p", "new": [1]}, "other": None},
    "unknown": {"b": 1, "a": None},
}


def test_user_flatten_and_residual(spark):
    df = spark.createDataFrame([(json.dumps(USER_DOCUMENT),)], "payload string")
    row = D.flatten_object(df, "payload", USER.fields).first()
    assert row["id"] == 7 and row["bot"] is False and row["avatar"] == "a_1"
    assert row["collectibles__nameplate__sku_id"] == 5 and row["primary_guild__tag"] is None
    rest = df.select(D.residual_json("payload", USER.fields).alias("r")).first()["r"]
    assert json.loads(rest) == {
        "collectibles": {"nameplate": {"new": [1]}, "other": None}, "unknown": {"a": None, "b": 1},
    }


def test_export_undoes_flatten(spark):
    df = spark.createDataFrame([(json.dumps(USER_DOCUMENT),)], "payload string")
    flat = D.flatten_object(
        df.withColumn("_extra", D.residual_json("payload", USER.fields)), "payload", USER.fields, ["_extra"]
    )
    out = json.loads(D.export_documents(flat, USER.fields).first()["json"])
    wanted = {k: v for k, v in USER_DOCUMENT.items() if k not in ("discriminator", "flags")}
    wanted |= {"bot": False, "system": False, "avatar_decoration_data": None, "display_name_styles": None}
    wanted["collectibles"]["nameplate"]["expires_at"] = None
    # All leaves of this group may be null, so a missing group and one of nulls look alike; readers
    # fold it with ``collapse_empty_struct``.
    wanted["primary_guild"] = dict.fromkeys(("identity_guild_id", "identity_enabled", "tag", "badge"))
    assert out == wanted


def test_message_residual_drops_empty_lists_only(spark):
    doc = {"id": "1", "embeds": [], "components": [{"type": 1}], "poll": None, "nonce": "x",
           "interaction_metadata": {"type": 2, "target_user": {"id": "1"}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "payload string")
    rest = df.select(D.residual_json("payload", MESSAGE.fields).alias("r")).first()["r"]
    assert json.loads(rest) == {"components": [{"type": 1}], "poll": None, "interaction_metadata": {"type": 2}}


def test_no_residual_is_null(spark):
    df = spark.createDataFrame([('{"id":"1","username":"x"}',)], "payload string")
    assert df.select(D.residual_json("payload", USER.fields).alias("r")).first()["r"] is None


def test_specs_name_their_columns():
    for kind in OBJECT_TYPES.values():
        flat = set(D.flat_columns(kind.fields))
        own = {c for c in (*kind.immutable, *kind.mutable) if not c.startswith("_")}
        custom = {"discriminator", "author__id", "message_reference__message_id", "message_reference__channel_id",
                  "message_reference__guild_id", "user__id", "emoji", "channel_id"}
        assert own - custom <= flat, kind.name


def test_collapse_empty_struct(spark):
    empty = F.struct(F.lit(None).cast("string").alias("tag"), F.lit(False).alias("on"))
    full = F.struct(F.lit("x").alias("tag"), F.lit(False).alias("on"))
    assert value(spark, P.collapse_empty_struct(empty, ["tag", "on"])) is None
    assert value(spark, P.collapse_empty_struct(full, ["tag", "on"]))["tag"] == "x"


def test_round_trips_of_one_file_are_spread(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("S6_round_trip_message", "S6_round_trip_role"):
        rows = ALL_QUERIES[name].run(Tables(spark, str(tmp_path))).withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == 100 and len({r["task"] for r in rows}) >= 8
