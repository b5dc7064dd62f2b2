"""Object types of the archive: keys, parents, column split, JSON fields.

Fixed values of the archived data model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from palimpsest.functions.documents import (
    ABSENT, EMPTY_ARRAY, NULL, Extra, Group, Ignored, Leaf, Spec,
)


@dataclass(frozen=True)
class ObjectType:
    name: str
    key: tuple[str, ...]
    parent: str | None
    immutable: tuple[str, ...]
    mutable: tuple[str, ...]
    fields: Spec = field(default=())


def _ignored(*names: str) -> tuple[Ignored, ...]:
    return tuple(Ignored(n) for n in names)


def _decoration(null: str) -> Group:
    return Group("avatar_decoration_data", (
        Leaf("asset", "hash"), Leaf("sku_id", "id"), Leaf("expires_at", "integer", NULL),
    ), null)


def _collectibles(null: str) -> Group:
    return Group("collectibles", (
        Group("nameplate", (
            Leaf("asset", "string"), Leaf("sku_id", "id"), Leaf("label", "string"),
            Leaf("palette", "string"), Leaf("expires_at", "integer", NULL),
        ), NULL),
    ), null)


def _name_styles(null: str) -> Group:
    return Group("display_name_styles", (
        Leaf("font_id", "integer"), Leaf("effect_id", "integer"), Leaf("colors", "json"),
    ), null)


PROFILE_COLUMNS = (
    "avatar_decoration_data__asset", "avatar_decoration_data__sku_id",
    "avatar_decoration_data__expires_at", "collectibles__nameplate__asset",
    "collectibles__nameplate__sku_id", "collectibles__nameplate__label",
    "collectibles__nameplate__palette", "collectibles__nameplate__expires_at",
    "display_name_styles__font_id", "display_name_styles__effect_id", "display_name_styles__colors",
)

USER = ObjectType(
    "user", ("id",), None,
    ("bot", "system"),
    ("username", "discriminator", "global_name", "avatar", *PROFILE_COLUMNS,
     "primary_guild__identity_guild_id", "primary_guild__identity_enabled", "primary_guild__tag",
     "primary_guild__badge", "public_flags"),
    (
        Leaf("id", "id"), Leaf("username", "string"), Ignored("discriminator"),
        Leaf("global_name", "string", NULL), Leaf("avatar", "hash", NULL),
        _decoration(NULL), _collectibles(NULL), _name_styles(NULL), Ignored("clan"),
        Group("primary_guild", (
            Leaf("identity_guild_id", "id", NULL), Leaf("identity_enabled", "boolean", NULL),
            Leaf("tag", "string", NULL), Leaf("badge", "hash", NULL),
        ), NULL),
        Leaf("bot", "strict_boolean"), Leaf("system", "strict_boolean"),
        *_ignored("pronouns", "bio", "banner", "banner_color", "accent_color", "flags"),
        Leaf("public_flags", "integer", ABSENT), *_ignored("display_name", "member"),
    ),
)

GUILD = ObjectType(
    "guild", ("id",), None, (),
    ("name", "icon", "splash", "discovery_splash", "owner_id", "afk_channel_id", "afk_timeout",
     "widget_enabled", "widget_channel_id", "verification_level", "default_message_notifications",
     "explicit_content_filter", "mfa_level", "system_channel_id", "system_channel_flags",
     "rules_channel_id", "max_presences", "max_members", "vanity_url_code", "description", "banner",
     "premium_tier", "premium_subscription_count", "preferred_locale", "public_updates_channel_id",
     "max_video_channel_users", "max_stage_video_channel_users", "nsfw_level",
     "premium_progress_bar_enabled", "profile__tag", "profile__badge"),
    (
        Leaf("id", "id"), Leaf("name", "string"), Leaf("icon", "hash", NULL),
        Leaf("splash", "hash", NULL), Leaf("discovery_splash", "hash", NULL),
        Leaf("owner_id", "id", NULL), Leaf("afk_channel_id", "id", NULL),
        Leaf("afk_timeout", "integer"), Leaf("widget_enabled", "strict_boolean"),
        Leaf("widget_channel_id", "id", NULL), Leaf("verification_level", "integer"),
        Leaf("default_message_notifications", "integer"), Leaf("explicit_content_filter", "integer"),
        Leaf("mfa_level", "integer"), Leaf("system_channel_id", "id", NULL),
        Leaf("system_channel_flags", "integer"), Leaf("rules_channel_id", "id", NULL),
        Leaf("max_presences", "integer", NULL), Leaf("max_members", "integer", NULL),
        Leaf("vanity_url_code", "string", NULL), Leaf("description", "string", NULL),
        Leaf("banner", "hash", NULL), Leaf("premium_tier", "integer"),
        Leaf("premium_subscription_count", "integer", ABSENT), Leaf("preferred_locale", "string"),
        Leaf("public_updates_channel_id", "id", NULL),
        Leaf("max_video_channel_users", "integer", ABSENT),
        Leaf("max_stage_video_channel_users", "integer", ABSENT), Leaf("nsfw_level", "integer"),
        Leaf("premium_progress_bar_enabled", "strict_boolean"),
        Group("profile", (Leaf("tag", "string"), Leaf("badge", "hash")), NULL),
        *_ignored(
            "owner", "permissions", "region", "roles", "emojis", "features", "application_id",
            "approximate_member_count", "approximate_presence_count", "welcome_screen", "nsfw", "stickers",
            "safety_alerts_channel_id", "incidents_data", "large", "unavailable", "member_count",
            "voice_states", "members", "channels", "threads", "presences", "stage_instances",
            "guild_scheduled_events", "soundboard_sounds", "joined_at", "guild_id", "moderator_reporting",
            "activity_instances", "hub_type", "latest_onboarding_question_id", "premium_features",
            "owner_configured_content_level", "embedded_activities", "lazy", "application_command_counts",
            "home_header", "version", "inventory_settings",
        ),
    ),
)

ROLE = ObjectType(
    "role", ("id",), "_guild_id",
    ("_guild_id", "managed", "tags__bot_id", "tags__premium_subscriber"),
    ("name", "colors__primary_color", "colors__secondary_color", "colors__tertiary_color", "hoist",
     "icon", "unicode_emoji", "position", "permissions", "mentionable", "flags",
     "tags__integration_id", "tags__subscription_listing_id", "tags__available_for_purchase",
     "tags__guild_connections"),
    (
        Leaf("id", "id"), Leaf("name", "string"), Extra("description", ABSENT), Ignored("color"),
        Group("colors", (
            Leaf("primary_color", "integer"), Leaf("secondary_color", "integer", NULL),
            Leaf("tertiary_color", "integer", NULL),
        )),
        Leaf("hoist", "boolean"), Leaf("icon", "hash", NULL), Leaf("unicode_emoji", "string", NULL),
        Leaf("position", "integer"), Leaf("permissions", "id"), Leaf("managed", "boolean"),
        Leaf("mentionable", "boolean"),
        Group("tags", (
            Leaf("bot_id", "id", ABSENT), Leaf("integration_id", "id", ABSENT),
            Leaf("premium_subscriber", "present", ABSENT),
            Leaf("subscription_listing_id", "id", ABSENT),
            Leaf("available_for_purchase", "present", ABSENT),
            Leaf("guild_connections", "present", ABSENT),
        ), ABSENT),
        Leaf("flags", "integer"), Ignored("version"),
    ),
)

MEMBER = ObjectType(
    "member", ("_guild_id", "_user_id"), "_guild_id", ("_guild_id", "_user_id"),
    ("nick", "avatar", *PROFILE_COLUMNS, "banner", "roles", "joined_at", "premium_since", "deaf",
     "mute", "flags", "pending", "communication_disabled_until"),
    (
        Ignored("user"), Leaf("nick", "string", NULL), Leaf("avatar", "hash", NULL),
        _decoration(ABSENT), _collectibles(ABSENT), _name_styles(ABSENT),
        Leaf("banner", "hash", NULL), Leaf("roles", "ids"), Leaf("joined_at", "timestamp"),
        Leaf("premium_since", "timestamp", NULL), Leaf("deaf", "boolean", ABSENT),
        Leaf("mute", "boolean", ABSENT), Leaf("flags", "integer"), Leaf("pending", "strict_boolean"),
        Leaf("communication_disabled_until", "timestamp", NULL),
        *_ignored("unusual_dm_activity_until", "guild_id"),
    ),
)

CHANNEL = ObjectType(
    "channel", ("id",), "guild_id", ("guild_id", "type"),
    ("position", "permission_overwrites", "name", "topic", "nsfw", "bitrate", "user_limit",
     "rate_limit_per_user", "icon", "owner_id", "parent_id", "rtc_region", "video_quality_mode",
     "default_auto_archive_duration", "flags", "default_reaction_emoji",
     "default_thread_rate_limit_per_user", "default_sort_order", "default_forum_layout",
     "default_tag_setting"),
    (
        Leaf("id", "id"), Leaf("type", "integer"), Leaf("guild_id", "id", ABSENT),
        Leaf("position", "integer", ABSENT),
        # Kept as JSON text; ``policy.overwrites_from_json`` makes rows of it.
        Leaf("permission_overwrites", "json", ABSENT),
        Leaf("name", "string", NULL), Leaf("topic", "string", NULL), Leaf("nsfw", "boolean", ABSENT),
        Leaf("bitrate", "integer", ABSENT), Leaf("user_limit", "integer", ABSENT),
        Leaf("rate_limit_per_user", "integer", ABSENT), Leaf("icon", "hash", NULL),
        Leaf("owner_id", "id", ABSENT), Leaf("parent_id", "id", NULL),
        Leaf("rtc_region", "string", NULL), Leaf("video_quality_mode", "integer", ABSENT),
        Leaf("default_auto_archive_duration", "integer", ABSENT), Leaf("flags", "integer", ABSENT),
        Leaf("default_reaction_emoji", "json", NULL),
        Leaf("default_thread_rate_limit_per_user", "integer", ABSENT),
        Leaf("default_sort_order", "integer", NULL), Leaf("default_forum_layout", "integer", ABSENT),
        Leaf("default_tag_setting", "string", ABSENT),
        *_ignored(
            "last_message_id", "recipients", "application_id", "last_pin_timestamp", "permissions",
            "available_tags", "icon_emoji", "theme_color", "status", "hd_streaming_until",
            "hd_streaming_buyer_id", "linked_lobby", "voice_background_display", "template", "version",
        ),
    ),
)

THREAD = ObjectType(
    "thread", ("id",), "parent_id", ("parent_id", "type"),
    ("name", "rate_limit_per_user", "owner_id", "thread_metadata__archived",
     "thread_metadata__auto_archive_duration", "thread_metadata__archive_timestamp",
     "thread_metadata__locked", "thread_metadata__invitable", "thread_metadata__create_timestamp",
     "flags", "applied_tags"),
    (
        Leaf("id", "id"), Leaf("type", "integer"), Leaf("flags", "integer", ABSENT),
        Leaf("name", "string", NULL), Leaf("rate_limit_per_user", "integer"),
        Leaf("owner_id", "id"), Leaf("parent_id", "id", NULL),
        Group("thread_metadata", (
            Leaf("archived", "boolean"), Leaf("auto_archive_duration", "integer"),
            Leaf("archive_timestamp", "timestamp"), Leaf("locked", "boolean"),
            Leaf("invitable", "boolean", ABSENT), Leaf("create_timestamp", "timestamp", ABSENT),
        ), ABSENT),
        Leaf("applied_tags", "ids", ABSENT),
        *_ignored(
            "guild_id", "last_message_id", "last_pin_timestamp", "message_count", "member_count", "member",
            "total_message_sent", "bitrate", "rtc_region", "user_limit",
        ),
    ),
)

FORUM_TAG = ObjectType(
    "forum_tag", ("id",), "channel_id", ("channel_id",), ("name", "moderated", "emoji"),
    (
        Leaf("id", "id"), Leaf("name", "string"), Leaf("moderated", "boolean"),
        *_ignored("emoji_id", "emoji_name", "color", "version"),
    ),
)

MESSAGE = ObjectType(
    "message", ("id",), "channel_id",
    ("channel_id", "author__id", "tts", "type", "message_reference__message_id",
     "message_reference__channel_id", "message_reference__guild_id", "_sticker_ids"),
    ("content", "edited_timestamp", "mention_everyone", "_mention_ids", "mention_roles", "flags",
     "_attachment_ids"),
    (
        Leaf("id", "id"), Leaf("channel_id", "id"), Leaf("content", "string"),
        Leaf("edited_timestamp", "timestamp", NULL), Leaf("tts", "boolean"),
        Leaf("mention_everyone", "strict_boolean"), Leaf("mention_roles", "ids"),
        Extra("embeds", EMPTY_ARRAY), Leaf("type", "integer"), Extra("activity"),
        Extra("application"), Extra("application_id"), Leaf("flags", "integer"),
        Extra("message_snapshots"),
        Group("interaction_metadata", (
            Extra("id"), Extra("type", None), Extra("name"), Extra("command_type"),
            Extra("ephemerality_reason"), Extra("user"), Extra("original_response_message_id"),
            Extra("interacted_message_id"), Extra("target_message_id"),
            *_ignored("authorizing_integration_owners", "triggering_interaction_metadata", "target_user"),
        ), ABSENT),
        Extra("components", EMPTY_ARRAY), Extra("sticker_items"), Extra("role_subscription_data"),
        Extra("poll"), Extra("call"),
        *_ignored(
            "author", "timestamp", "mentions", "mention_channels", "attachments", "reactions", "pinned",
            "webhook_id", "message_reference", "referenced_message", "interaction", "thread", "stickers",
            "position", "resolved", "activity_instance", "channel_type", "guild_id", "member", "metadata",
            "nonce",
        ),
    ),
)

ATTACHMENT = ObjectType(
    "attachment", ("id",), "_message_id",
    ("_message_id", "filename", "title", "description", "content_type", "original_content_type",
     "size", "height", "width", "ephemeral", "duration_secs", "waveform", "flags"),
    (),
    (
        Leaf("id", "id"), Leaf("filename", "string"), Leaf("title", "string", ABSENT),
        Leaf("description", "string", ABSENT), Leaf("content_type", "string", ABSENT),
        Leaf("original_content_type", "string", ABSENT), Leaf("size", "integer"),
        Leaf("height", "integer", ABSENT), Leaf("width", "integer", ABSENT),
        Leaf("ephemeral", "strict_boolean"), Leaf("duration_secs", "float", ABSENT),
        Leaf("waveform", "base64", ABSENT), Leaf("flags", "integer", ABSENT),
        Extra("clip_created_at"), Extra("clip_participants"), Extra("application"),
        *_ignored("url", "proxy_url", "content_scan_version", "placeholder_version", "placeholder"),
    ),
)

GUILD_EMOJI = ObjectType(
    "guild_emoji", ("id",), "_guild_id",
    ("_guild_id", "user__id", "require_colons", "managed", "animated"), ("name", "roles"),
    (
        Leaf("id", "id"), Leaf("require_colons", "strict_boolean"), Leaf("managed", "strict_boolean"),
        Leaf("animated", "strict_boolean"), Leaf("name", "string"), Leaf("roles", "ids", ABSENT),
        *_ignored("user", "available", "version"),
    ),
)

OBJECT_TYPES = {
    t.name: t
    for t in (
        USER, GUILD, ROLE, MEMBER, CHANNEL, THREAD, FORUM_TAG, MESSAGE, ATTACHMENT, GUILD_EMOJI,
    )
}

# Message types that embed the message they refer to: thread starter 21, reply 19, context menu 23.
REFERENCING_TYPES = (19, 21, 23)
