"""Word search over current messages: postings, queries on them, hits with names.

Postings are (token, id, positions); ``sources.segments`` stores them sorted by token, so that a term reads few row groups.
Old versions are not indexed, deleted messages stay searchable, results are not ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import MARKED, PLAIN, fold_term, term_words, tokens
from palimpsest.plans.ordered import join_known
from palimpsest.plans.spread import spread


def build_index(messages: DataFrame, id_: str = "id", content: str = "content") -> DataFrame:
    """Postings of the current content, without a shuffle.

    All positions of a word in a message come from one row, so they are grouped inside that row:
    sort (word, position), find where a new word begins, cut there.
    """
    # No filter on what is computed here: it would move below ``spread`` and run there.
    sorted_words = spread(messages.select(F.col(id_).alias("id"), F.col(content).alias("content"))).select(
        "id",
        F.sort_array(F.transform(
            tokens("content"), lambda w, i: F.struct(w.alias("token"), i.alias("pos"))
        )).alias("words"),
    )
    split = sorted_words.select(
        "id", F.col("words.token").alias("tokens"), F.col("words.pos").alias("spots")
    )
    # Position (from 1) of each word that differs from the one before.
    before = F.concat(F.array(F.lit("")), F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))))
    begun = split.withColumn("starts", F.array_compact(F.transform(
        F.zip_with("tokens", before, lambda token, last: token != last),
        lambda new, i: F.when(new, i + 1),
    )))

    def posting(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("tokens") + 1)
        return F.struct(
            F.get("tokens", start - 1).alias("token"), F.slice("spots", start, end - start).alias("positions")
        )

    return begun.select("id", F.explode(F.transform("starts", posting)).alias("p")).select(
        "p.token", "id", "p.positions"
    )


def _words(terms: Sequence[str]) -> list[str]:
    return [w for term in terms for w in term_words(term)]


def search_any(postings: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Ids of messages with any of the terms."""
    return postings.where(F.col("token").isin(*_words(terms))).select("id").distinct()


def search_all(postings: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Ids of messages with every term."""
    words = sorted(set(_words(terms)))
    hits = postings.where(F.col("token").isin(*words))
    # (token, id) is unique in the postings.
    return hits.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(words)).select("id")


def _positions_by_word(postings: DataFrame, words: Sequence[str]) -> DataFrame:
    """(id, one positions column per distinct word); a group has one row per word."""
    distinct = sorted(set(words))
    return (
        postings.where(F.col("token").isin(*distinct))
        .groupBy("id")
        .agg(*[
            F.any_value(F.when(F.col("token") == w, F.col("positions")), True).alias(f"p{i}")
            for i, w in enumerate(distinct)
        ])
    )


def search_phrase(postings: DataFrame, phrase: str | Sequence[str]) -> DataFrame:
    """Ids of messages with the words at consecutive positions; one shuffle for any length."""
    words = _words([phrase] if isinstance(phrase, str) else phrase)
    column = {w: f"p{i}" for i, w in enumerate(sorted(set(words)))}

    def shift(word: str, offset: int) -> Column:
        return F.transform(column[word], lambda p: p - offset)

    starts = None
    for offset, word in enumerate(words):
        shifted = shift(word, offset)
        starts = shifted if starts is None else F.array_intersect(starts, shifted)
    return _positions_by_word(postings, words).where(F.size(starts) > 0).select("id")


def search_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    """Ids of messages with a word that begins so."""
    return postings.where(F.col("token").startswith(fold_term(prefix))).select("id").distinct()


def search_not(wanted: DataFrame, unwanted: DataFrame) -> DataFrame:
    return wanted.join(unwanted, "id", "left_anti")


def search_near(postings: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """Ids of messages with two words and at most ``distance`` words between them."""
    words = [fold_term(first), fold_term(second)]
    column = {w: f"p{i}" for i, w in enumerate(sorted(set(words)))}

    def marked(word: str) -> Column:
        return F.transform(column[word], lambda p: F.struct(p.alias("at"), F.lit(words.index(word)).alias("word")))

    # In the merged order of both words the closest two places stand next to each other.
    merged = F.array_sort(F.concat(*[marked(w) for w in column]))
    last = F.greatest(F.size(merged) - 1, F.lit(0))
    near = F.zip_with(
        F.slice(merged, 1, last), F.slice(merged, 2, last),
        lambda a, b: (b["at"] - a["at"] <= distance + 1) & ((a["word"] != b["word"]) | F.lit(len(column) == 1)),
    )
    return _positions_by_word(postings, words).where(F.exists(near, lambda x: x)).select("id")


def _term_pattern(words: Sequence[str]) -> str:
    """Words in a row as they may be written: any case, any one-mark letters."""
    written: dict[str, str] = {}
    for marked, plain in zip(MARKED, PLAIN):
        written[plain.lower()] = written.get(plain.lower(), "") + marked.lower() + marked.upper()

    def letter(ch: str) -> str:
        variants = "".join(sorted(set(ch + ch.upper() + written.get(ch, ""))))
        return f"[{variants}][\\u0300-\\u036f]*"

    between = r"[^\p{L}\p{N}\p{Co}]+"
    body = between.join("".join(letter(ch) for ch in word) for word in words)
    return rf"(?<![\p{{L}}\p{{N}}\p{{Co}}]){body}(?![\p{{L}}\p{{N}}\p{{Co}}])"


def highlight(content: str | Column, terms: Sequence[str], start: str, end: str) -> Column:
    """The content with marks around each matched term; a phrase is one match."""
    # Longer phrases first, so that a phrase is not cut by one of its words.
    phrases = sorted((term_words(t) for t in terms), key=len, reverse=True)
    pattern = "|".join(_term_pattern(words) for words in phrases if words)
    column = F.col(content) if isinstance(content, str) else content

    def quoted(mark: str) -> str:
        return mark.replace("\\", "\\\\").replace("$", "\\$")

    return F.regexp_replace(column, f"({pattern})", f"{quoted(start)}$1{quoted(end)}")


def search_results(
    hits: DataFrame,
    messages: DataFrame,
    users: DataFrame,
    webhooks: DataFrame,
    channels: DataFrame,
    threads: DataFrame,
    guilds: DataFrame,
) -> DataFrame:
    """Hits with author, channel, parent channel and server names.

    Threads resolve through the thread table; the server is the channel's or its parent's, found
    with one equality join after both are brought into one column.
    """
    rows = hits.join(messages, "id")
    people = users.select(
        F.col("id").alias("author_id"), F.col("username").alias("_user"), F.col("discriminator").alias("_disc")
    )
    personas = webhooks.select(F.col("internal_id").alias("author_id"), F.col("username").alias("_persona"))
    # An unknown kind of author is looked up among the users; every hit stays.
    is_webhook = F.coalesce(F.col("author_kind") == "webhook", F.lit(False))
    rows = rows.withColumns({
        "_person": F.when(~is_webhook, F.col("author_id")), "_number": F.when(is_webhook, F.col("author_id")),
    })
    named = join_known(rows, people.withColumnRenamed("author_id", "_person"), "_person")
    named = join_known(named, personas.withColumnRenamed("author_id", "_number"), "_number").drop("_person", "_number")

    own = channels.select(
        F.col("id").alias("channel_id"), F.col("name").alias("channel_name"),
        F.lit(None).cast("long").alias("parent_channel_id"), F.lit(None).cast("string").alias("parent_channel_name"),
        F.col("guild_id"),
    )
    parents = channels.select(
        F.col("id").alias("parent_channel_id"), F.col("name").alias("parent_channel_name"), F.col("guild_id")
    )
    below = threads.select(
        F.col("id").alias("channel_id"), F.col("name").alias("channel_name"), F.col("parent_id").alias("parent_channel_id")
    ).join(parents, "parent_channel_id", "left")
    places = own.unionByName(below)
    servers = guilds.select(F.col("id").alias("guild_id"), F.col("name").alias("guild_name"))
    return (
        named.join(places, "channel_id", "left")
        .join(servers, "guild_id", "left")
        .withColumns({
            "username": F.coalesce("_user", "_persona"),
            "discriminator": F.col("_disc"),
            "is_webhook": F.col("author_kind") == "webhook",
        })
        .drop("_user", "_persona", "_disc")
    )
