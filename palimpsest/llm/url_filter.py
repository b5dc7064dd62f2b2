"""URL filters: rules for hosts and paths, and a classifier of segmented names for the rest.

Host names are runs of words. Each distinct name part is split by a unigram Viterbi search, whose word counts come
from the text of all pages; multinomial naive Bayes, trained on the urls that a rule decides, scores the words of
host and path.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's path;
the longest rule wins, of equally long ones the first in the list.

Defined results: NULL and urls without ``://`` have empty host and path, fit no rule and are judged by the method;
a url without a known word, and all urls where no rule fits any, get ``allow``; repeated rows count each; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.staging import staged


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Longer words are looked for inside names by their first letters, as many as this.
LONGEST_WORD = 20
SMOOTHING = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def url_host(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or NULL."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last one asked for wins: the longest, of equally long ones the first in the list.
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower(text), NOT_WORD), lambda w: w != "")


def marked(mark: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(mark), w))


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) over the text of all pages, without tags."""
    visible = F.regexp_replace(F.col(html), "<[^>]*>", " ")
    return pages.select(F.explode(words_of(visible)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, costs: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The cheapest split of ``name`` into known words and single unknown letters; unknown neighbours stay together."""
    longest = max((size for _, size in costs), default=0)
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for end in range(1, len(name) + 1):
        options = [(best[end - 1][0] + unknown, end - 1, False)]
        options += [
            (best[end - size][0] + costs[(end - size, size)], end - size, True)
            for size in range(1, min(end, longest) + 1) if (end - size, size) in costs
        ]
        best.append(min(options))
    parts: list[tuple[str, bool]] = []
    end = len(name)
    while end:
        _, begin, known = best[end]
        if parts and not known and not parts[-1][1]:
            parts[-1] = (name[begin:end] + parts[-1][0], False)
        else:
            parts.append((name[begin:end], known))
        end = begin
    return [p for p, _ in reversed(parts)]


def segmented_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for each distinct name, by the counts of the words that stand inside it.

    Only the words inside a name travel to it: at most its length times LONGEST_WORD and the
    longer words that begin there, so nothing is broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    places = names.select(
        "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")
    ).select("name", "at", F.explode(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("at") + 1))
    ).alias("size")).withColumn("word", F.expr("substring(name, at, size)"))
    longer = counts.where(F.length("word") > LONGEST_WORD).select(
        F.col("word").alias("longer"), "n", F.substring("word", 1, LONGEST_WORD).alias("word"))
    begun = places.where(F.col("size") == LONGEST_WORD).join(longer, "word").where(
        F.expr("substring(name, at, length(longer)) = longer"))
    inside = (
        places.join(counts, "word").select("name", "at", "size", "n")
        .unionByName(begun.select("name", "at", F.length("longer").alias("size"), "n")).groupBy("name")
        .agg(F.collect_list(F.struct((F.col("at") - 1).alias("at"), "size", "n")).alias("edges"))
    )
    unknown = math.log(total) + math.log(10.0)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = []
            for name, edges in zip(batch["name"], batch["edges"]):
                # Letters of their own are no words of a name; a longer word costs less for each letter.
                costs = {(e["at"], e["size"]): math.log(total / e["n"]) for e in edges if e["size"] > 1}
                words.append(viterbi(name, costs, unknown))
            yield pd.DataFrame({"name": batch["name"], "words": words})

    known = inside.mapInPandas(split, "name string, words array<string>")
    return names.join(known, "name", "left").select("name", F.coalesce("words", F.array("name")).alias("words"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is the log odds of ``block``."""
    address = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"),
                           url_path(F.col(url)).alias("path"))
    ruled = staged(address.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules)), "addresses")
    # A hot host or path is one row from here on.
    host_names = ruled.select("host").distinct().select("host", words_of(F.col("host")).alias("names"))
    names = host_names.select(F.explode("names").alias("name")).distinct()
    # The text of the pages is read once; the counts are asked for three times.
    counts = staged(word_counts(pages, html), "word-counts")
    words = staged(segmented_names(names, counts), "names")
    hosts = (
        host_names.select("host", F.explode("names").alias("name")).join(words, "name")
        .select("host", F.explode(marked("h:", F.col("words"))).alias("token"))
    )
    paths = ruled.select("path").distinct().select("path", F.explode(marked("p:", words_of(F.col("path")))).alias("token"))
    block = F.sum(F.col("blocks")).alias("blocks")
    allow = F.sum(F.col("allows")).alias("allows")
    decided = [
        F.sum(F.when(F.col("found.verdict") == "block", 1).otherwise(0)).alias("blocks"),
        F.sum(F.when(F.col("found.verdict") == "allow", 1).otherwise(0)).alias("allows"),
    ]
    tokens = staged(
        hosts.join(ruled.groupBy("host").agg(*decided), "host").select("token", "blocks", "allows").unionByName(
            paths.join(ruled.groupBy("path").agg(*decided), "path").select("token", "blocks", "allows")
        ).groupBy("token").agg(block, allow), "tokens",
    )
    sums = tokens.agg(block, allow, F.count("*").alias("n")).first()
    urls = ruled.agg(*decided).first()
    if not urls or not urls["blocks"] or not urls["allows"]:
        prior, log_odds = 0.0, F.lit(0.0)
    else:
        prior = math.log(urls["blocks"] / urls["allows"])
        log_odds = F.log((F.col("blocks") + SMOOTHING) / (sums["blocks"] + SMOOTHING * sums["n"])) - F.log(
            (F.col("allows") + SMOOTHING) / (sums["allows"] + SMOOTHING * sums["n"]))
    scored = tokens.where("blocks + allows > 0").select("token", log_odds.alias("odds"))
    # Written, so that Spark can split the rows of a hot host or path in the last joins.
    host_odds = staged(hosts.join(scored, "token").groupBy("host").agg(F.sum("odds").alias("host_odds")), "host-odds")
    path_odds = staged(paths.join(scored, "token").groupBy("path").agg(F.sum("odds").alias("path_odds")), "path-odds")
    score = F.when(
        F.col("host_odds").isNull() & F.col("path_odds").isNull(), F.lit(0.0)
    ).otherwise(F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)))
    return ruled.join(host_odds, "host", "left").join(path_odds, "path", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"),
    )
