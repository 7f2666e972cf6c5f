"""URL filters from dated lists: validity intervals and an as-of join.

A list changes by dated entries: a key is added or removed. Entries become
intervals in which the key is on the list, and each capture is joined with the
intervals of its keys that hold its fetch day. Everything is plain DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countercheck.functions.names import free_name
from countercheck.llm.support import put, stored

FOREVER = "9999-12-31"
KINDS = ("domain", "host", "prefix")
# Scheme, user, host and path of a URL.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a dot at its end; null if there is none."""
    host = F.lower(F.regexp_extract(url, URL, 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``kind``, ``key``, ``valid_from`` and ``valid_to`` (exclusive) of dated entries.

    ``entries`` has list, kind, key, day and action (add or remove). An entry
    holds until the next of its list and key, the last one for ever. Of several
    on a day a removal counts. Rows with a null in any of these columns, or
    another kind or action, are no entries. Hosts and domains are lower-cased; of
    a prefix only the host, as paths differ by case.
    """
    known = entries.filter(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove"))
    known = known.filter("list is not null and key is not null and day is not null")
    host = F.substring_index("key", "/", 1)
    rest = F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)")
    key = F.when(F.col("kind") == "prefix", F.concat(F.lower(host), rest)).otherwise(F.lower("key"))
    days = known.groupBy("list", "kind", key.alias("key"), F.col("day").cast("date").alias("day"))
    days = days.agg(F.max("action").alias("action"))
    following = F.lead("day").over(W.partitionBy("list", "kind", "key").orderBy("day"))
    spans = days.withColumn("valid_to", F.coalesce(following, F.lit(FOREVER).cast("date")))
    return spans.filter("action = 'add'").select("list", "kind", "key", F.col("day").alias("valid_from"), "valid_to")


def _keys(depths: dict[str, list[int]]) -> Column:
    """All keys (kind, key, weight) that entries of these depths could match.

    Longer keys weigh more: a domain by its labels, a host above all domains,
    a prefix above all hosts by its path segments.
    """
    host, segments = F.col("url host"), F.col("url segments")
    labels = F.split(host, r"\.")

    def key(kind: str, value: Column, weight: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"), weight.cast("int").alias("weight"))

    def domain(n: int) -> Column:
        own = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
        return F.when(F.size(labels) >= n, key("domain", own, F.lit(n)))

    def prefix(n: int) -> Column:
        own = F.concat_ws("/", host, F.array_join(F.slice(segments, 1, n), "/"))
        return F.when(F.size(segments) >= n, key("prefix", own, F.lit(2000 + n)))

    all_keys = [domain(n) for n in depths["domain"]] + [prefix(n) for n in depths["prefix"]]
    return F.array_compact(F.array(key("host", host, F.lit(1000)), *all_keys))


def _depths(spans: DataFrame) -> dict[str, list[int]]:
    """How many labels or segments the listed keys have: a row for each such number."""
    parts = F.when(F.col("kind") == "domain", F.size(F.split("key", r"\."))).otherwise(F.size(F.split("key", "/")) - 1)
    rows = spans.filter("kind <> 'host'").select("kind", parts.alias("n")).distinct().collect()
    return {kind: sorted(r["n"] for r in rows if r["kind"] == kind and r["n"] > 0) for kind in ("domain", "prefix")}


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """The captures with ``host``, ``decision`` and the entry behind it.

    Adds ``host``, ``decision`` (the list of the entry that decides, or
    ``none``), ``entry_kind``, ``entry_key``, ``valid_from`` and ``valid_to``;
    columns of these names give way. Of the entries active on the capture's day
    the longest key decides: URL prefixes (host and whole path segments) before
    hosts before domains (a host's last labels); of equal keys the first list by
    name, so ``allow`` before ``block``.

    A capture with a null URL, host or day matches nothing. All rows stay,
    repeated ones too. Keys of any number of labels and segments are matched.
    Captures are exploded to their keys without the URL; a hot host makes a hot
    join key, whose side of captures is split between tasks as it is a plain
    scan.
    """
    spans = stored(intervals(entries), "url-intervals")
    row, entry = free_name(captures.columns, "url row"), free_name(captures.columns, "url entry")
    rows = stored(put(captures, {row: F.monotonically_increasing_id()}), "url-captures")
    segments = F.filter(F.split(path_of(F.col(f"`{url}`")), "/"), lambda s: s != "")
    asked = rows.select(row, host_of(F.col(f"`{url}`")).alias("url host"), segments.alias("url segments"), F.col(f"`{day}`").cast("date").alias("url day"))
    asked = asked.filter("`url host` is not null and `url day` is not null")
    asked = asked.select(row, "url day", F.explode(_keys(_depths(spans))).alias("k")).select(row, "url day", "k.*")
    asked = stored(asked, "url-keys")
    active = (F.col("url day") >= F.col("valid_from")) & (F.col("url day") < F.col("valid_to"))
    hits = asked.join(spans, ["kind", "key"]).filter(active)
    first = F.struct(-F.col("weight"), F.col("list"), F.col("kind"), F.col("key"), F.col("valid_from"), F.col("valid_to"))
    best = stored(hits.groupBy(row).agg(F.min(first).alias(entry)), "url-decisions")
    out = rows.join(best, row, "left")
    return put(
        out,
        {
            "host": host_of(F.col(f"`{url}`")),
            "decision": F.coalesce(F.col(entry)["list"], F.lit("none")),
            "entry_kind": F.col(entry)["kind"],
            "entry_key": F.col(entry)["key"],
            "valid_from": F.col(entry)["valid_from"],
            "valid_to": F.col(entry)["valid_to"],
        },
    ).drop(row, entry)
