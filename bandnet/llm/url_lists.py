"""URL filters over time: dated list entries become validity intervals, and each capture is judged as of its fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\\]*)"
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, null without one.

    It stands behind the last ``@`` of the authority, before the port, in brackets if it is an IPv6 address; percent
    escapes are decoded (an escape that is none stays as it is), and dots at the end do not count.
    """
    authority = F.regexp_extract(url, AUTHORITY, 1)
    place = F.regexp_replace(authority, "^.*@", "")
    host = F.when(F.startswith(place, F.lit("[")), F.regexp_extract(place, r"^(\[[^\]]*\]?)", 1)).otherwise(F.regexp_extract(place, "^([^:]*)", 1))
    host = F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)
    host = F.rtrim(F.lower(host), F.lit("."))
    return F.when(host != "", host)


def host_keys(host: Column) -> Column:
    """The host and its parent domains of at least two labels, the host first; a host of one label is its own key.

    An address has no parents: it is its own key too.
    """
    parts = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1))
    parents = F.transform(starts, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.regexp_like(host, F.lit(ADDRESS)), F.array(host)).otherwise(parents)


def validity_intervals(entries: DataFrame, key: str = "key", at: str = "listed_at", action: str = "action") -> DataFrame:
    """``(key, action, listed_at, until)``: an entry holds until the next one of its key, the last one for good.

    Entries with a null in any of the three say nothing. Of entries of one key at one time the last action by name
    holds, so ``block`` beats ``allow``; repeated entries count once.
    """
    usable = entries.select(F.lower(key).alias("key"), F.col(at).alias("listed_at"), F.col(action).alias("action")).dropna()
    usable = usable.groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    return usable.withColumn("until", F.lead("listed_at").over(Window.partitionBy("key").orderBy("listed_at")))


def judge_captures(
    captures: DataFrame,
    entries: DataFrame,
    url: str = "url",
    fetched_at: str = "fetched_at",
    key: str = "key",
    listed_at: str = "listed_at",
    action: str = "action",
    bucket_days: int = 30,
) -> DataFrame:
    """Add ``host``, ``matched_key``, ``verdict`` and ``since`` to every capture.

    Keys are hosts or parent domains. Of the keys of a capture's host that have an entry holding at its fetch time (from
    its date on, until before the next one), the longest decides: ``verdict`` is its action, ``since`` its date. Without
    one, and for captures without host or fetch time, all three are null.

    Captures are first reduced to distinct hosts and times. Intervals are cut at multiples of ``bucket_days`` up to the
    last fetch time, and the join is on key and stretch of time, so a key that a third of all captures share and that
    changes often meets only the entries of its time. Repeated captures are judged alike and kept; empty tables are
    fine; columns named like the new ones are replaced, all others stay.
    """
    captures = captures.drop("host", "matched_key", "verdict", "since")
    bucket = lambda t: F.floor(F.unix_timestamp(t) / (86_400 * bucket_days))
    probes = captures.select(host_of(F.col(url)).alias("p_host"), F.col(fetched_at).cast("timestamp").alias("p_at")).dropna().distinct()
    keyed = probes.select("p_host", "p_at", F.explode(host_keys(F.col("p_host"))).alias("key"), bucket(F.col("p_at")).alias("bucket"))
    bounds = probes.agg(F.max(bucket(F.col("p_at"))).alias("top"), F.min(bucket(F.col("p_at"))).alias("bottom"))
    intervals = validity_intervals(entries.withColumn(listed_at, F.col(listed_at).cast("timestamp")), key, listed_at, action)
    # One row of two numbers, joined to every interval
    intervals = intervals.join(F.broadcast(bounds), F.col("listed_at").isNotNull())
    first = F.greatest(bucket(F.col("listed_at")), "bottom")
    last = F.least(F.coalesce(bucket(F.col("until")), "top"), "top")
    intervals = intervals.where(first <= last).select("key", "action", "listed_at", "until", F.explode(F.sequence(first, last)).alias("bucket"))
    active = (F.col("listed_at") <= F.col("p_at")) & (F.col("until").isNull() | (F.col("p_at") < F.col("until")))
    met = keyed.join(intervals, ["key", "bucket"]).where(active)
    best = met.groupBy("p_host", "p_at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action", "listed_at")).alias("best"))
    captures = captures.withColumn("host", host_of(F.col(url)))
    joined = captures.join(best, (F.col("host") == F.col("p_host")) & (F.col(fetched_at).cast("timestamp") == F.col("p_at")), "left")
    return joined.select(
        *captures.columns,
        F.col("best.key").alias("matched_key"),
        F.col("best.action").alias("verdict"),
        F.col("best.listed_at").alias("since"),
    )
