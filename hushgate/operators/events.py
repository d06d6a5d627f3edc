"""Archive events to commit rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgate.functions.text import hour_of, or_empty


# With and without a fraction, a colon in the zone, a T between date and time.
TIME_LAYOUTS = [f"yyyy-MM-dd{t}HH:mm:ss{f}{z}" for f in ("", "[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]")
                for t in ("'T'", " ") for z in ("XXX", "XX", " XX", " 'UTC'")]


def utc_time(created_at: Column) -> Column:
    """UTC wall clock of an ISO time with zone, whatever the session time zone is; null if no layout fits."""
    # What archives hold nearly always; the layouts are tried for the rest only.
    plain = (F.length(created_at) == 20) & F.endswith(created_at, F.lit("Z")) & (F.substring(created_at, 11, 1) == "T")
    utc = F.regexp_replace(created_at, "UTC$", "+0000")
    layouts = [x.replace("'UTC'", "XX") for x in TIME_LAYOUTS]
    instant = F.coalesce(*[F.try_to_timestamp(utc, F.lit(x)) for x in dict.fromkeys(layouts)])
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    other = epoch + F.make_dt_interval(secs=(F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    return F.when(plain, F.left(created_at, F.lit(19)).try_cast("timestamp_ntz")).otherwise(other)


def unread_times(raw: DataFrame) -> DataFrame:
    """Events whose time no layout reads, counted by the time as written."""
    return (raw.filter(F.col("type").isNotNull() & utc_time(F.col("created_at")).isNull())
            .groupBy("created_at").agg(F.count("*").alias("events")))


def event_number(id_text: Column, *otherwise: Column) -> Column:
    """A number that stands for an id: the id itself if it is written as a number, else a negative hash.

    ``007`` is not ``7``. An id that is missing is told by the hash of the columns given instead.
    """
    number = id_text.try_cast("bigint")
    hashed = -F.lit(1).cast("bigint") - F.shiftrightunsigned(F.xxhash64(id_text, *[F.when(id_text.isNull(), c) for c in otherwise]), 1)
    return F.when((number.cast("string") == id_text) & (number >= 0), number).otherwise(hashed)


def _common() -> list:
    payload = [F.col(f"payload.{c}") for c in ("head", "ref", "action", "pull_request.number")]
    return [
        event_number(F.col("id"), F.col("type"), F.col("repo.name"), F.col("created_at"), *payload).alias("event_id"),
        or_empty(F.col("repo.name")).alias("repo"),
        utc_time(F.col("created_at")).alias("ts"),
    ]


def push_events(raw: DataFrame) -> DataFrame:
    return (raw.filter(F.col("type") == "PushEvent")
            .select(*_common(), F.lit("push").alias("event_type"),
                    or_empty(F.col("payload.head")).alias("head"),
                    or_empty(F.col("payload.ref")).alias("ref")))


def pr_events(raw: DataFrame) -> DataFrame:
    """Opened and reopened pull requests."""
    pr = "payload.pull_request"
    return (raw.filter((F.col("type") == "PullRequestEvent")
                       & F.col("payload.action").isin("opened", "reopened"))
            .select(*_common(), F.lit("pr").alias("event_type"),
                    or_empty(F.col(f"{pr}.title")).alias("title"),
                    F.coalesce(F.col(f"{pr}.number"), F.lit(0)).alias("pr_number"),
                    or_empty(F.col(f"{pr}.html_url")).alias("pr_url"),
                    F.col("payload.action").alias("action")))


def union_events(pushes: DataFrame, prs: DataFrame) -> DataFrame:
    return pushes.unionByName(prs, allowMissingColumns=True)


def keyed_events(raw: DataFrame) -> DataFrame:
    """What :func:`commit_key` gives for pushes and pull requests together, in one reading of the events."""
    pr, is_pr = "payload.pull_request", F.col("type") == "PullRequestEvent"
    wanted = (F.col("type") == "PushEvent") | (is_pr & F.col("payload.action").isin("opened", "reopened"))
    of = lambda for_pr, for_push: F.when(is_pr, for_pr).otherwise(for_push)
    return commit_key(raw.filter(wanted).select(
        *_common(), of(F.lit("pr"), F.lit("push")).alias("event_type"),
        of(F.lit(""), or_empty(F.col("payload.head"))).alias("head"), of(F.lit(""), or_empty(F.col("payload.ref"))).alias("ref"),
        of(or_empty(F.col(f"{pr}.title")), F.lit("")).alias("title"),
        of(F.coalesce(F.col(f"{pr}.number"), F.lit(0)), F.lit(0)).alias("pr_number"),
        of(or_empty(F.col(f"{pr}.html_url")), F.lit("")).alias("pr_url")))


def commit_key(events: DataFrame) -> DataFrame:
    """Events that can be looked up, with the ``(repo, sha)`` they stand for.

    A pull request carries its own message; a push gets one by lookup and needs
    a repository of the form ``owner/name``.
    """
    is_pr = F.col("event_type") == "pr"
    usable = F.when(is_pr, F.col("title") != "") \
              .otherwise((F.col("head") != "") & (F.size(F.split("repo", "/")) == 2))
    return (events.filter((F.col("repo") != "") & usable)
            .select("event_id", "repo", "ts", "event_type",
                    F.when(is_pr, F.concat(F.lit("pr-"), F.col("pr_number").cast("string")))
                     .otherwise(F.col("head")).alias("sha"),
                    F.when(is_pr, F.col("title")).alias("message"),
                    is_pr.alias("is_pr"),
                    or_empty(F.col("ref")).alias("ref"),
                    or_empty(F.col("pr_url")).alias("pr_url")))


def sample_events(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Bernoulli sample of rows."""
    return df.sample(fraction=fraction, seed=seed)


def _below(text: Column, fraction: float) -> Column:
    """Whether the first 32 bits of a hash, as a share of all, lie below ``fraction``."""
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint") < F.lit(fraction * 2.0 ** 32)


def sample_by_hash(df: DataFrame, fraction: float, key: str = "event_id", seed: int = 0) -> DataFrame:
    """Repeatable sample of rows by their key; other seeds give other samples."""
    return df.filter(_below(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), fraction))


def sample_commits(df: DataFrame, fraction: float) -> DataFrame:
    """Repeatable sample: a commit is in or out wherever and whenever it occurs."""
    return df.filter(_below(F.concat_ws("@", "repo", "sha"), fraction))


def max_commits(suspicious: DataFrame, n: int) -> DataFrame:
    """The first ``n`` suspicious commits in time order."""
    return suspicious.orderBy("ts", "repo", "sha", "event_id").limit(n)


def ordered_results(df: DataFrame, *order: str) -> DataFrame:
    """Results in input order: the order columns travel along, one range sort at the end."""
    return df.orderBy(*(order or ("ts", "event_id")))


def distinct_commits(commits: DataFrame) -> DataFrame:
    """Earliest row of each ``(repo, sha)``.

    An aggregate rather than a window: copies combine before the shuffle, so a
    key repeated without end never gathers in one task.
    """
    rest = [c for c in commits.columns if c not in ("repo", "sha")]
    order = ["ts", "event_id"]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return (commits.groupBy("repo", "sha").agg(first.alias("_first"))
            .select("repo", "sha", *[F.col(f"_first.{c}").alias(c) for c in rest]))


def order_number(ts: Column, event_id: Column) -> Column:
    """Time, then id, as one number of fixed width, so that its minimum is a hash aggregate; nulls come last."""
    day = F.datediff(ts, F.lit("1970-01-01")).cast("decimal(20,0)")
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)
    micros = day * F.lit(86_400_000_000).cast("decimal(12,0)") + (second * 1_000_000).cast("decimal(12,0)")
    # 20 digits for the id, which may be negative, below 18 for the time.
    place = (F.coalesce(micros, F.lit(10 ** 17).cast("decimal(18,0)")).cast("decimal(18,0)") * F.lit(Decimal(10 ** 19)).cast("decimal(20,0)"))
    code = F.coalesce(event_id.cast("decimal(20,0)"), F.lit(Decimal(2 ** 63 - 1)).cast("decimal(20,0)"))
    return (place + code).cast("decimal(38,0)")


def first_seen(df: DataFrame, key: str) -> DataFrame:
    """Marks rows whose key occurred before (``cache_hit``), by time then id, which together tell rows apart.

    One number of fixed width is kept per key, so a frequent key combines before
    the shuffle; its rows then meet that number in a join that adaptive execution
    splits. Rows without a key are never hits.
    """
    order = order_number(F.col("ts"), F.col("event_id"))
    firsts = (df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
              .agg(F.min(order).alias("_first")))
    return (df.withColumn("_order", order).join(firsts, F.col(key) == F.col("_key"), "left")
            .withColumn("cache_hit", F.coalesce(F.col("_order") > F.col("_first"), F.lit(False)))
            .drop("_key", "_first", "_order"))


def hourly_counts(raw_or_events: DataFrame, kind: str = "kind", ts: str = "ts") -> DataFrame:
    """Events, pushes and pull requests per hour."""
    k = F.col(kind)
    return (raw_or_events.groupBy(hour_of(F.col(ts)).alias("hour"))
            .agg(F.count("*").alias("events"),
                 F.count_if(k == "PushEvent").alias("pushes"),
                 F.count_if(k == "PullRequestEvent").alias("prs")))
