"""Attribution of events to the user's own organisations and mail domains.

The owned handles and domains come either as a Python collection, which is
compiled into the expression (no shuffle at all), or as a table, which is joined.
Tables are never broadcast by force: Spark does it when the measured size allows
and otherwise shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgate.functions.text import email_domain, or_empty
from hushgate.operators.events import event_number

Owned = DataFrame | Collection[str]


def org_handle(repo: Column) -> Column:
    """Owner part of a repository name; null when there is none."""
    return F.when(repo.contains("/"), F.substring_index(repo, "/", 1))


def _normal(table: DataFrame, column: str, to: str) -> DataFrame:
    return table.select(F.lower(F.trim(F.col(column))).alias(to)).distinct()


def attribute_by_org(df: DataFrame, orgs: Owned, repo: str = "repo") -> DataFrame:
    """Adds the handle as written and whether the user owns it."""
    handle = org_handle(or_empty(F.col(repo)))
    df = df.withColumn("org_handle", handle)
    if not isinstance(orgs, DataFrame):
        owned = F.lower("org_handle").isin([o.strip().lower() for o in orgs])
        return df.withColumn("org_owned", F.coalesce(owned, F.lit(False)))
    known = _normal(orgs, "handle", "_owned")
    return (df.join(known, F.lower("org_handle") == F.col("_owned"), "left")
            .withColumn("org_owned", F.col("_owned").isNotNull()).drop("_owned"))


def commit_domains(commits: Column) -> Column:
    """Mail domains of a push in order: per commit the author, then the committer."""
    def both(c: Column) -> Column:
        return F.array(
            F.struct(F.lit("author_domain").alias("via"), email_domain(c["author"]["email"]).alias("domain")),
            F.struct(F.lit("committer_domain").alias("via"), email_domain(c["committer"]["email"]).alias("domain")))

    return F.flatten(F.transform(commits, both))


def first_listed(commits: Column, domains: Collection[str]) -> Column:
    """First owned mail domain of a push as struct ``(via, domain)``, else null."""
    owned = [d.strip().lower() for d in domains]
    return F.try_element_at(F.filter(commit_domains(commits), lambda x: x["domain"].isin(owned)), F.lit(1))


def attribute_by_email(raw: DataFrame, domains: Owned) -> DataFrame:
    """First owned mail domain of each event: ``(event_id, matched_via, matched_value)``.

    Events without one are absent.
    """
    if not isinstance(domains, DataFrame):
        hits = raw.select("id", first_listed(F.col("payload.commits"), domains).alias("_hit")).filter(F.col("_hit").isNotNull())
    else:
        hits = raw.select("id", "payload.commits").join(_mail_hits(raw, domains), "id").select("id", _at(F.col("commits")).alias("_hit")).distinct()
    return hits.select(event_number(F.col("id")).alias("event_id"), F.col("_hit.via").alias("matched_via"),
                       F.col("_hit.domain").alias("matched_value"))


def _at(commits: Column) -> Column:
    """What stands at the place that :func:`_mail_hits` found."""
    return F.try_element_at(commit_domains(commits), F.col("_pos") + 1)


def _mail_hits(raw: DataFrame, domains: DataFrame) -> DataFrame:
    """Where in an event its first owned mail domain stands, by ``id`` as written: ids need not be numbers.

    Only the place is aggregated, a number, so hash tables do it on both sides of the shuffle.
    """
    named = (raw.filter("id is not null").select("id", F.posexplode(commit_domains(F.col("payload.commits"))).alias("_pos", "c"))
             .select("id", "_pos", "c.domain")
             .filter(F.col("domain") != ""))
    known = _normal(domains, "domain", "domain").filter(F.col("domain") != "")
    return named.join(known, "domain").groupBy("id").agg(F.min("_pos").alias("_pos"))


def attribute_events(raw: DataFrame, orgs: Owned, domains: Owned) -> DataFrame:
    """Adds ``org_handle, is_owned, matched_via, matched_value, label`` to raw events.

    The organisation counts before the mail domains; an event whose repository
    has no owner part is labelled ``unknown`` and belongs to nobody.
    """
    by_org = attribute_by_org(raw.withColumn("_repo", F.col("repo.name")), orgs, "_repo").drop("_repo")
    open_event = F.col("org_handle").isNotNull() & ~F.col("org_owned")
    if not isinstance(domains, DataFrame):
        hit = first_listed(F.col("payload.commits"), domains)
        by_mail = (by_org.withColumn("_hit", F.when(open_event, hit))
                   .withColumn("_via", F.col("_hit.via")).withColumn("_value", F.col("_hit.domain"))
                   .drop("_hit"))
    else:
        # Mail domains decide only where the organisation did not.
        hit = F.when(F.col("_pos").isNotNull(), _at(F.col("payload.commits")))
        by_mail = (by_org.join(_mail_hits(by_org.filter(open_event), domains), "id", "left")
                   .withColumn("_hit", hit).withColumn("_via", F.col("_hit.via")).withColumn("_value", F.col("_hit.domain"))
                   .drop("_hit", "_pos"))
    via = F.when(F.col("org_owned"), F.lit("org_handle")).otherwise(F.col("_via"))
    value = F.when(F.col("org_owned"), F.col("org_handle")).otherwise(F.col("_value"))
    label = (F.when(F.col("org_handle").isNull(), F.lit("unknown"))
              .when(F.col("org_owned"), F.concat(F.lit("Org: "), F.col("org_handle")))
              .when(F.col("_value").isNotNull(), F.concat(F.lit("Domain: "), F.col("_value")))
              .otherwise(F.lit("general-stream")))
    return (by_mail.withColumn("matched_via", via).withColumn("matched_value", value)
            .withColumn("is_owned", F.col("matched_via").isNotNull())
            .withColumn("label", label)
            .drop("org_owned", "_via", "_value"))


def owned_only(attributed: DataFrame) -> DataFrame:
    return attributed.filter("is_owned")


def not_owned(attributed: DataFrame) -> DataFrame:
    """The complement, labelled as what an owned-only run drops."""
    return (attributed.filter(~F.col("is_owned"))
            .withColumn("label", F.when(F.col("label") == "unknown", F.col("label"))
                                  .otherwise(F.lit("non-enterprise"))))
