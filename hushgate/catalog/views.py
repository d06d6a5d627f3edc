"""Input views derived from the benchmark tables.

The tables hold no commits, so the commit, diff, finding and payload inputs of
the registered queries are derived from all rows of ``events``, ``documents``,
``pages``, ``labels`` and ``nation``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.functions.text import unescape_basic
from hushgate.operators.detect import detect_secrets
from hushgate.rules import DETECTOR_CATALOG

SALT = "check-salt"

# The known message vectors and edge cases that classification is checked with.
MESSAGES = [
    "remove leaked api key", "fix: expose secret token", "revoke aws credentials",
    "remove hard coded api key from config", "security fix: remove hardcoded credentials",
    "rotate database password", "replace actual api key placeholder", "this is not a real key",
    "credentials leak fixed", "update readme", "fix keyboard shortcut",
    "chore: clean up env file", "add new feature",
    "expose credentials.", "remove config.env", "remove old\nkey", "remove api-key",
    "\tUpdate Docker\n", "", "delete credentials",
]


# One made-up value in the shape of each detector; none of them opens anything.
INVENTED = [
    "-----BEGIN EC PRIVATE KEY-----\nTk9ORQ==\n-----END EC PRIVATE KEY-----", "sk-ant-" + "none1" * 5, "sk-" + "None2" * 5, "AIza" + "none3" * 7,
    "AKIA" + "NONE" * 4, "rk_live_" + "none" * 6, "key-" + "none" * 8, "SK" + "de" * 16, "Password: 'not-a-real-one'", "fedcba9876543210" * 2]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def text_of(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def stored(c: Column) -> Column:
    """Computed once per row like a stored column, rather than inside every filter on it."""
    return F.explode(F.array(c))


def with_commit_columns(events: DataFrame) -> DataFrame:
    """Works on a batch table and on a stream of it."""
    eid, uid, k = F.col("event_id"), F.col("user_id"), F.col("k")
    kind = (F.when(F.col("event_type") == "error", "IssuesEvent")
             .when(F.col("event_type") == "signup", "PullRequestEvent").otherwise("PushEvent"))
    name = F.concat(F.when(uid % 3 == 0, "Org").otherwise("org"), text_of(uid % 25),
                    F.lit("/repo"), text_of(uid % 7))
    repo = (F.when(eid % 41 == 5, "solo").when(eid % 43 == 7, F.concat(name, F.lit("/sub")))
             .when(eid % 47 == 9, "").otherwise(name))
    sha = F.when(eid % 53 == 11, "").otherwise(F.md5(F.concat(text_of(uid), F.lit("-"), text_of(k))))
    return (events.withColumn("k", stored(F.get_json_object("props", "$.k").cast("bigint")))
            .select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "k",
                    stored(F.struct(kind.alias("kind"), repo.alias("repo"), sha.alias("sha"),
                                    pick(MESSAGES, k).alias("message"))).alias("c"))
            .select("event_id", "ts", "user_id", "k", "c.*"))


def commit_events(spark: SparkSession, sf: str) -> DataFrame:
    return with_commit_columns(table(spark, sf, "events"))


def to_raw(ce: DataFrame) -> DataFrame:
    """Commit events nested to the archive schema."""
    eid, uid, k, kind = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("kind")
    push, pr = kind == "PushEvent", kind == "PullRequestEvent"

    def mail(*parts: Column) -> Column:
        return F.struct(F.concat(*parts).alias("email"))

    lit = F.lit
    commits = F.array(
        F.struct(mail(lit("u"), text_of(uid), lit("@Mail"), text_of(uid % 7), lit(".example")).alias("author"),
                 mail(F.when(k % 2 == 0, "bot").otherwise(
                     F.concat(lit("c"), text_of(k), lit("@mail"), text_of(k % 7), lit(".example")))).alias("committer")),
        F.struct(mail(F.when(k % 3 != 0, F.concat(lit("x@y@mail"), text_of((uid + k) % 7), lit(".example ")))).alias("author"),
                 mail(lit("z@mail"), text_of(k % 5), lit(".example")).alias("committer")))
    payload = F.struct(
        F.when(push, F.col("sha")).alias("head"),
        F.when(push & (k % 17 != 3), pick(["refs/heads/main", "refs/heads/dev"], k)).alias("ref"),
        F.when(pr, pick(["opened", "reopened", "closed"], eid)).alias("action"),
        F.when(pr, F.struct(
            F.col("message").alias("title"), eid.alias("number"),
            F.concat(lit("https://forge.example/"), F.col("repo"), lit("/pull/"), text_of(eid)).alias("html_url"),
        )).alias("pull_request"),
        F.when(push, F.when(k % 11 == 0, F.slice(commits, 1, 0)).otherwise(commits)).alias("commits"))
    return ce.select(
        text_of(eid).alias("id"), kind.alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.struct(F.col("repo").alias("name")).alias("repo"), payload.alias("payload"))


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return to_raw(commit_events(spark, sf))


def archive_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events as JSON lines, one in fifty cut off in the middle."""
    line = F.when(F.col("id").cast("bigint") % 50 == 7,
                  F.concat(F.lit('{"type": "'), F.col("type"), F.lit('", "id": '), F.col("id"))) \
            .otherwise(F.to_json(F.struct("*")))
    return raw_events(spark, sf).select(line.alias("value"))


def push_keys(spark: SparkSession, sf: str) -> DataFrame:
    return (commit_events(spark, sf).filter((F.col("kind") == "PushEvent") & (F.col("sha") != ""))
            .select("repo", "sha", "user_id", "k", "message").distinct())


def commits(spark: SparkSession, sf: str) -> DataFrame:
    return push_keys(spark, sf).filter(F.col("k") % 10 != 0).select("repo", "sha", "message")


def diffs(spark: SparkSession, sf: str, keys: DataFrame | None = None) -> DataFrame:
    """The diff of every push key, or of those in ``keys``, whose further columns stay."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    n = docs.agg(F.count("*").alias("n")).select("n").scalar()
    keys = push_keys(spark, sf) if keys is None else keys
    more = [c for c in keys.columns if c not in ("repo", "sha", "user_id", "k", "message")]
    keyed = keys.select("repo", "sha", *more, ((F.col("user_id") * 100 + F.col("k")) % n).alias("doc_id"))
    file = F.concat(F.col("source"), F.lit(".txt"))
    count = text_of(F.size(F.split("text", "\n")))

    def patch(sign: str, head: Column) -> Column:
        return F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file, F.lit("\n"), head, F.lit(" @@\n"),
                        F.lit(sign), F.replace(F.col("text"), F.lit("\n"), F.lit("\n" + sign)))

    # Every third document was removed, the others were added after a context line.
    added = patch("+", F.concat(F.lit("--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -1 +1,"), count))
    added = F.replace(added, F.lit(" @@\n"), F.lit(" @@\n first line\n"))
    removed = patch("-", F.concat(F.lit("--- a/"), file, F.lit("\n+++ /dev/null\n@@ -1,"), count, F.lit(" +0,0")))
    # A patch depends on its document alone, so texts are shuffled once, as documents, not again as diffs.
    patches = docs.select("doc_id", stored(F.when(F.col("doc_id") % 3 == 1, removed).otherwise(added)).alias("diff"))
    return keyed.join(patches, "doc_id").select("repo", "sha", "diff", *more)


def orgs(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "nation").filter(F.col("n_nationkey") % 2 == 0)
            .select(F.concat(F.lit("org"), text_of("n_nationkey")).alias("handle")))


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "nation").filter(F.col("n_nationkey").isin(1, 3, 5))
            .select(F.concat(F.lit("mail"), text_of("n_nationkey"), F.lit(".example")).alias("domain")))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", unescape_basic(F.col("html")).alias("text"))


def documents_with_values(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, each followed by one of the made-up values in turn."""
    value = pick(INVENTED, F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n"), value, F.lit(" end")).alias("text"))


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in documents and pages; labels stand in for the verified column."""
    found = detect_secrets(table(spark, sf, "documents"), ["doc_id", "source"], SALT)
    good = table(spark, sf, "labels").filter(F.col("quality") == 1).select("doc_id", F.lit(True).alias("verified"))
    doc = F.col("doc_id")
    of_docs = found.join(good, "doc_id", "left").select(
        "detector", "verified", "pos", "secret_redacted", "secret_fp",
        F.md5(text_of(doc)).alias("commit"), F.concat("source", F.lit(".txt")).alias("file"),
        F.concat(F.lit("org"), text_of(doc % 25), F.lit("/docs")).alias("repository"),
        F.when(doc % 4 == 0, "").otherwise(
            F.concat(F.lit("d"), text_of(doc % 50), F.lit("@mail.example"))).alias("email"))
    page = F.col("page_id")
    of_pages = detect_secrets(page_texts(spark, sf), ["page_id"], SALT).select(
        "detector", F.lit(None).cast("boolean").alias("verified"), "pos", "secret_redacted", "secret_fp",
        F.md5(F.concat(F.lit("p"), text_of(page))).alias("commit"),
        F.concat(text_of(page), F.lit(".html")).alias("file"),
        F.concat(F.lit("org"), text_of(page % 25), F.lit("/pages")).alias("repository"),
        F.lit("").alias("email"))
    return of_docs.unionByName(of_pages).withColumn("timestamp", F.concat(F.lit("t"), F.left("commit", F.lit(6))))


def scanner_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Scanner output for every document, in all shapes it comes in."""
    doc = F.col("doc_id")
    git = F.struct(
        F.md5(text_of(doc)).alias("commit"), F.concat("source", F.lit(".txt")).alias("file"),
        F.concat(F.lit("d"), text_of(doc % 50), F.lit("@mail.example")).alias("email"),
        F.concat(F.lit("2024-01-01 00:00:"), text_of(doc % 60)).alias("timestamp"),
        F.concat(F.lit("org"), text_of(doc % 25), F.lit("/docs")).alias("repository"),
        F.lit("c").alias("committer"))
    disk = F.struct(F.concat(F.lit("/tmp/"), F.col("source")).alias("file"))
    shapes = [
        F.struct(F.struct(git.alias("Git")).alias("Data")),
        F.struct(F.struct(git.alias("git")).alias("Data")),
        F.struct(git.alias("Git")),
        F.struct(git.alias("git")),
        F.struct(F.struct(disk.alias("filesystem")).alias("Data")),
        F.struct(F.struct(disk.alias("filesystem"), git.alias("git")).alias("Data")),
    ]
    fake = F.concat(F.lit("fake-value-"), text_of(doc))
    lines = []
    for source in shapes:
        lines.append(F.to_json(F.struct(
            pick(DETECTOR_CATALOG[:7], doc).alias("DetectorName"), (doc % 9).alias("DetectorType"),
            F.lit("PLAIN").alias("DecoderName"), (doc % 3 == 0).alias("Verified"),
            pick(["", "false", "sk-***"], doc).alias("Redacted"),
            F.when(doc % 2 == 0, F.struct(fake.alias("RawV2"))).alias("Data"),
            F.when(doc % 5 == 1, fake).alias("RawV2"), source.alias("SourceMetadata"))))
    shaped = F
    for i, line in enumerate(lines):
        shaped = shaped.when(doc % 6 == i, line)
    value = (F.when(doc % 29 == 3, '{"DetectorName": "broken')
              .when(doc % 31 == 4, "").otherwise(shaped))
    return table(spark, sf, "documents").select("doc_id", value.alias("value"))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Commit messages as the bodies that the code hosts would store."""
    forge = pick(["github", "gitlab", "bitbucket", "azure_devops", "sourceforge", "gitea"], F.col("event_id"))
    m = F.col("message")
    body = (F.when(F.col("forge") == "gitlab", F.to_json(F.struct(m.alias("message"))))
             .when(F.col("forge") == "bitbucket", F.to_json(F.struct(F.struct(m.alias("raw")).alias("summary"))))
             .when(F.col("forge") == "azure_devops", F.to_json(F.struct(m.alias("comment"))))
             .when((F.col("forge") == "sourceforge") & (F.col("k") % 2 == 0),
                   F.to_json(F.struct(F.lit("").alias("message"), m.alias("title"))))
             .when(F.col("forge") == "sourceforge", F.to_json(F.struct(m.alias("message"))))
             .otherwise(F.to_json(F.struct(F.struct(m.alias("message")).alias("commit")))))
    return (commit_events(spark, sf).withColumn("forge", forge)
            .select("event_id", "forge", "k", "message", body.alias("body")))


def change_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as the change list of one code host."""
    doc = F.col("doc_id")
    patch = F.concat(F.lit("@@ -0,0 +1 @@\n+"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n+")))
    old, new = F.concat("source", F.lit(".old")), F.concat("source", F.lit(".txt"))
    path = lambda p: F.struct(p.alias("path"))
    gitlab = F.array(F.struct(old.alias("old_path"), new.alias("new_path"), patch.alias("diff")),
                     F.struct(old.alias("old_path"), old.alias("new_path"), F.lit("").alias("diff")))
    bitbucket = F.array(F.struct(path(old).alias("old"), path(new).alias("new"), patch.alias("diff")))
    azure = F.array(F.struct(path(new).alias("item"), patch.alias("diff")))
    forge = pick(["gitlab", "bitbucket", "azure_devops", "github", "bitbucket_list"], doc)
    body = (F.when(F.col("f") == "gitlab", F.to_json(gitlab))
             .when(F.col("f") == "bitbucket", F.to_json(F.struct(bitbucket.alias("values"))))
             .when(F.col("f") == "bitbucket_list", F.to_json(bitbucket))
             .when(F.col("f") == "azure_devops", F.to_json(F.struct(azure.alias("changes"))))
             .otherwise(patch))
    return (table(spark, sf, "documents").withColumn("f", forge)
            .select("doc_id", F.when(F.col("f") == "bitbucket_list", "bitbucket").otherwise(F.col("f")).alias("forge"),
                    body.alias("body")))


def repo_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as they are, and repository addresses built from pages and events."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), text_of("page_id")).alias("id"), "url")
    ce = commit_events(spark, sf)
    host = pick(["github.com", "gitlab.example", "gitea.example", "gogs.example", "bitbucket.org",
                 "dev.azure.com", "Code.Example"], F.col("event_id"))
    form = F.col("event_id") % 6
    url = (F.when(form == 0, F.concat(F.lit("git@"), host, F.lit(":"), "repo", F.lit(".git")))
            .when(form == 1, F.concat(F.lit("ssh://git@"), host, F.lit("/"), "repo", F.lit(".git")))
            .when(form == 2, F.concat(F.lit("https://"), host, F.lit("/"), "repo", F.lit(".git ")))
            .when(form == 3, F.concat(F.lit("http://"), host, F.lit("/group/"), "repo"))
            .when(form == 4, F.concat(F.lit("https://"), host, F.lit("/acme/proj/_git/"), "repo"))
            .otherwise(F.concat(F.lit("not a url "), "repo")))
    return pages.unionByName(ce.select(F.concat(F.lit("e"), text_of("event_id")).alias("id"), url.alias("url")))


def review_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reviewer's reply per event, in good and bad forms."""
    eid, k = F.col("event_id"), F.col("k")
    good = F.concat(F.lit('{"0": true, "1": '), F.when(k % 2 == 0, "true").otherwise("false"),
                    F.lit(', "x": true, "'), text_of(k + 2), F.lit('": false}'))
    reply = (F.when(eid % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
              .when(eid % 4 == 1, good)
              .when(eid % 4 == 2, F.concat(F.lit("```\n"), good, F.lit("```\n")))
              .otherwise("not json"))
    return commit_events(spark, sf).select(text_of(eid).alias("batch_id"), reply.alias("reply"))
