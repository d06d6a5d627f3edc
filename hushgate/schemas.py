"""Explicit schemas of everything read from files."""

from pyspark.sql import types as T

EMAIL = T.StructType([T.StructField("email", T.StringType())])

COMMIT_AUTHORS = T.StructType([
    T.StructField("author", EMAIL),
    T.StructField("committer", EMAIL),
])

RAW_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("repo", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("payload", T.StructType([
        T.StructField("head", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("pull_request", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("number", T.LongType()),
            T.StructField("html_url", T.StringType()),
        ])),
        T.StructField("commits", T.ArrayType(COMMIT_AUTHORS)),
    ])),
])

CORRUPT_COLUMN = "_corrupt_record"

RAW_EVENT_WITH_CORRUPT = T.StructType(
    RAW_EVENT.fields + [T.StructField(CORRUPT_COLUMN, T.StringType())])

PATH = "struct<path:string>"
GITLAB_CHANGES = "array<struct<old_path:string,new_path:string,diff:string>>"
BITBUCKET_CHANGES = f"array<struct<old:{PATH},new:{PATH},diff:string>>"
BITBUCKET_PAGE = f"struct<values:{BITBUCKET_CHANGES}>"
AZURE_PAGE = f"struct<changes:array<struct<item:{PATH},diff:string>>>"

FINDING_COLUMNS = [
    "detector", "detector_type", "decoder", "verified", "redacted",
    "secret_redacted", "secret_fp", "commit", "file", "email", "timestamp",
    "repository", "committer",
]
