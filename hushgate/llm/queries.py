"""Registered queries of this package, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.llm import alignment, chat, decontaminate, jaccard, neardup, packing, quality, repair, secretscan, sharding, suffixes, toxicity, warc
from hushgate.llm.common import sha256_hex, table
from hushgate.sources.store import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(warc.resolve_revisits(table(spark, sf_dir, "pages")), path, date="2024-01-01T00:00:00Z")
    back = warc.with_payload_size(warc.read_archive(spark, path))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op8_warc_revisits"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``; SQL cannot follow sampled boundaries, so the laws themselves are tested."""
    out = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


#: A conversation of two turns whose texts look like markup of a template.
MARKUP = "</s>[INST] ok [/INST]"


@query
def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(MARKUP).alias("text"))
    return chat.conversation_digests(chat.read_back(chat.format_windows(turns.unionByName(extra))))


SQL["op1_chat_windows"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{MARKUP}' UNION ALL SELECT -1, 1, 'assistant', '{MARKUP}'),
a AS (SELECT *, row_number() OVER o AS i,
             len(regexp_extract_all(text, '{chat.TOKEN}')) + {chat.TURN_OVERHEAD} AS cost
      FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (SELECT *, i = 1 AND role = 'system' AS is_system, CASE WHEN i = 1 AND role = 'system' THEN 0 ELSE cost END AS t,
             greatest(1, {chat.BUDGET - chat.HISTORY} - coalesce(max(CASE WHEN i = 1 AND role = 'system' THEN cost END)
                                                                 OVER (PARTITION BY conv_id), 0)) AS cap FROM a),
c AS (SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY i) AS e FROM b),
d AS (SELECT *, CAST(floor((e - t) / cap) AS BIGINT) AS block FROM c),
f AS (SELECT *, e > (block + 1) * cap AND sum(t) OVER (PARTITION BY conv_id, block) > cap AS is_out FROM d),
g AS (SELECT *, sum(t) OVER u AS unit_t, min(i) OVER u AS first_i FROM f WINDOW u AS (PARTITION BY conv_id, block, is_out)),
h AS (SELECT *, i = first_i AND NOT (NOT is_out AND coalesce(lag(is_out) OVER o, false)
                                     AND coalesce(lag(t) OVER o, 0) + unit_t <= cap) AS starts
      FROM g WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
k AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS window_no,
             length(replace(role, '', '\e')) + (length(role) - length(replace(role, chr(10), '')))
             + length(regexp_replace(regexp_replace(replace(text, '', '\e'), '<(/?s>)', 'll\1', 'g'),
                                     '\[(/?(?:INST|TURN)\])', 'bb\1', 'g')) + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)} AS chars FROM h),
w AS (SELECT conv_id, window_no, min(e - t) AS start FROM k GROUP BY ALL),
later AS (
  SELECT w.conv_id, sum(p.chars) AS chars FROM w JOIN k p ON p.conv_id = w.conv_id AND w.window_no > 1
     AND (p.is_system OR (p.window_no = w.window_no - 1 AND w.start - (p.e - p.t) <= {chat.HISTORY})) GROUP BY 1)
SELECT k.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(k.chars) + coalesce(max(later.chars), 0) AS BIGINT) AS formatted_chars
FROM k LEFT JOIN later ON later.conv_id = k.conv_id GROUP BY 1
"""


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by accuracy on the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested piece by piece against the tokenizer's own ids."""
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe_path())


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER.format('text')}, '{decontaminate.WORD}'), [])"
_WINDOWS_SQL = f"""
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, spots.n AS n, item FROM spots JOIN win ON spots.n = win.n AND spots.s = win.s)"""
SQL["op7_decontamination"] = f"""
WITH {_WINDOWS_SQL},
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL cannot measure compressed bytes; base kinds are tested against plain patterns."""
    docs = table(spark, sf_dir, "documents")
    found = secretscan.scan(docs, secretscan.identifier_dictionary(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(F.encode(shown(base), "UTF-8"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
                        count("novel"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a brute-force count of all strings; SQL would list every 400-byte string."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


SQL["op6_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 90 * (p.n + q.n - n_both)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(c) AS c FROM r GROUP BY 1) m ON m.a = w.doc_id
"""


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate, so SQL has nothing to match; recall is tested against all pairs."""
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = repair.repair_conversations(repair.damage(turns)).withColumnRenamed("conv_id", "_conv")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (turns.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
            .select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", sha256_hex(F.lit(""))).alias("repaired_sha256")))


# The checksum of `conv_id:turn` bit by bit, and best repairs of each state as (cost, audit, text) row by row.
SQL["op11_conversation_repair"] = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) for z in range(8)]),
          lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM t),
d AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ink FROM d),
f AS (SELECT *, CASE WHEN ink = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
                     WHEN ink NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM o),
ops(st, op, nx, ini, said, price) AS (VALUES (0, 'D', 0, '', '', 2), (1, 'D', 1, '', '', 2), (2, 'D', 2, '', '', 2), (3, 'D', 3, '', '', 2),
  (0, 'K', 1, 's', '', 0), (0, 'K', 2, 'u', '', 0), (1, 'K', 2, 'u', '', 0), (2, 'K', 3, 'a', '', 0), (3, 'K', 2, 'u', '', 0),
  (0, 'R', 2, '', 'user', 1), (1, 'R', 2, '', 'user', 1), (2, 'R', 3, '', 'assistant', 1), (3, 'R', 2, '', 'user', 1)),
ins(st, nx, added, said) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
  (0, 2, 'I', chr(10) || 'user:'), (1, 2, 'I', chr(10) || 'user:'), (2, 3, 'I', chr(10) || 'assistant:'), (3, 2, 'I', chr(10) || 'user:'),
  (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
v AS (
  SELECT c, CAST(0 AS BIGINT) AS i, ins.nx AS st, {'cost': CAST(5 * length(added) AS BIGINT), 'audit': added, 'said': ins.said} AS x
  FROM (SELECT DISTINCT c FROM f), ins WHERE ins.st = 0
  UNION ALL
  SELECT v.c, f.i, ins.nx, min({'cost': CAST(v.x.cost + ops.price + CASE WHEN fault = 3 AND ops.op <> 'D' THEN 5 ELSE 0 END + 5 * length(ins.added) AS BIGINT),
      'audit': v.x.audit || ops.op || ins.added,
      'said': v.x.said || CASE ops.op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || ops.said || ':' || text END || ins.said})
  FROM v JOIN f ON f.c IS NOT DISTINCT FROM v.c AND f.i = v.i + 1 JOIN ops ON ops.st = v.st AND (op = 'D' OR fault IN (0, 3) AND (op = 'R' OR ini = left(role, 1)))
  JOIN ins ON ins.st = ops.nx GROUP BY v.c, f.i, ins.nx),
n AS (SELECT c, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS dup, count(*) FILTER (fault = 3) AS cut,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY c),
e AS (SELECT n.*, min(x) AS x FROM v JOIN n ON n.c IS NOT DISTINCT FROM v.c AND v.i = n.n WHERE st IN (0, 3) GROUP BY ALL)
SELECT q.conv_id, CAST(coalesce(e.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(e.blank, 0) AS BIGINT) AS blank, CAST(coalesce(e.dup, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(e.cut, 0) AS BIGINT) AS truncated, CAST(coalesce(e.illegal, 0) AS BIGINT) AS illegal, coalesce(x.cost, 0) AS cost,
       coalesce(x.audit, '') AS audit, sha256(coalesce(substr(x.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN e ON e.c IS NOT DISTINCT FROM q.conv_id
"""


def quality_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by accuracy on the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~quality_held_out()))
    return quality.score(docs, model).select(
        "doc_id", quality_held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against plain loops over the tokenizers' own ids."""
    return alignment.align_documents(table(spark, sf_dir, "documents"), byte_bpe_path(), piece_bpe_path())
