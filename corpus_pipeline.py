"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor kept and returns documents of
the same columns; the last returns the pieces of packed sequences. ``run``
writes every stage to the shared folder and reads it again; what a stage left
there on its way is removed.

- toxicity: documents with a score at or above the threshold go.
- near duplicates: of each group linked by a Jaccard similarity of 0.8 or more
  on five-word shingles, the document with the least id stays, one without id
  only if the group has no id; documents without words stay.
- decontamination: documents that hold a window of a benchmark item go.
- secrets: documents stay, found spans are replaced by a mark.
- packing: all documents are tokenized and packed.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.llm import decontaminate, jaccard, packing, secretscan, toxicity
from hushgate.llm.common import stage, stage_alone, table
from hushgate.llm.queries import byte_bpe_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(COLUMNS), model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Ids can be missing or shared by different texts, so that each row gets a number of its own, fixed by writing it.
    rows = stage(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "corpus-rows")
    groups = jaccard.jaccard_components(rows, key="_row", n=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    wordless = F.col("n_shingles") == 0
    # Texts without words stay, but for repeated rows of one id.
    of_group = [F.when(~wordless, F.col("component_id")), F.when(wordless, F.col("doc_id")), F.when(wordless, F.col("_text")),
                F.when(wordless & F.col("doc_id").isNull(), F.col("_row"))]
    first = (rows.select("_row", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("_text")).join(groups, "_row")
             .groupBy(*[c.alias(f"_g{i}") for i, c in enumerate(of_group)])
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row")).alias("m")))
    return rows.join(first.select(F.col("m._row").alias("_row")), "_row", "left_semi").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = docs.select(COLUMNS).withColumn("_text", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))

    def hit() -> DataFrame:
        found = decontaminate.decontaminate(named.select("_text", "text"), table(spark, sf_dir, "benchmark"), key="_text")
        return found.filter("n_hit > 0").select("_text").distinct()

    bad = stage_alone(spark, "corpus-contaminated", hit)
    return named.join(bad, "_text", "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secretscan.redact(docs.select(COLUMNS), secretscan.identifier_dictionary(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe_path())


STAGES = [("toxicity", reject_toxic), ("near_duplicates", one_of_each_group), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack)]

#: Models, compressed lengths and token ids are beyond SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage_alone(spark, f"corpus-{name}", partial(work, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
