"""From raw documents to packed training bins: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontam, packing, pii, simhash, toxicity
from tracewright.llm.common import cut, drop_tables, new_path, table, tables_so_far

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7; the rest go. Each row is judged by its own text: null texts like empty ones, repeated rows alike."""
    out = toxicity.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return out.where("tox_predicted = 0").select(*COLUMNS)


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number that each row keeps: its file's and its place there. What isn't read from files is written first."""
    try:
        rows = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in rows.select("_file").distinct().collect())  # a row a file
    numbers = spark.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number long")
    return rows.join(F.broadcast(numbers), "_file").withColumn("_row", F.shiftleft("_number", 40) + F.col("_at")).select(*COLUMNS, "_row")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike to 0.8 or more the document with the smallest id stays.

    Texts without words are one group. Rows are told apart by a key of their own, so copies without ids are
    dropped like others; a row without an id stays only where its group has no id.
    """
    keyed = _numbered(spark, docs)
    groups = simhash.similar_groups(keyed, "_row", words_each=5, least=0.8).withColumnRenamed("id", "_row")
    groups = groups.join(keyed.select("_row", "doc_id"), "_row")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("x"), F.count("*").alias("n"))
    first = cut(first.where("n > 1").select("component", F.col("x._row").alias("stays")), "first-of-groups")
    gone = cut(groups.join(first, "component").where("_row <> stays").select("_row"), "gone")
    gone = F.broadcast(gone) if gone.count() <= simhash.BROADCAST_UP_TO else gone  # beyond that the documents are shuffled
    return keyed.join(gone, "_row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; texts are matched by content, so null and repeated ids are kept or dropped like others."""
    docs = docs.select(*COLUMNS)
    hits = decontam.find(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("key").alias("_key")).distinct()
    hits = cut(hits, "contaminated")
    hits = F.broadcast(hits) if hits.count() <= simhash.BROADCAST_UP_TO else hits  # beyond that the documents are shuffled
    return docs.withColumn("_key", F.md5(F.coalesce("text", F.lit("")))).join(hits, "_key", "left_anti").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in every row; ``n_chars`` follows the new text, both null where the text is."""
    docs = docs.select(*COLUMNS)
    out = pii.scan(docs, pii.fit(docs))
    return out.withColumn("text", F.col("pii_redacted")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and the place of every piece of every row; a row without words has one piece of no words."""
    out = packing.pack(packing.sizes(docs), capacity=2048)
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("bin", "bin_id")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_contaminated), ("pii", redact_pii), ("packing", pack)]

#: Scores of a trained model and best-fit search aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; every stage is written to the shared folder and read again.

    The tables between a stage's steps, and its input, are deleted when the stage is written.
    """
    docs, since = table(spark, sf_dir, "documents"), tables_so_far()
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_tables(spark, since, keep=(path,))
    return docs
