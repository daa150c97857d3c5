"""Landing as lines: one record per line, one folder per batch.

    <folder>/batch=<yyyymmdd_hhmmss>/part-*.json

A page file is one JSON object, so one task has to read it whole. Lines can be split: a
batch is read by as many tasks as it has blocks. It is read once. Lines that are no
record are caught in that same read and stand beside the records in the table it writes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators import checks
from postmill.plans.staging import records_without_id
from postmill.sources.landing import PAGED_JOB

# A line of a paged source: the record and what its page told.
PAGED_LINE = T.StructType([*PAGED_JOB.fields, T.StructField("_source_query", T.StringType()),
                           T.StructField("_source_page", T.IntegerType()),
                           T.StructField("_collected_at", T.StringType())])
MALFORMED = "_malformed"
BATCH = r"/batch=([0-9]{8}_[0-9]{6})/"
# File, block and place within the block: the order of the lines, however they were read.
LINE_ARRIVAL = ("_source_file", "_source_block", "_position")


@dataclass(frozen=True)
class Batch:
    stamp: str
    records: DataFrame
    malformed: DataFrame


def write_lines(records: DataFrame, folder: str, stamp: str) -> None:
    """Land the records of a batch; a batch that is there already is an error."""
    records.write.json(f"{folder}/batch={stamp}")


def newest_batch(spark: SparkSession, folder: str) -> str:
    """The latest batch by the names of its files; contents are not read."""
    paths = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.json*").load(folder)
             .select(F.regexp_extract("path", BATCH, 1).alias("stamp")))
    newest = paths.agg(F.max("stamp").alias("n")).first()["n"]
    if not newest:
        raise FileNotFoundError(f"no batch in {folder}")
    return newest


def read_batch(spark: SparkSession, folder: str, schema: T.StructType, out: str, id_column: str,
               stamp: str | None = None) -> Batch:
    """The newest batch, or the one of `stamp`, parsed into the Parquet table `out`.

    `schema` lists the fields of a record; all are read as declared and absent ones are
    null. A line is malformed if it is no JSON object of these fields. A batch without
    any record, or with a record without id, is an error; malformed lines are not, they
    are for the caller to judge.
    """
    stamp = stamp or newest_batch(spark, folder)
    caught = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    lines = (spark.read.schema(caught).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", MALFORMED).json(f"{folder}/batch={stamp}"))
    (lines.select("*", F.col("_metadata.file_name").alias(LINE_ARRIVAL[0]),
                  F.col("_metadata.file_block_start").alias(LINE_ARRIVAL[1]),
                  F.monotonically_increasing_id().alias(LINE_ARRIVAL[2]))
     .write.parquet(out))
    table = spark.read.parquet(out)
    records = table.filter(F.col(MALFORMED).isNull()).drop(MALFORMED)
    checks.assert_some(records, f"batch {stamp} has no records")
    checks.assert_empty(records_without_id(records, id_column).select(LINE_ARRIVAL[0]),
                        f"records without {id_column}")
    return Batch(stamp, records, table.filter(F.col(MALFORMED).isNotNull())
                 .select(*LINE_ARRIVAL, MALFORMED))
