"""Raw snapshots: JSON files whose name tells query, page and time.

    <prefix>_<query words>_page_<NNN>_<yyyymmdd_hhmmss>.json
    <prefix>_<query words>_<yyyymmdd_hhmmss>.json            (page 1)

Each file is one object with a `jobs` array. Items are read as JSON text and
parsed one by one, so an item that is not an object cannot void its
neighbours. Only the newest batch or snapshot is opened: its time is found from
file names alone, then goes into the name filter of the reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.fixed import (PAGED_LIST_FIELDS, PAGED_TEXT_FIELDS, SNAPSHOT_LIST_FIELDS,
                            SNAPSHOT_TEXT_FIELDS)
from postmill.functions.values import parse_stamp
from postmill.operators import checks
from postmill.plans.staging import records_without_id

_TEXT, _LIST = T.StringType(), T.ArrayType(T.StringType())


def _struct(texts: Sequence[str], lists: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, _TEXT) for c in texts]
                        + [T.StructField(c, _LIST) for c in lists])


PAGED_JOB = _struct(PAGED_TEXT_FIELDS, PAGED_LIST_FIELDS)
SNAPSHOT_JOB = _struct(SNAPSHOT_TEXT_FIELDS, SNAPSHOT_LIST_FIELDS)

ARRIVAL = ("_source_file", "_position")
STAMP_AT_END = r"_([0-9]{8}_[0-9]{6})\.json$"


def with_arrival(df: DataFrame) -> DataFrame:
    """A table read from Parquet files with the file of each row and its place there.

    Both are hidden columns of the reader. Together they are the order of arrival, where
    files are named by their time, so the first or last row of a key can be kept although
    no column stores a position."""
    return df.select("*", F.col("_metadata.file_name").alias(ARRIVAL[0]),
                     F.col("_metadata.row_index").alias(ARRIVAL[1]))


def file_stamp(name: Column) -> Column:
    return F.regexp_extract(name, STAMP_AT_END, 1)


def paged_name(name: Column, prefix: str) -> dict[str, Column]:
    """Query, page, stamp and collection time of a page file; other names are an error."""
    paged = rf"^{prefix}_(.+)_page_([0-9]{{3}}){STAMP_AT_END}"
    legacy = rf"^{prefix}_(.+){STAMP_AT_END}"
    is_paged, is_legacy = name.rlike(paged), name.rlike(legacy)
    bad = F.raise_error(F.concat(F.lit("unexpected file name: "), name))
    slug = (F.when(is_paged, F.regexp_extract(name, paged, 1))
            .when(is_legacy, F.regexp_extract(name, legacy, 1)).otherwise(bad.cast("string")))
    page = F.when(is_paged, F.regexp_extract(name, paged, 2)).otherwise("1").cast("int")
    return {"_source_query": F.replace(slug, F.lit("_"), F.lit(" ")), "_source_page": page,
            "_collected_at": collected_at(name)}


def collected_at(name: Column) -> Column:
    """Collection time as ISO text; now, when the name holds none."""
    stamp = F.nullif(file_stamp(name), F.lit(""))
    when = F.coalesce(parse_stamp(stamp), F.current_timestamp())
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def newest_stamp(spark: SparkSession, folder: str, prefix: str) -> str:
    """Greatest file time of the folder; reads names, never contents."""
    names = (spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*.json")
             .load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name")))
    stamp = file_stamp(F.col("name"))
    checked = F.when(stamp != "", stamp).otherwise(
        F.raise_error(F.concat(F.lit("unexpected file name: "), F.col("name"))).cast("string"))
    newest = names.agg(F.max(checked).alias("n")).first()["n"]
    if newest is None:
        raise FileNotFoundError(f"no {prefix}_*.json files in {folder}")
    return newest


def newest_name(spark: SparkSession, folder: str, prefix: str) -> str:
    """Greatest file name of the folder."""
    name = F.element_at(F.split("path", "/"), -1)
    newest = (spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*.json")
              .load(folder).agg(F.max(name).alias("n")).first()["n"])
    if newest is None:
        raise FileNotFoundError(f"no {prefix}_*.json files in {folder}")
    return newest


def read_envelopes(spark: SparkSession, folder: str, name_filter: str,
                   counts: dict[str, str]) -> DataFrame:
    """One row per file: its name, its items as JSON text and its counts.

    `counts` maps count fields of the object to output columns.
    """
    schema = T.StructType([T.StructField("jobs", _LIST)]
                          + [T.StructField(c, T.LongType()) for c in counts])
    return (spark.read.schema(schema).option("multiLine", True)
            .option("pathGlobFilter", name_filter).json(folder)
            .select(F.col("_metadata.file_name").alias("_source_file"), "jobs",
                    *[F.col(f"`{c}`").alias(out) for c, out in counts.items()]))


def files_without_jobs(envelopes: DataFrame) -> DataFrame:
    """Files whose `jobs` is absent or not an array."""
    return envelopes.filter(F.col("jobs").isNull()).select("_source_file")


def explode_jobs(envelopes: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per item that is an object, with its place in the file."""
    items = envelopes.select(*[c for c in envelopes.columns if c != "jobs"],
                             F.posexplode("jobs").alias("_position", "_item"))
    kept = items.filter(F.ltrim("_item").startswith("{"))
    return (kept.withColumn("_job", F.from_json("_item", schema)).drop("_item")
            .select("_job.*", *[c for c in items.columns if c != "_item"]))


def read_paged(spark: SparkSession, folder: str, prefix: str, verify: bool = True) -> DataFrame:
    """Records of the newest batch, with query, page, file and position."""
    stamp = newest_stamp(spark, folder, prefix)
    envelopes = read_envelopes(spark, folder, f"{prefix}_*_{stamp}.json",
                               {"totalCount": "_total_count"})
    named = envelopes.withColumns(paged_name(F.col("_source_file"), prefix))
    records = explode_jobs(named, PAGED_JOB)
    if verify:
        checks.assert_empty(files_without_jobs(envelopes), "files without a jobs array")
        checks.assert_some(records, "the newest batch has no records")
        checks.assert_empty(records_without_id(records, "guid").select("_source_file"),
                            "records without guid")
    return records


def read_snapshot(spark: SparkSession, folder: str, prefix: str, verify: bool = True) -> DataFrame:
    """Records of the newest snapshot; the counts of its envelope stay beside them."""
    envelopes = read_envelopes(spark, folder, newest_name(spark, folder, prefix),
                               {"job-count": "_job_count", "total-job-count": "_total_job_count"})
    if verify:
        checks.assert_empty(files_without_jobs(envelopes), "files without a jobs array")
    return (explode_jobs(envelopes, SNAPSHOT_JOB)
            .withColumn("_collected_at", collected_at(F.col("_source_file"))))
