"""Problem 3: records that are the same but for formatting or the order of their fields.

Canonical records are range-partitioned by (record, id) and sorted outside memory; a scan of
neighbours then compares whole records. As the id takes part in the ranges, a record that holds
a third of all rows is spread over many partitions, and no task ever holds a whole group. A run
that goes on in the next partition is joined up afterwards from one small row per partition.

Defined results: a null or empty field makes a metadata record no record (it is left out), while
for cluster keys empty parts count; a row repeated with the same id adds to the copy count but
gives no copy; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from tonewright.functions.unicode import name_key_of
from tonewright.sources.checkpoints import cut
from tonewright.sources.tables import table

SEPARATOR = "\x1f"


@arrow_udf(StringType())
def record_of_fields(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
    """The three name keys in one order for all orders of the fields; null if one is missing."""
    out = []
    for fields in zip(a.to_pylist(), b.to_pylist(), c.to_pylist()):
        keys = sorted(map(name_key_of, fields))
        out.append(SEPARATOR.join(keys) if keys[0] else None)
    return pa.array(out, pa.string())


@arrow_udf(StringType())
def record_of_parts(keys: pa.Array) -> pa.Array:
    """The name keys of the parts between '|', sorted; empty parts count, null stays null."""
    return pa.array([None if x is None else SEPARATOR.join(sorted(map(name_key_of, x.split("|")))) for x in keys.to_pylist()], pa.string())


# or the filter on the record would evaluate them again
record_of_fields, record_of_parts = record_of_fields.asNondeterministic(), record_of_parts.asNondeterministic()

RUNS = "part int, edge boolean, open boolean, id string, first string, n long, first_key string, last_key string, last_first string"


def _scan(id_type: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first_key = last_key = run_first = last_id = None
        opening = True
        for batch in batches:
            if not batch.num_rows:
                continue
            records, ids = batch.column(0), batch.column(1)
            n = len(records)
            before_r = pa.concat_arrays([pa.array([last_key], pa.string()), records.slice(0, n - 1)])
            before_i = pa.concat_arrays([pa.array([last_id], id_type), ids.slice(0, n - 1)])
            starts = pc.fill_null(pc.not_equal(records, before_r), True).to_numpy(zero_copy_only=False)
            again = pc.fill_null(pc.equal(ids, before_i), False).to_numpy(zero_copy_only=False) & ~starts
            if first_key is None:
                first_key = records[0].as_py()
            begin = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            text = ids.cast(pa.string())
            firsts = pa.array([run_first], pa.string()) if run_first is not None else pa.array([None], pa.string())
            firsts = pc.take(pa.concat_arrays([firsts, text]), pa.array(begin + 1))
            breaks = np.flatnonzero(starts)
            opened = np.zeros(n, bool)
            if opening:
                # the rows up to the second start of a run belong to the run that may have begun in an earlier partition
                later = breaks[1:] if last_key is None else breaks
                stop = int(later[0]) if len(later) else n
                opened[:stop] = True
                opening = not len(later)
            fresh = ~again
            # rows of the same id count once more but are no other copy: keep them as rows without id
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), pa.array(np.zeros(n, bool)), pa.array(opened), pc.if_else(pa.array(fresh), text, pa.scalar(None, pa.string())), firsts, pa.array(np.ones(n, np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
                names=["part", "edge", "open", "id", "first", "n", "first_key", "last_key", "last_first"],
            )
            last_key, last_id, run_first = records[n - 1].as_py(), ids[n - 1].as_py(), firsts[n - 1].as_py()
        if first_key is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "edge": True, "open": opening, "id": str(last_id), "first": None, "n": 0, "first_key": first_key, "last_key": last_key, "last_first": run_first}], schema=pa.schema([("part", pa.int32()), ("edge", pa.bool_()), ("open", pa.bool_()), ("id", pa.string()), ("first", pa.string()), ("n", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("last_first", pa.string())]))

    return scan


def _stitch(edges: list) -> list[tuple[int, str, str]]:
    """For each partition whose first run began earlier: partition, first id of that run, last id before it."""
    out, first, key, last_id = [], None, None, None
    for e in sorted(edges, key=lambda e: e.part):
        going_on = key is not None and e.first_key == key
        if going_on:
            out.append((e.part, first, last_id))
        if not (going_on and e.open):
            first = e.last_first
        key, last_id = e.last_key, e.id
    return out


def sorted_runs(records: DataFrame) -> DataFrame:
    """Rows of (record, id) by runs of equal records: id, first (the run's smallest id), n = 1; a repeated row has id null.

    ``records`` has the columns record and id (long or string); rows with a null in either are no records.
    """
    spark = records.sparkSession
    kept = records.where(F.col("record").isNotNull() & F.col("id").isNotNull()).select("record", "id")
    id_type = pa.int64() if dict(kept.dtypes)["id"] == "bigint" else pa.string()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(kept.repartitionByRange(n, "record", "id").sortWithinPartitions("record", "id").mapInArrow(_scan(id_type), RUNS))
    # one row per partition, so its size is bounded by the number of partitions
    stitched = _stitch(runs.where("edge").select("part", "open", "id", "first_key", "last_key", "last_first").collect())
    went_on = spark.createDataFrame(stitched, "part int, earlier string, before string")
    joined = runs.where(~F.col("edge")).join(F.broadcast(went_on), "part", "left")
    first = F.when(F.col("open"), F.coalesce("earlier", "first")).otherwise(F.col("first"))
    # the same id may stand on both sides of a partition's border
    again = F.col("open") & (F.col("id") == F.col("before"))
    return joined.select(F.when(~F.coalesce(again, F.lit(False)), F.col("id")).alias("id"), first.alias("first"), "n")


def metadata_records(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "metadata", "file_id", "tag_artist", "tag_album", "tag_title")
    return m.select(record_of_fields("tag_artist", "tag_title", "tag_album").alias("record"), F.col("file_id").alias("id"))


def cluster_records(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "clusters", "cluster_key")
    return c.select(record_of_parts("cluster_key").alias("record"), F.col("cluster_key").alias("id"))


def _both(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    return [("metadata", sorted_runs(metadata_records(spark, folder))), ("clusters", sorted_runs(cluster_records(spark, folder)))]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy with the first record of its set."""
    parts = [r.where(F.col("id").isNotNull() & (F.col("id") != F.col("first"))).select(F.lit(t).alias("record_table"), F.col("first").alias("first_key"), F.col("id").alias("copy_key")) for t, r in _both(spark, folder)]
    return parts[0].unionByName(parts[1])


def p3_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One record per set with the rows and the different ids it stands for."""
    parts = [r.groupBy("first").agg(F.sum("n").alias("row_count"), F.count("id").alias("copies")).select(F.lit(t).alias("record_table"), F.col("first").alias("first_key"), "row_count", "copies") for t, r in _both(spark, folder)]
    return parts[0].unionByName(parts[1])


QUERIES = {"p3_found": p3_found, "p3_copies": p3_copies}

SQL: dict[str, str] = {}
