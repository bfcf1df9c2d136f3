"""Shared pieces of the training-data operators: tables, scratch space, skew-safe joins, word shapes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word is a run of characters other than these (\x20 and \x09 to \x0D).
BLANKS = " \t\n\x0b\x0c\r"
# A key with at least one row in so many counts as hot: there are at most as many such keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The folder of a session on one machine that names none, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the cluster's checkpoint folder; a temporary one only for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="tabscout-")
        root = _own_folders[context.applicationId]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in shared space: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underlines after it until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents_text(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def join_by_key(left: DataFrame, right: DataFrame, key: str, count: str, small: Column | None = None) -> DataFrame:
    """left join right on a nullable key, keeping every left row. right: one row per key with its number of left
    rows in `count`. Keys with a thousandth of all rows or more (so at most a thousand) are broadcast, if `small` says that
    their row is; rows of the other keys are shuffled, where adaptive execution splits a large key."""
    total = right.agg(F.sum(count)).first()[0] or 0
    least = max(2.0, total / HOT_SHARE)
    right = right.withColumnRenamed(key, "_k")
    is_hot = (F.col(count) >= least) & (F.lit(True) if small is None else small)
    hot = F.broadcast(right.filter(is_hot))
    same = left[key].eqNullSafe(F.col("_k"))
    first = left.join(hot, same, "inner").drop("_k")
    rest = left.join(hot.select("_k"), same, "left_anti").join(right.filter(~is_hot), same, "left").drop("_k")
    return first.unionByName(rest)


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(list(c), t.type) for c, t in zip(columns, schema)], schema=schema)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows of a generator as record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield rows_to_batch(held, schema)
            held = []
    if held:
        yield rows_to_batch(held, schema)


def values(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of record batches as Python tuples, one per row."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))
