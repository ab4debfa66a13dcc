"""What the operators share: scratch tables, Arrow mapping and row numbering."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.workers import importable

#: Rows and bytes of one Arrow batch: bounds the memory of a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

_own_folder: list[str] = []
#: Tables that ``stored`` has written in this process.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (tests, benchmarks) gets a temporary
    folder that goes at exit; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def new_folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder in the shared one, which ``cleaned`` deletes."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts lineage: a lost executor costs tasks, not the steps before. Results are read
    from such tables, so they stay until ``cleaned``.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from ``stored`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def cleaned(spark: SparkSession) -> None:
    """Delete all tables that ``stored`` has written in this process: call it once results are saved elsewhere."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now."""
    gc.collect()
    spark._jvm.System.gc()


def batched(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and let workers import this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_map(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with a function from a batch to a dict of columns, or None.

    ``fn(batch)`` gives a mapping from each field of ``schema`` to an array.
    """
    spark = df.sparkSession
    batched(spark)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (got := fn(batch)) is not None:
                yield record_batch(got, fields)

    return df.mapInArrow(run, schema)


def record_batch(columns: dict, fields: pa.Schema) -> pa.RecordBatch:
    """A batch of ``fields`` from arrays, lists or numpy arrays by name."""
    made = []
    for f in fields:
        c = columns[f.name]
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        if not isinstance(c, pa.Array):
            c = pa.array(c, type=f.type)
        elif c.type != f.type:
            c = c.cast(f.type)
        made.append(c)
    return pa.RecordBatch.from_arrays(made, schema=fields)


def partition_map(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with a function from a partition's whole table to dicts of columns.

    For partitions whose size the caller has bounded.
    """
    spark = df.sparkSession
    batched(spark)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            for columns in fn(pa.Table.from_batches(got)):
                yield record_batch(columns, fields)

    return df.mapInArrow(run, schema)


def grouped_map(df: DataFrame, keys: list[str], fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.groupBy(*keys).applyInArrow`` with a function from a group's table to a dict of columns.

    A task holds one group at a time, however many it has; the caller bounds a group.
    """
    batched(df.sparkSession)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([record_batch(fn(table), fields)])

    return df.groupBy(*keys).applyInArrow(run, schema)


def doc_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) of ``docs``; other columns go."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def aside(df: DataFrame, keep: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with all columns but ``keep`` under names that clash with none, and what gives them back.

    That takes the DataFrame made of it and names of new columns to keep beside the old ones.
    """
    names = df.columns
    new = [c if c in keep else f"__aside_{i}" for i, c in enumerate(names)]
    return df.toDF(*new), lambda done, *more: done.select(*(F.col(n).alias(c) for n, c in zip(new, names, strict=True)), *more)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions, ``least`` at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``df`` by the hash of a key column: all if there are no more.

    Else nine tenths of ``most`` are expected; the hash decides in each task, so tasks send
    no more than what is kept.
    """
    n = df.count()
    if n > most:
        df = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(99)), F.lit(1 << 40)) < int(0.9 * most / n * (1 << 40)))
    return df.orderBy(F.xxhash64(key), key).limit(most)


def salts_for(rows: int) -> int:
    """Salts that leave about a million rows to each, were all in one group."""
    return max(64, -(-rows // 1_000_000))


def numbered(df: DataFrame, group: list[str], order: list, name: str, salts: int = 64) -> DataFrame:
    """Number the rows of each group from 0, with a third of all rows in one group or not.

    Rows get a salt by the hash of the order columns; counts by (group, salt) give each
    salt its first number, and a window numbers the rows within (group, salt). Numbers
    are gapless; their order is by salt, then by ``order``. ``df`` is read twice.
    """
    salt, base = "_salt", "_base"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*group, salt).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, salt, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*group, salt).orderBy(*order)
    rows = salted.withColumn("_row", F.row_number().over(within) - 1)
    joined = rows.join(bases, [*group, salt], "left")
    return joined.withColumn(name, (F.col("_row") + F.col(base)).cast("long")).drop("_row", base, salt)
