"""What the operators of this package share: the word pattern, table reading and cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters for functions that take a list of characters.
SPACES = " \t\n\x0b\x0c\r"

_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may do without: it gets one of its own, which is
    removed when Python ends; a cluster session without the setting is refused, as executors share no other folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_folders[app] = tempfile.mkdtemp(prefix="fairlead-llm-")
        atexit.register(shutil.rmtree, _own_folders[app], True)
    return f"file://{_own_folders[app]}"


#: A public setting of Spark: shuffle files go when the query that made them has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what stands before it is neither planned nor run again, also not when an
    executor is lost later; and its shuffle files are not needed any more, so they are removed at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def emptied(*tables: DataFrame) -> None:
    """Frees the space of tables from `written` on which no result depends any more."""
    for table in tables:
        table.sparkSession.range(0).write.mode("overwrite").parquet(table.written_to)


def given_back() -> None:
    """At the end of a task: what Arrow's pool and the C heap hold without use goes back, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_text(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]]]) -> DataFrame:
    """Runs a function over record batches of df. start() is called once in each task and returns that function, which
    maps a batch to columns of the schema; nothing outlives a task, so that lost tasks can simply run again."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        each = start()
        for batch in batches:
            for part in sliced(batch):
                made = each(part)
                yield pa.RecordBatch.from_arrays([a if isinstance(a := made[f.name], pa.Array) else pa.array(a, type=f.type, from_pandas=False) for f in arrow], schema=arrow)
        given_back()

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about most_bytes, so that memory follows the longest text and not the batch."""
    rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def dealt_afresh(totals: DataFrame, key: str) -> DataFrame:
    """totals with its whole-number key written as an expression of its own. A join on the key an aggregate was dealt by
    would take over the aggregate's partitions as they are, and a hot key of the other side would stay in one task; so
    both sides are dealt for the join, and Spark can split what is large."""
    return totals.withColumn(key, F.bitwise_not(F.bitwise_not(key)))
