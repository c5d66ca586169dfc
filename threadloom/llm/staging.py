"""Tables that cut lineage, in the folder all executors share.

A stage that is read more than once, or that must not be recomputed when an
executor is lost, is written as Parquet below ``spark.checkpoint.dir`` and read
back. Only a local master (tests, notebooks) may leave that unset and gets a
temporary folder; on a cluster such a folder would be another one on each executor,
so there an unset setting is an error.

Row numbers are given once, in a stored copy (``numbered``): a second scan may be cut
into other splits, after executors were lost or gained, and would number rows anew.

Tables go when the driver ends, or when the ``settled`` call that they were staged in
returns.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SCOPES: list[list[str]] = []
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a row group of large rows: without that a writer holds a hundred rows before it looks at their size.
GROUP_BYTES = 16 << 20
#: Bytes of a table that may be sent to all executors.
BROADCAST_BYTES = 64 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir`` or, on a local master only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _OWN.setdefault("root", tempfile.mkdtemp(prefix="threadloom-"))
    return f"{root.rstrip('/')}/threadloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends, if not before."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table; a stopped session leaves that to the cluster."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows for the actions inside; the session's setting comes back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def byte_batches(spark: SparkSession, most: int):
    """Arrow batches of about ``most`` bytes for the actions inside, for tables of large rows."""
    return _setting(spark, _BYTES, str(most))


def shuffles_dropped(spark: SparkSession):
    """Shuffle files go as soon as the action that made them ends; what is needed later is staged."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def staged(df: DataFrame, name: str, path: str | None = None, group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    With ``group`` row groups have about so many bytes, looked at after each row. Writers and
    readers hold a row group each, so tables of rows of megabytes need that.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if group:
        checks = [f"parquet.{part}.size.row.check.min" for part in ("page", "block")]
        writer = writer.option("parquet.block.size", group).options(**dict.fromkeys(checks, 1))
    with small_batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``make`` returns and remove the tables that it staged on the way."""
    path = new_path(spark, name)
    _SCOPES.append([])
    try:
        return staged(make(), name, path)
    finally:
        for used in _SCOPES.pop():
            remove(spark, used)


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame, names: list[str] | tuple[str, ...] | None = None) -> Column:
    """Columns (all unless ``names`` says which) as one struct, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(quoted(n)) for n in (docs.columns if names is None else names)])


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """A stored copy of ``docs`` as (row, doc): ``row`` is unique and the same in every scan."""
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs).alias("doc")), name)


def can_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table's rows, as counted now, take at most ``most`` bytes in memory."""
    size = F.lit(64)
    for field in df.schema.fields:
        kind, c = field.dataType.simpleString(), F.col(quoted(field.name))
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("array<"):
            size = size + 8 * F.greatest(F.size(c), F.lit(0))
        else:
            size = size + 8
    return (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= most
