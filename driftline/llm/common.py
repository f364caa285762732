"""Shared plumbing: table reading, intermediate tables in the cluster's shared folder, screens, Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.shared import delete, shared_dir

#: Rows that a Python operator holds as Python objects at a time. Spark cuts Arrow batches at 64 MB as well
#: (spark.sql.execution.arrow.maxBytesPerBatch), so that is the most, or one row if that is longer.
ROWS = 256
#: Rows of an Arrow batch while an intermediate table is written: both sides hold a batch or two of them at a time.
BATCH = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bits of a screen.
SCREEN = 1 << 26


def fresh(columns: list[str], name: str) -> str:
    """A column name that isn't among the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The scratch folders made since ``owned`` began, by run: other threads have their own.
_OWNED: ContextVar[list | None] = ContextVar("owned", default=None)


@contextmanager
def owned() -> Iterator[list]:
    """The scratch folders that are made within, by this run alone."""
    token = _OWNED.set([])
    try:
        yield _OWNED.get()
    finally:
        _OWNED.reset(token)


class Scratch:
    """Intermediate Parquet tables in the shared folder. They cut lineage: a lost executor loses none of them. Operators
    drop what they don't need any more; what a result still reads goes when the program ends, or by ``clear``."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.live.append(self)
        own = _OWNED.get()
        if own is not None:
            own.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, BATCH)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def remove(self) -> None:
        delete(self.spark, self.root)
        if self in self.live:
            self.live.remove(self)


def clear(since: int = 0) -> None:
    """Deletes the tables of all but the first ``since`` scratch folders of this program."""
    for scratch in Scratch.live[since:]:
        scratch.remove()


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear()
    except Exception as e:  # the JVM may be gone before this program
        print(f"scratch tables stay: {type(e).__name__}")


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SCREEN))


def screen(rows: DataFrame, key: str) -> DataFrame:
    """A bitmap of the keys' hashes, as rows of a word's place and its 64 bits: at most 2^20 rows of two numbers (16 MB),
    however many keys there are, so it may be broadcast. The more keys, the more others pass by chance."""
    return rows.select(_place(key).alias("h")).groupBy(F.expr("h div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("__bits"))


def screened(rows: DataFrame, key: str, screen_: DataFrame, within: bool = True) -> DataFrame:
    """The rows whose key may be among the screen's; with ``within`` false those whose key can't be, nulls too. Neither
    moves a row; an exact join of the few that may be follows."""
    place, word, bits = (fresh(rows.columns, n) for n in ("screen_place", "screen_word", "screen_bits"))
    placed = rows.withColumn(place, _place(key)).withColumn(word, F.expr(f"{place} div 64"))
    met = placed.join(F.broadcast(screen_.select(F.col("__word").alias(word), F.col("__bits").alias(bits))), word, "left")
    may = F.coalesce(F.getbit(bits, F.expr(f"cast({place} % 64 as int)")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return met.where(may if within else ~may).select(*[F.col(f"`{c}`") for c in rows.columns])


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
