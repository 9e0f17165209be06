"""Reading tables, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table (a few numbers each, so a few MB) up to which it is broadcast, or worked on in one task.
SMALL = 50_000


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until df has no such column (of any case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


class Work:
    """A folder in the shared one for the written tables and files of one operator call.

    Tables written here cut lineage and survive lost executors. drop() removes a table
    that no later step reads; what the result still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._ended)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").mode("overwrite").parquet(self.at(name))
        return self.spark.read.parquet(self.at(name))

    def narrow(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table of a few numbers a row; if it has at most SMALL rows, joins get it by broadcast."""
        out = self.write(df, name)
        return F.broadcast(out) if out.count() <= SMALL else out

    def drop(self, name: str = "") -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _ended(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.drop()


class Memo(dict):
    """A bounded table of what is known of words. Words are numbered as they are first met; when the
    table holds more than `items` words or `chars` characters it starts anew."""

    def __init__(self, items: int, chars: int = 1 << 25) -> None:
        self.items, self.chars = items, chars
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.values_: list = []
        self.pending: list = []
        self.held = 0

    def __missing__(self, word) -> int:
        n = self[word] = len(self.values_) + len(self.pending)
        self.pending.append(word)
        return n

    def look_up(self, words: list, learn: Callable[[list], Iterable]) -> list:
        """A value for each word; learn gives those of distinct unknown words."""
        if len(self) > self.items or self.held > self.chars:
            self.reset()
        numbers = list(map(self.__getitem__, words))
        if self.pending:
            gc.freeze()  # the table's many entries are no garbage; they needn't be walked again
            self.held += sum(map(len, self.pending))
            self.values_.extend(learn(self.pending))
            self.pending = []
        return list(map(self.values_.__getitem__, numbers))


_TABLES: dict = {}


def worker_table(key: tuple, make: Callable):
    """The table that this worker process keeps from task to task for one operator. Those of others are given
    up, and what earlier tasks have freed goes back to the system: workers live on from stage to stage."""
    if key not in _TABLES:
        _TABLES.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)
    if key not in _TABLES:
        _TABLES[key] = make()
    return _TABLES[key]


def no_table(operator: str) -> None:
    """For tasks of operators that keep nothing."""
    worker_table((operator,), object)


def groups(texts: Iterable, chars: int = 1 << 20) -> Iterator[list[str]]:
    """Arrow strings as lists of Python strings of about `chars` characters together; null is empty."""
    own, n = [], 0
    for x in texts:
        own.append(x.as_py() or "")
        n += len(own[-1])
        if n >= chars:
            yield own
            own, n = [], 0
    if own:
        yield own


#: Bits of a routing bitmap: a fixed size, whatever the number of ids.
ROUTE_BITS = 23


def routed(ids: DataFrame, *cols: str) -> bytes:
    """A bitmap of fixed size of the hashes of columns, built in the executors."""
    place = F.pmod(F.xxhash64(*cols), F.lit(1 << ROUTE_BITS)) + 1  # both functions count from 1
    parts = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    size = 1 << 12
    out = bytearray((1 << ROUTE_BITS) // 8)
    for bucket, bits in parts:
        out[(bucket - 1) * size : bucket * size] = bits.ljust(size, b"\0")
    return bytes(out)


def picked(rows: DataFrame, ids: DataFrame, *cols: str) -> DataFrame:
    """Those rows that the bitmap of ids lets through (all that match, and a few more), so that most rows are not moved by the join that follows."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(routed(ids, *cols))
    schema = rows.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            keep = held[batch.column(batch.num_columns - 1).to_numpy()]
            yield batch.filter(pa.array(keep)).select(schema.names)

    return rows.withColumn("__place", F.pmod(F.xxhash64(*cols), F.lit(1 << ROUTE_BITS)).cast("int")).mapInArrow(run, schema)


def among(ids: DataFrame, ids_cols: list[str], cols: list[Column]) -> Column:
    """A condition that holds for all rows whose cols are among ids, and for few others. Only the hash's place goes to
    Python, so that long texts stay where they are. The types of ids_cols and cols must be the same."""
    bits = ids.sparkSession.sparkContext.broadcast(routed(ids, *ids_cols))

    @F.pandas_udf("boolean")
    def told(place: pd.Series) -> pd.Series:
        x = place.to_numpy()
        held = np.frombuffer(bits.value, np.uint8)
        return pd.Series((held[x >> 3] >> (x & 7)) & 1 == 1)

    return told(F.pmod(F.xxhash64(*cols), F.lit(1 << ROUTE_BITS)).cast("int"))
