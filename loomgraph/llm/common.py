"""What several operators share: written intermediate tables, Arrow text batches and id ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.frames import in_small_batches, trim  # noqa: F401
from loomgraph.scratch import drop_path, scratch_path, written_paths

#: White space of every word definition here: a word is [^\x20\x09-\x0D]+.
SPACES = "\\x20\\x09-\\x0D"


def materialize(df: DataFrame, name: str, files: int | None = None, **options: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: the lineage ends there and survives lost executors.

    files: at most so many, for tables that are small beside the input (see files_for).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables of materialize() that no plan reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        paths = written_paths(sc)
        if df._loom_path in paths:
            paths.remove(df._loom_path)
            drop_path(sc, df._loom_path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialize() of what make() gives; the tables that were written on the way are removed."""
    paths = written_paths(spark.sparkContext)
    before = set(paths)
    out = materialize(make(), name)
    for path in [p for p in paths if p not in before and p != out._loom_path]:
        paths.remove(path)
        drop_path(spark.sparkContext, path)
    return out


#: A table of at most so many narrow rows is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 20_000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a written table of one row for each key.

    A small table goes to every task, so that a hot key costs nothing; with a large one both sides are plain shuffles, of
    which adaptive execution splits the partitions of hot keys.
    """
    few = table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(table) if few else table.hint("merge"), key)


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Written rows with their number (0 to n - 1) in place of lot and nth, and n.

    lot: a number of the task that wrote the row, nth: its place there. The driver and every task get one row for each lot.
    """
    lots = rows.groupBy("lot").agg(F.count("*").alias("_n"))
    before = Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    bases = lots.select("lot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    total = lots.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    return rows.join(F.broadcast(bases), "lot").withColumn(name, F.col("_base") + F.col("nth")).drop("lot", "nth", "_base"), total


def text_of(column: Column | str) -> Column:
    """Null text counts as empty in every operator."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def batches(rows: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """The rows again in tables of up to most_bytes of the column; a longer single value gets a table of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in rows:
        if not batch.num_rows:
            continue
        lengths = np.diff(utf8(batch.column(column))[1])
        start, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if total + n + size > most_bytes and (i > start or held):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start, total = [], 0, i, 0
            total += n
        held.append(batch.slice(start))
        size += total
    if held:
        yield pa.Table.from_batches(held)
    trim()


def slices(rows: Iterable[pa.RecordBatch], most: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of at most so many, so that few of them stand as Python objects at once."""
    for batch in rows:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)
    trim()


_LOWEST = -(1 << 63)


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """parts - 1 ascending values of the key that cut the rows into even ranges; a value that fills several ranges stands as often.

    Null keys count as the lowest number. The driver gets one value for each partition, never more; the aggregate itself is a
    bounded sketch.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.coalesce(key, F.lit(_LOWEST)), at, max(10_000, 50 * parts)).alias("b")).first()
    return sorted(row["b"] or [])


def spot_of(text: Column) -> Column:
    """53 bits of a hash, which put the texts of one key in an order."""
    return F.shiftrightunsigned(F.xxhash64(text), 11)


def range_index(bounds: Sequence[int], key: str, spot: str) -> Column:
    """Number of the range that holds the row, in the order of key (null first), then spot.

    The rows of a key that fills several ranges are dealt out over these by spot, so no key makes a range large.
    """
    held = np.asarray(bounds, np.int64)

    @F.arrow_udf(T.IntegerType())
    def index(keys: pa.Array, within: pa.Array) -> pa.Array:
        values, share = keys.to_numpy(zero_copy_only=False), within.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(held, values, "left"), np.searchsorted(held, values, "right")
        spread = low + 1 + np.floor(share * (high - low)).astype(np.int64)
        return pa.array(np.where(high > low, np.minimum(spread, high), high).astype(np.int32))

    own, share = F.col(key), F.col(spot) / float(1 << 53)
    share = F.when(own.isNull(), share / 2).when(own == _LOWEST, 0.5 + share / 2).otherwise(share)
    return index(F.coalesce(own, F.lit(_LOWEST)), share)


def partitions_for(df: DataFrame, mb: float = 32.0) -> int:
    """A partition count by the size of df's files, at least the session's number of shuffle partitions, at most MOST_TASKS.

    It says how many tasks share the work and nothing else: what a task holds at once does not depend on it. Plans
    without files have no known size (Spark then says 8 EB) and get the session's number.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = int(size / (mb * 2**20)) + 1 if size < 1 << 50 else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, MOST_TASKS))


def files_for(df: DataFrame, mb: float = 32.0) -> int:
    """Files of a table that is made from df: two for each core, or one for so many MB of df's files if that is more."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = int(size / (mb * 2**20)) + 1 if size < 1 << 50 else 0
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, min(wanted, MOST_TASKS))


#: Tasks of one stage; each task streams its rows, so beyond it tasks take longer but hold no more.
MOST_TASKS = 100_000


#: Bits of a sieve: 16 MB, whatever the input.
SIEVE_BITS = 1 << 27


class Sieve:
    """A bitmap of fixed size over ids, made by a distributed aggregate: it lets every id put in pass, and few others.

    It only spares work: what passes is judged exactly afterwards, so a full sieve costs time and never changes a result.
    """

    def __init__(self, ids: DataFrame, column: str):
        words = ids.where(F.col(column).isNotNull()).select(F.shiftright(self.place(column), 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(xxhash64({column}), {SIEVE_BITS}) & 63))").alias("bit"))
        # at most SIEVE_BITS / 64 rows
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        held = np.zeros(SIEVE_BITS // 64, np.int64)
        held[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(held)

    @staticmethod
    def place(column: str) -> Column:
        """The bit of an id."""
        return F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))

    def test(self) -> Callable[[pa.Array], pa.Array]:
        """A function for Python workers that says for bits whether they are set; null is not."""
        shared = self.shared

        def run(places: pa.Array) -> pa.Array:
            at = places.fill_null(0).to_numpy(zero_copy_only=False)
            return pa.array(((shared.value[at >> 6] >> (at & 63)) & 1 == 1) & places.is_valid().to_numpy(zero_copy_only=False))

        return run

    def passes(self, column: str) -> Column:
        return F.arrow_udf(self.test(), T.BooleanType())(F.when(F.col(column).isNotNull(), self.place(column)))


def grouped(rows: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """Rows that lie together and agree in the columns named, a table for each group."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in rows:
        keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        start = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, key = [], i, k
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
