"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of all contracts here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Stands in for a null id wherever ids are compared; sorts before every other.
NULL_ID = -(2**63)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def copies(df: DataFrame, count: str, name: str, step: int = 1 << 16) -> DataFrame:
    """Each row as often as its count says, numbered from 0; no array has more than count / step or step places, whichever is more."""
    n = F.col(count).cast("long")
    first = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(step).cast("long"))))
    return df.withColumn(name, first).withColumn(name, F.explode(F.sequence(F.col(name), F.least(F.col(name) + step, n) - 1)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in a local run, else one in the warehouse."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if sc.applicationId not in _folders:
        local = sc._jsc.sc().isLocal()
        _folders[sc.applicationId] = tempfile.mkdtemp(prefix="millrace-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return _folders[sc.applicationId]


#: Of applications that name no shared folder.
_folders: dict[str, str] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    The table goes when the application ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, bits: int = 1 << 26) -> DataFrame:
    """The rows whose key may be among keys: all that are, and some others. By a bitmap of hashed keys that has at most bits / 8 bytes and is
    broadcast."""
    flag = free_name(rows, "__maybe")
    return marked_maybe(rows, keys, key, flag, bits, "inner").where(flag).drop(flag)


def marked_maybe(rows: DataFrame, keys: DataFrame, key: str, flag: str, bits: int = 1 << 26, how: str = "left") -> DataFrame:
    """rows with a column that is true where maybe_in() keeps them, else false."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = keys.groupBy(F.bitmap_bucket_number(h).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("__bitmap"))
    spot = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (spot % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    out = rows.join(F.broadcast(maps), F.bitmap_bucket_number(h) == F.col("__bucket"), how)
    return out.withColumn(flag, F.coalesce(held, F.lit(False))).drop("__bucket", "__bitmap")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, runs: int = 64) -> DataFrame:
    """An inner join with a table that has one row a key. The rows of a key are dealt to runs by a hash of ``spread``; the table's row goes to
    each run that has the key, so that a frequent key is met in that many parts. Both are merge joins: an operator makes many of these, and
    the driver would hold the small sides of all."""
    run = free_name(rows, "run")
    rows = rows.withColumn(run, F.pmod(F.xxhash64(spread), F.lit(runs)))
    return rows.join(rows.select(run, *keys).distinct().join(table.hint("merge"), keys).hint("merge"), [run, *keys]).drop(run)


def running_sums(df: DataFrame, group: str, order: list[Column], sums: list[str], table: str) -> DataFrame:
    """df with each of the long columns ``sums`` replaced by its running sum (modulo 2**64) within the group, in that order.

    Rows are dealt to tasks by ranges of (group, order), so a group of any size is spread over tasks. Each task sums what it has; a group
    that began in an earlier one adds what came before, of which the driver reads the first and last row of each task. group: a long column
    without nulls.
    """
    columns = df.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `__part` int, `__edge` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, held, edges = TaskContext.get().partitionId(), None, [np.uint64(0)] * len(sums), None, np.zeros(0, np.int32)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(group).to_numpy()
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            sizes = np.diff(np.r_[starts, n])
            out = {c: batch.column(c) for c in columns}
            with np.errstate(over="ignore"):
                for k, c in enumerate(sums):
                    values = batch.column(c).to_numpy().view(np.uint64)
                    total = np.cumsum(values)
                    total -= np.repeat(total[starts] - values[starts], sizes)
                    if g[0] == last:
                        total[: sizes[0]] += carry[k]
                    carry[k] = total[-1]
                    out[c] = pa.array(total.view(np.int64))
            last = g[-1]
            if held is not None:
                yield pa.RecordBatch.from_arrays([*held, pa.array(edges)], [*columns, "__part", "__edge"])
            edges = np.zeros(n, np.int32)
            edges[0] = held is None
            held = [*out.values(), pa.array(np.full(n, part, np.int32))]
        if held is not None:
            edges[-1] += 2
            yield pa.RecordBatch.from_arrays([*held, pa.array(edges)], [*columns, "__part", "__edge"])

    dealt = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    written = materialize(dealt.mapInArrow(run, schema), table)
    ends = sorted(map(tuple, written.where("`__edge` > 0").select("__part", "__edge", group, *sums).collect()))  # two rows a task
    before, last, carry, first = [], None, [0] * len(sums), None
    for part, edge, at, *totals in ends:
        if edge & 1:
            first = at
            if at == last:
                before.append((part, at, *carry))
        if edge & 2:
            carry = [_wrapped(a + b) for a, b in zip(carry, totals, strict=True)] if first == last == at else totals
            last = at
    if not before:
        return written.select(columns)
    fields = ", ".join(f"`__before{k}` long" for k in range(len(sums)))
    late = df.sparkSession.createDataFrame(before, f"`__part` int, `{group}` long, {fields}")
    out = written.join(F.broadcast(late), ["__part", group], "left")
    return out.select([_plus(c, f"__before{sums.index(c)}") if c in sums else F.col(c) for c in columns])


def _wrapped(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def _plus(a: str, b: str) -> Column:
    """The sum modulo 2**64; Spark's own fails beyond 2**63."""
    total = F.col(a).cast("decimal(20,0)") + F.col(b).cast("decimal(20,0)")
    over, turn = F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(20,0)")
    wrapped = F.when(total >= over, total - turn).when(total < -over, total + turn).otherwise(total).cast("long")
    return F.when(F.col(b).isNull(), F.col(a)).otherwise(wrapped).alias(a)
