"""What the operators need of the cluster: the shared folder, partition counts and bounded broadcast filters."""

from __future__ import annotations

import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROW_FILTER_BITS = 1 << 24


BATCH_ROWS = 2000
TRIM_S = 5
_OWN: dict[str, str] = {}
_TRIMMED: dict[str, float] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of our own, in local mode alone: on a
    cluster executors would not share it, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="braidwork-")
        where = _OWN[context.applicationId]
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the loss of executors, columns can be pruned.
    Every setting of the session is afterwards as it was. Tables lie under the application's id; discard() deletes one that nothing reads any more, clean() all."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braidwork/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:  # smaller batches for kernels while this is written, so that both sides hold less at once
        if not 0 < int(rows) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))
        df.write.parquet(path)
    finally:
        spark.conf.set(name, rows)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def trim_driver(spark: SparkSession) -> bool:
    """Give memory that the C allocator of the driver's JVM holds back to the system, every TRIM_S seconds at most: each of the
    threads that plan and compile queries leaves some in an arena of its own. A heap that has grown over half of its limit is
    collected first, as it shrinks by that. False where nothing was trimmed: too early, or a JVM without that command (its own,
    jcmd System.trim_native_heap). No setting is changed."""
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _TRIMMED.get(app, -TRIM_S) < TRIM_S:
        return False
    _TRIMMED[app] = now
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()
    try:
        named = lambda c: jvm.java.lang.Class.forName(c)
        kinds = new_array(jvm.java.lang.Class, 4)
        kinds[0], kinds[1], kinds[2], kinds[3] = (named(c) for c in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        given = new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface: the class behind it is not open to reflection.
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # another JVM or C library
        return False
    return True


def bound_batches(spark: SparkSession) -> None:
    """For operators whose result is a kernel over texts that runs only when the caller reads it: the session's Arrow
    batches hold BATCH_ROWS rows at most from now on (a smaller setting stays), as vectors of long texts are what an
    executor's memory goes to outside its heap. Kernels themselves cut batches by bytes (words.pieces)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for these tables, once all that is made of them has been written too."""
    for df in tables:
        _delete(df.sparkSession, df._written)


def clean(spark: SparkSession) -> None:
    """Delete all that materialize() wrote in this application; for the end, when no result is read any more."""
    _delete(spark, f"{shared_dir(spark)}/braidwork/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


HOT_SHARE = 200


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left join right on one key column, where many rows of `left` may hold the same key: a key with more than one in
    HOT_SHARE of left's rows (there are fewer than HOT_SHARE of them) is cut into parts of at most that share by a hash of
    the column `by`, and the rows of `right` that it meets are repeated for each part: all in all for at most twice
    HOT_SHARE parts. Both tables are read twice, so write them first. counts: (key, count) where they are known."""
    total = left.count()
    counts = left.groupBy(key).count() if counts is None else counts
    hot = counts.where(F.col("count") * HOT_SHARE > total).where(F.col(key).isNotNull()).collect() if total >= HOT_SHARE else []
    if not hot:
        return left.join(right, key, how)
    parts = F.coalesce(F.create_map(*[F.lit(x) for k, n in hot for x in (k, -(-n * HOT_SHARE // total))])[F.col(key)], F.lit(1))
    left = left.withColumn("__part", F.pmod(F.xxhash64(by), parts.cast("long")).cast("int"))
    return left.join(right.withColumn("__part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))), [key, "__part"], how).drop("__part")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below a plan, as the optimizer estimates them; works for any file system."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())
    except Exception:  # a plan without statistics
        return 0


def buckets(df: DataFrame, per_bucket: int = 24 << 20) -> int:
    """Shuffle buckets for packed payloads: the session's partitions, more where the input is larger than they hold."""
    spark = df.sparkSession
    known = input_bytes(df)
    known = known if known < 1 << 60 else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(known // per_bucket, 1 << 20), 1)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. They go by Arrow: createDataFrame() of a list runs Python on the executors, whose
    workers are others than those of the kernels and stay in memory beside them."""
    kinds = StructType.fromDDL(schema)
    form = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(form)], schema=form), kinds)


class RowFilter:
    """A fixed-size bitmap of row keys (2 MB), so that rows which surely lack a match skip a shuffle.

    False positives only cost a row's shuffle. However many keys there are, the size is the same; with far more keys
    than bits it lets everything through and the join behind it does all the work.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = ROW_FILTER_BITS, hashed: bool = False):
        """hashed: the keys are 64-bit hashes already, and has() can be asked in a kernel."""
        self.bits, self.hashed = bits, hashed
        at = self.position(F.col(column))
        rows = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
        self.pages = [(b, np.frombuffer(bytes(m).ljust(4096, b"\0"), np.int64)) for b, m in rows]

    @property
    def map(self) -> np.ndarray:
        """All bits, for has()."""
        out = np.zeros(self.bits // 8 + 4096, np.uint8)
        for b, page in self.pages:
            out[(b - 1) * 4096 : b * 4096] = page.view(np.uint8)
        return out

    def position(self, column):
        return F.pmod(column if self.hashed else F.xxhash64(column), F.lit(self.bits)) + F.lit(1)

    @staticmethod
    def has(bitmap: np.ndarray, hashes: np.ndarray, bits: int = ROW_FILTER_BITS) -> np.ndarray:
        """For hashed keys: which of them may be present."""
        p = (hashes.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
        return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    def keep(self, df: DataFrame, column: str, present: bool = True) -> DataFrame:
        """Rows whose key may be among the keys (or, present=False, surely is not). No Python runs on the executors: a kernel
        behind or before this one would need a second worker for each core."""
        page = "__page"
        while {page, f"{page}_bits"} & {*df.columns}:
            page += "_"
        pages = local_table(df.sparkSession, self.pages, f"{page} long, {page}_bits array<long>")
        at = self.position(F.col(column))
        bit = F.bitmap_bit_position(at)
        held = F.getbit(F.get(f"{page}_bits", F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        return df.join(F.broadcast(pages), (F.bitmap_bucket_number(at) == F.col(page)) & held, "left_semi" if present else "left_anti")
