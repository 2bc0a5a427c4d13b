"""Session helpers."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "talentmesh", driver_memory: str = "8g") -> SparkSession:
    """A session with the settings the engine assumes: UTC session time zone,
    ANSI on, AQE (coalescing and skew-join splitting) on, UI off."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode runs every task in the driver JVM: give it the heap
        b = b.config("spark.driver.memory", driver_memory)
    return b.getOrCreate()


MAX_SHUFFLE_PARTITIONS = 40_000


def sizing_conf(input_bytes: int, partition_bytes: int = 256 << 20, cores: int | None = None) -> dict:
    """Spill-aware settings for an input of ``input_bytes``: file splits and
    shuffle partitions of about ``partition_bytes`` each, with AQE left to
    coalesce small partitions and split skewed ones.  The number of shuffle
    partitions is bounded, as the driver tracks a block for every pair of map
    task and partition; sorts of larger partitions spill."""
    parts = max(200, -(-input_bytes // partition_bytes))
    if cores:
        parts = max(parts, 2 * cores)
    # map tasks x reducers blocks have to be tracked by the driver: beyond
    # MAX_SHUFFLE_PARTITIONS partitions grow instead, and splits with them
    split_bytes = partition_bytes
    if parts > MAX_SHUFFLE_PARTITIONS:
        parts = MAX_SHUFFLE_PARTITIONS
        split_bytes = max(partition_bytes, min(4 * partition_bytes, -(-input_bytes // MAX_SHUFFLE_PARTITIONS)))
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
    }


def apply_conf(spark: SparkSession, conf: dict) -> None:
    for k, v in conf.items():
        spark.conf.set(k, v)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Makes ``talentmesh`` importable in Python workers (pandas UDFs
    reference it by module path): zips the package once and registers it
    with ``addPyFile``, which distributes it to every executor - the same
    thing ``spark-submit --py-files`` does."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="talentmesh-pyfiles-"), "talentmesh.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python tasks in batches of bounded rows and bytes, so that
    neither side holds tens of megabytes of them at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        have = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < have <= most:
            spark.conf.set(key, str(most))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Returns the checkpoint directory named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared folder set by the operator; only when
    it is unset (local runs and tests) is a private scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: point it at a shared folder "
                               "(a machine-local folder does not survive executor loss)")
        configured = tempfile.mkdtemp(prefix="talentmesh-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` (shared by driver and executors), or the
    session's own checkpoint folder where it is unset; inside
    :func:`scratch` the folder of that block."""
    top = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return "/".join([top.rstrip("/"), *_SCRATCH.get()])


_SCRATCH: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession):
    """What is written inside goes into a folder of its own that is deleted at
    the end: no frame that is used later may read it."""
    token = _SCRATCH.set((*_SCRATCH.get(), f"scratch-{uuid.uuid4().hex}"))
    try:
        yield
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    finally:
        _SCRATCH.reset(token)


#: While something is written: shuffle files go when it is done, not when the
#: driver's garbage collector comes upon them; and as tables are compressed,
#: they count ten times their files where a broadcast is considered.
_SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.sources.fileCompressionFactor": "10.0"}


@contextmanager
def sparing(spark: SparkSession):
    """Settings that spare disk and the driver's memory (``_SPARING``)."""
    before = {k: spark.conf.get(k, None) for k in _SPARING}
    apply_conf(spark, _SPARING)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, codec: str | None = None, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back:
    cuts lineage, survives lost executors, evaluates the plan once.  ``by``
    names a column of few values that gets a folder for each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with sparing(spark):
        df.write.parquet(path, partitionBy=by, compression=codec or ("zstd" if _SCRATCH.get() else None))
    return spark.read.schema(df.schema).parquet(path)


def written_in_parts(spark: SparkSession, parts: Iterable[Callable[[], DataFrame]], name: str) -> DataFrame:
    """The rows of all ``parts``, made and written one after the other.  What
    a part shuffles and writes on its way is gone before the next one."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with scratch(spark):   # what the parts share, where ``parts`` makes it on its way
        for part in parts:
            with scratch(spark), sparing(spark):
                df = part()
                df.write.mode("append").parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


__all__ = ["build_session", "ensure_checkpoint_dir", "sizing_conf", "apply_conf", "ship_package", "small_batches",
           "shared_folder", "scratch", "sparing", "written", "written_in_parts"]
