"""Spark session helpers.

The library never creates global state except through these helpers. The
checkpoint directory is read from ``spark.checkpoint.dir``; a scratch folder
is only chosen when the setting is absent (local tests).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import weakref

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "reviewlens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system and is used as is.
    Only when it is unset (local runs, tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="reviewlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem API, so that a path without a
    scheme is one of the cluster's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder, through the Hadoop FileSystem API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


_LOCK = threading.Lock()
_DROPPING: dict = {}


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession):
    """Sets ``DROP_SHUFFLES`` as long as any thread writes such a table, and then as it was."""
    with _LOCK:
        writers, before = _DROPPING.get(spark, (0, spark.conf.get(DROP_SHUFFLES, None)))
        _DROPPING[spark] = writers + 1, before
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _LOCK:
            writers, before = _DROPPING.pop(spark)
            if writers > 1:
                _DROPPING[spark] = writers - 1, before
            elif before is None:
                spark.conf.unset(DROP_SHUFFLES)
            else:
                spark.conf.set(DROP_SHUFFLES, before)


#: frames that :func:`materialize` has written and nothing was added to
_TABLES: weakref.WeakSet = weakref.WeakSet()


def is_table(df) -> bool:
    """Whether ``df`` is a table as :func:`materialize` returned it, so that another copy would save nothing."""
    return df in _TABLES


#: drops the shuffled rows of a query when it ends
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, how: str = "table", drop_shuffles: bool = False):
    """Cut lineage before a multi-pass operator.

    ``table`` (default) writes the frame as parquet under the shared
    checkpoint folder and reads it back: later passes scan a columnar file
    (column pruning, filter pushdown), nothing is recomputed, and a lost
    executor costs only its own tasks. ``checkpoint`` uses the RDD
    checkpoint; ``persist`` keeps it in executor memory/disk (recomputed from
    lineage if lost). With ``drop_shuffles`` the rows that were shuffled for a
    table go from the disks when it is written, not when the driver happens to
    collect its garbage.
    """
    if how == "table":
        import uuid
        path = scratch_path(df.sparkSession, uuid.uuid4().hex)
        with _dropping_shuffles(df.sparkSession) if drop_shuffles else contextlib.nullcontext():
            df.write.mode("overwrite").parquet(path)
        remember(df.sparkSession, path)
        table = df.sparkSession.read.parquet(path)
        _TABLES.add(table)
        return table
    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``reviewlens`` importable in Python workers (pandas UDF paths).

    When the package is not installed on the executors, a zip of it is
    written under the shared checkpoint folder and added with ``addPyFile``,
    the standard ``--py-files`` mechanism. Done once per Spark context.
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for fn in sorted(files):
                if fn.endswith(".py"):
                    full = os.path.join(root, fn)
                    arc = os.path.relpath(full, os.path.dirname(pkg_dir))
                    z.write(full, arc)
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:12]
    ckpt = ensure_checkpoint_dir(spark)
    # shared storage of any kind: written through the Hadoop FileSystem API
    jvm = sc._jvm
    hp = jvm.org.apache.hadoop.fs.Path(ckpt.rstrip("/") + f"/pyfiles/reviewlens-{digest}.zip")
    fs = hp.getFileSystem(sc._jsc.hadoopConfiguration())
    hp = fs.makeQualified(hp)
    if not fs.exists(hp):
        out = fs.create(hp, True)
        out.write(bytearray(data))
        out.close()
    path = hp.toString()
    sc.addPyFile(path)
    _SHIPPED.add(key)


def materialize_observed(df, aggs: list):
    """Write ``df`` as a table (like :func:`materialize`) and compute the
    aggregate columns ``aggs`` in the same job (``Observation``), so a stats
    pass over the data is not needed. Returns (table, dict of metrics).

    Observed metrics are accumulated from successful tasks only, once per
    task, so retried tasks after an executor loss do not double count.
    """
    import uuid

    from pyspark.sql import Observation
    obs = Observation(f"rl_{uuid.uuid4().hex[:12]}")
    path = scratch_path(df.sparkSession, uuid.uuid4().hex)
    df.observe(obs, *aggs).write.mode("overwrite").parquet(path)
    remember(df.sparkSession, path)
    return df.sparkSession.read.parquet(path), obs.get


_SCRATCH: dict = {}


def remember(spark: SparkSession, path: str) -> None:
    """Register a scratch table, so that it can be freed."""
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    for scope in _innermost():
        scope.tables.append(path)


#: open scopes by thread, the innermost last
_SCOPES: dict = {}


def _innermost() -> list:
    """The scope that a table of this thread belongs to, if any: its own, else that of the
    main thread. Never that of another thread, which may run a step of its own beside it."""
    for thread in (threading.get_ident(), threading.main_thread().ident):
        if _SCOPES.get(thread):
            return [_SCOPES[thread][-1]]
    return []


class scratch_scope:
    """V5: frees the tables that were materialised inside it when it is left.

        with scratch_scope(spark) as scope:
            result = scope.keep(expensive(df))

    Tables that a kept frame still reads stay and pass to the scope around, so
    the last scope that keeps them decides; without one around they are left to
    :func:`drop_scratch_tables`. Also on an error, everything else is freed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: list = []

    def __enter__(self) -> "scratch_scope":
        self.tables: list = []
        self.thread = threading.get_ident()
        _SCOPES.setdefault(self.thread, []).append(self)
        return self

    def keep(self, df):
        self.kept.append(df)
        return df

    def __exit__(self, kind, error, trace) -> None:
        _SCOPES[self.thread].remove(self)
        read = [f for df in self.kept for f in df.inputFiles()] if kind is None else []
        stay = [p for p in self.tables if any(f"{_bare(p)}/" in _bare(f) for f in read)]
        gone = [p for p in self.tables if p not in stay]
        _delete(self.spark, gone)
        paths = _SCRATCH.get(self.spark.sparkContext.applicationId, [])
        for p in gone:
            if p in paths:
                paths.remove(p)
        for scope in _innermost():
            scope.tables.extend(stay)


def _bare(path: str) -> str:
    """A path without its scheme and repeated slashes."""
    import re
    return re.sub("/+", "/", path.split(":", 1)[-1] if "://" in path or path.startswith("file:") else path)


def drop_scratch_tables(spark: SparkSession) -> int:
    """Delete the tables this application materialised (Hadoop FS API).

    Call only when no DataFrame that reads them is used any more; nothing in
    the library calls it implicitly. Returns the number of tables removed.
    """
    return _delete(spark, _SCRATCH.pop(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if fs.exists(hp):
            fs.delete(hp, True)
            removed += 1
    return removed
