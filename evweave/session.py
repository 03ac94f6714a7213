"""Session construction, the shared checkpoint folder and stored tables.

On a cluster the session is handed to us with ``spark.checkpoint.dir`` set to a
shared folder; we read it from there. Only when it is unset on a local master
(tests) do we create a scratch folder of our own; on any other master that is
an error, as other machines could not see such a folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "evweave") -> SparkSession:
    """Build (or reuse) a session tuned for the event workloads.

    AQE is on so that shuffle partitions coalesce at small scale and skewed
    partitions split at large scale. Joins with data-sized sides are plain
    equi-joins (AQE may still broadcast a side it measures small); the library
    broadcasts explicitly only after counting a stored small table.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor, its heap the only memory knob
        b = b.config("spark.driver.memory", os.environ.get("EVWEAVE_DRIVER_MEMORY", "4g"))
    spark = b.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder. When the session names
    none, a local master gets a scratch folder; any other master raises."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        master = spark.conf.get("spark.master", "")
        if sc is not None and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        d = tempfile.mkdtemp(prefix="evweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() if sc is not None else None) or d


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None for remote sessions, where
    the server's ``spark.checkpoint.dir`` applies)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 — remote sessions have no local context
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, *partition_by: str):
    """Store ``df`` once as Parquet in the shared checkpoint folder and return
    the stored table. It cuts the lineage (a lost executor costs no recomputation
    of it), and later scans keep column pruning, pushed filters and, with
    ``partition_by``, partition pruning. ``release`` deletes the files."""
    path = scratch_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    if _SCRATCHES:
        _SCRATCHES[-1].paths.append(path)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def release(*tables) -> None:
    """Delete the files of tables made by :func:`materialize` (nothing else: the
    folder must be a ``stored-*`` folder of the shared checkpoint folder)."""
    for df in tables:
        folders = {f.rsplit("/stored-", 1)[0] + "/stored-" + f.rsplit("/stored-", 1)[1].split("/")[0]
                   for f in df.inputFiles() if "/stored-" in f}
        for folder in folders:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    sc = _context(spark)
    base = ensure_checkpoint_dir(spark).rstrip("/").split("://")[-1].split("file:")[-1]
    if sc is not None and "/stored-" in folder and base.lstrip("/") in folder:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_SCRATCHES: list = []


class scratch:
    """``with scratch(spark) as s``: every table that the library stores inside the block is deleted at its
    end, but for those given to ``s.keep``. For jobs whose result is written, or stored
    and kept, before the block ends; a lazy result that still reads a deleted table fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def keep(self, df):
        """Leave the stored tables that ``df`` reads alone; returns ``df``."""
        self.kept += [*df.inputFiles(), f"{getattr(df, '_stored_at', '')}/"]
        return df

    def __enter__(self):
        _SCRATCHES.append(self)
        return self

    def __exit__(self, *error) -> None:
        _SCRATCHES.remove(self)
        for path in self.paths:
            name = path.rsplit("/", 1)[1]
            if any(f"/{name}/" in f for f in self.kept):
                if _SCRATCHES:  # an outer block may still delete it
                    _SCRATCHES[-1].paths.append(path)
            else:
                _delete(self.spark, path)
