"""Session construction and lineage cutting.

On a cluster the session is supplied by the caller and ``spark.checkpoint.dir``
points at shared storage; we only ever *read* that setting.  A scratch folder
is created solely when nothing is configured and the master is local (local
runs and tests); a cluster without the setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
}


def get_session(master: str | None = None, app_name: str = "terrapanel",
                extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
    conf = dict(_DEFAULT_CONF)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_SCRATCH: dict = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` (or a directory already registered on the
    SparkContext) wins; only when neither exists – local tests – a fresh
    scratch folder is created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:            # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else "remote"
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = _LOCAL_SCRATCH.get("dir") or tempfile.mkdtemp(prefix="terrapanel-ckpt-")
        _LOCAL_SCRATCH["dir"] = configured
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def materialize(df: DataFrame, partition_by: tuple | list | None = None) -> DataFrame:
    """Cut lineage with a table written once to the shared checkpoint folder.

    Used where a later step must see *exactly* the same rows twice (e.g. ids
    assigned by position), where several global jobs would otherwise each
    recompute the upstream plan, and where recomputation after an executor
    loss must not change results.  A Parquet table (rather than an RDD
    checkpoint, which computes its input twice) is written in one job and
    read back with column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


_STAGES: dict = {}


def application_id(spark: SparkSession) -> str | None:
    """Identity of the running application; None where the client cannot know it."""
    try:
        return spark.sparkContext.applicationId
    except Exception:            # Spark Connect
        return None


def file_state(df: DataFrame) -> tuple | None:
    """(path, length, modification time) of every file in the folders that
    ``df`` reads, listed now, each folder once; None for a plan without files."""
    paths = df.inputFiles()
    if not paths:
        return None
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    state = []
    for folder in sorted({p.rsplit("/", 1)[0] for p in paths}):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for f in path.getFileSystem(conf).listStatus(path):
            state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(state))


def reuse_stage(name: str, source: DataFrame, params: tuple, build):
    """Build a derived stage once per application and return the same result
    for a semantically equal input over unchanged files, the way a pipeline
    persists a stage table once and later steps read it.  The key holds the
    application and the listing (length and modification time) of the input's
    folders, so appended or rewritten files and a restarted session build
    anew; a plan without files is never remembered."""
    app = application_id(source.sparkSession)
    files = file_state(source) if app is not None else None
    if files is None:
        return build()
    for old in [k for k in _STAGES if k[0] != app]:
        del _STAGES[old]         # plans of an ended session cannot run any more
    key = (app, name, source.semanticHash(), params, files)
    hit = _STAGES.get(key)
    if hit is not None and hit[0].sameSemantics(source):
        return hit[1]
    out = build()
    _STAGES[key] = (source, out)
    return out
