"""Session helpers. Library code never builds a session; tests and the bench do, through here."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Folders of local-mode sessions that have no shared folder, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(app: str = "tallybook", cores: str | int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # Call-site capture costs several driver round trips per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Generated methods beyond this size are never compiled by the JVM's JIT.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder of the cluster.

    Only a local-mode session may go without ``spark.checkpoint.dir``; it then gets a fresh
    temporary folder. On a cluster a missing setting is an error, since executors could not
    read each other's machine-local files.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        name = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.get(name) or _LOCAL_ROOTS.setdefault(name, tempfile.mkdtemp(prefix="tallybook-"))
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
