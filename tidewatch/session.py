"""What the engine needs of a session that it is given."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python workers' path, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    to = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    to.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one on one machine (tests), and a ValueError on a cluster."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if held.isEmpty():
        if not configured and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(configured or f"file://{tempfile.mkdtemp(prefix='tidewatch-')}")
        held = context._jsc.sc().getCheckpointDir()
    return (configured or held.get()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared one, which goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    atexit.register(lambda: spark.sparkContext._jsc is not None and store.delete(path, True))
    return store.makeQualified(path).toString()
