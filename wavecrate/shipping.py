"""Getting this package to the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Smaller batches than Spark's own between the engine and Python: long texts make large rows. Values that a session sets itself stay.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once an application; needed before a Python function of it runs there."""
    for key, (usual, ours) in BATCHES.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="wavecrate-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "wavecrate.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
