"""Session helpers: tables by name, and this package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: What a Python worker gets at once.
BATCH_BYTES = 4 << 20
_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Puts this package on the import path of the session's workers, once for each Spark context, and bounds their batches."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))  # long texts: fewer rows a batch
    if getattr(sc, "_folioquarry_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="folioquarry-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "folioquarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_HERE.rglob("*.py")):
            z.write(p, str(p.relative_to(_HERE.parent)))
    sc.addPyFile(path)  # the driver serves it to the executors
    sc._folioquarry_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
