"""What a session needs before it runs this package's queries."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_weblens_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="weblens-")
    path = os.path.join(folder, "weblens_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, str(Path(PACKAGE.name) / file.relative_to(PACKAGE)))
    context.addPyFile(path)
    context._weblens_shipped = True
