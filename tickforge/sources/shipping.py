"""Getting this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application, add the package's files to those Spark serves to its executors.

    Left out where PYTHONPATH already names the folder, as workers inherit it.
    """
    root = str(_PACKAGE.parent)
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="tickforge-code-")) / "tickforge.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(_PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
