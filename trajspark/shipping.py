"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless the path that they inherit has it; once per Spark context."""
    context = spark.sparkContext
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in inherited or getattr(context, "_trajspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "trajspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "trajspark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._trajspark_shipped = True
