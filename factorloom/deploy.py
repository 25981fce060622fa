"""Makes the package known to Python workers of executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once per application, unless PYTHONPATH, which executors inherit, has it already."""
    root = Path(__file__).resolve().parent
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root.parent in paths or app in _shipped:
        return
    name = Path(tempfile.mkdtemp(prefix="factorloom-")) / "factorloom.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(name))
    _shipped.add(app)
