"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application.

    Nothing is sent where ``PYTHONPATH`` names the package's folder already.
    """
    root = Path(__file__).resolve().parents[2]
    named = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if root in named or app in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="lodestone-code-")) / "lodestone.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted((root / "lodestone").rglob("*.py")):
            out.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
