"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application; nothing where PYTHONPATH holds it already.

    The archive is served by the driver (``addPyFile``), so executors that join later get it as well.
    """
    root = Path(__file__).resolve().parent
    home = str(root.parent)
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="pagemill-")
    path = os.path.join(folder, "pagemill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
