"""Send this package's source to the Python workers, which may not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SENT: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package as a zip to the session's Python files, once per application.

    The zip is made in the driver's temporary folder; Spark sends it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    target = Path(tempfile.mkdtemp(prefix="wayfare-code-")) / "wayfare.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
