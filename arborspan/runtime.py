"""What the library asks of a Spark session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once for each application, so that
    functions which run in Python workers can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="package-")  # the driver's own: executors fetch the file from it
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
