"""Making the package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, so that jobs run from any folder."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = Path(__file__).resolve().parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="cloakframe-")) / "cloakframe_package"), "zip", home.parent, home.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
