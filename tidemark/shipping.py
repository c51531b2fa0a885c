"""Python workers get this package from the driver, so it need not be installed on them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the driver's file server hands out the package's sources."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_sources.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, f"tidemark/{source.relative_to(package)}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
