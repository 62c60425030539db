"""Genotype variation and training-data operators on Spark DataFrames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of a session, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_alleloom_shipped", False):
        return
    here = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="alleloom-")) / "alleloom_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("alleloom") / p.relative_to(here))
    sc.addPyFile(str(to))
    sc._alleloom_shipped = True
