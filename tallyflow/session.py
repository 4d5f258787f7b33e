"""Giving executors the package."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code once a context, so workers can import it wherever the driver runs from."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyflow_code", None) is None:
        top = Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"{top.name}/{f.relative_to(top)}")
        target = Path(tempfile.mkdtemp(prefix="tallyflow-code-")) / "tallyflow_package.zip"
        target.write_bytes(held.getvalue())
        sc.addPyFile(str(target))
        sc._tallyflow_code = str(target)
    return spark
