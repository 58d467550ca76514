"""Sending this package to the executors, for operators that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tallyhouse

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Serve the package's code to the Python workers, once per application, as `--py-files` would."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(tallyhouse.__file__).parent
        target = Path(tempfile.mkdtemp(prefix="tallyhouse-code-")) / "tallyhouse_code.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(target))
        _sent.add(context.applicationId)
    return spark
