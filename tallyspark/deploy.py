"""Sends this package to Python workers that wouldn't find it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once. Only where workers run on this machine is it left out if they start
    where the package is, or with a path to it."""
    context = spark.sparkContext
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    here = context.master.startswith("local") and any(Path(p).resolve() == ROOT for p in places if p)
    if getattr(context, "_has_tallyspark", False) or here:
        return
    path = f"{tempfile.mkdtemp()}/tallyspark.zip"  # read by the driver alone, which sends it to all executors
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((ROOT / "tallyspark").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(path)
    context._has_tallyspark = True
