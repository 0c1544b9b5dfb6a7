"""Makes this package known to Python workers where they would not find it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules with the application, unless workers find them by PYTHONPATH or the working folder."""
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if Path.cwd() == ROOT or any(Path(p).resolve() == ROOT for p in known) or spark.sparkContext.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="foliary-")).resolve() / "foliary.zip"
    with zipfile.ZipFile(path, "w") as z:
        for module in sorted((ROOT / "foliary").rglob("*.py")):
            z.write(module, module.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(spark.sparkContext.applicationId)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
