"""Makes the package importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in known or getattr(sc, "_tidepool_shipped", False):
        return
    sc._tidepool_shipped = True
    if sc.master.startswith("local[") or sc.master == "local":
        old = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), old) if x)
        return
    at = Path(tempfile.mkdtemp()) / "tidepool.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in (ROOT / "tidepool").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(at))
