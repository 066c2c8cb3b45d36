"""Sessions, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "quillspark", cores: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings the library is tested with."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package's code, once a context, so that workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        name = os.path.join(tempfile.mkdtemp(prefix="quillspark-code-"), "quillspark_code.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"quillspark/{p.relative_to(top)}")
        context.addPyFile(name)
        _shipped.add(context.applicationId)
    return spark
