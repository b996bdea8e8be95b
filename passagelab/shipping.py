"""Makes the package importable on the executors."""

from __future__ import annotations

import functools
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    target = Path(tempfile.mkdtemp(prefix="passagelab-")) / f"{top.name}.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shipped(query):
    """The query, with the package shipped before it is planned."""

    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
