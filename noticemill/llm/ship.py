"""Sends the library's modules along with a job, for clusters whose machines do not have them."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

import noticemill

_sent: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in the session's Python workers; once per application. Workers
    then import it as any module, so what a module remembers lasts from task to task."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = pathlib.Path(noticemill.__file__).parent
        # the driver serves the file from this place for as long as the application runs
        folder = tempfile.TemporaryDirectory()
        _sent[context.applicationId] = folder
        path = f"{folder.name}/{root.name}-modules.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(path)
    return spark
