"""Puts this package on the executors' path, so that tasks can import it however the driver found it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

import weblode

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session as a Python file, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = os.path.dirname(os.path.abspath(weblode.__file__))
    folder = tempfile.mkdtemp(prefix="weblode-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _DONE.add(app)
