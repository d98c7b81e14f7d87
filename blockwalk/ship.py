"""Making the package importable in Python workers on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send the package to the executors once per application (``addPyFile``)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "blockwalk.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("blockwalk", os.path.relpath(path, root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
