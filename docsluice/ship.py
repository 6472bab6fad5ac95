"""Python workers must be able to import this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a session, unless their path has it anyway."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _DONE or root in path or Path.cwd() == root:
        return
    folder = tempfile.mkdtemp(prefix="docsluice-package-")  # the driver serves the file while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = Path(folder, "package")
    shutil.copytree(root / "docsluice", copy / "docsluice", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, f"docsluice-{context.applicationId}")), "zip", copy))
    _DONE.add(context.applicationId)
