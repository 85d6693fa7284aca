"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_NAME = "siftwood_package.zip"


def ship_package(spark) -> None:
    """Send the package's sources along with the application, once; executors need no copy of the repository."""
    sc = spark.sparkContext
    if _NAME in {os.path.basename(p) for p in sc._python_includes}:
        return
    root = Path(__file__).resolve().parent
    # the driver serves the file from where it lies, so it must live as long as the application
    path = os.path.join(sc._temp_dir or tempfile.mkdtemp(), _NAME)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
