"""The package for workers that do not have it installed."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession, folder: str) -> str:
    """Puts the package's sources as a zip file into ``folder`` and adds it to the session, so that Python workers on other machines, or started
    in another folder, can import it. Where the package is installed on every node this is not needed."""
    home = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    out = Path(folder) / f"{home.name}.zip"
    out.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(out))
    return str(out)
