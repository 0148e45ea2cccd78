"""Relation synthesis on Spark: profile, clean, match, stitch and normalise many small tables."""

from __future__ import annotations


def ship(spark) -> None:
    """Sends the package to executors on which it is not installed."""
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)  # Spark copies it from the driver
    spark.sparkContext.addPyFile(archive)
