"""Session helpers: confs the engine needs, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings for sessions that the library makes itself; operators that need one set it where they use it.
REQUIRED = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session and make the package importable on executors."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so Python functions need no install there."""
    context = spark.sparkContext
    if getattr(context, "_lamina_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lamina-")) / "lamina.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path("lamina") / path.relative_to(root))
    context.addPyFile(str(target))
    context._lamina_shipped = True


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A configured local session, for tests and the command line."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lamina")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", "4g")
    return configure(builder.getOrCreate())
