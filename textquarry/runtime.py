"""The package on the workers, and intermediate tables that all executors can read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the session's workers, once for an application, so that they need not find it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="textquarry-ship-"))
    atexit.register(shutil.rmtree, folder, True)
    root = Path(__file__).parent
    with zipfile.ZipFile(folder / "textquarry.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"textquarry/{file.relative_to(root)}")
    context.addPyFile(str(folder / "textquarry.zip"))
    _shipped.add(context.applicationId)


#: Rows of an Arrow batch, which a worker holds whole.
ARROW_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows, in the session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


class Scratch:
    """Intermediate tables in the folder that all executors share.

    ``spark.checkpoint.dir`` names that folder; where it is unset a temporary folder is made and
    removed at exit, on one machine only: on a cluster executors would not see each other's. A
    saved table cuts the lineage: a lost executor costs a re-read, never a recomputation of what
    lies before. Tables last until ``drop`` or ``clean``, since results are read from them later.
    """

    _own: str | None = None
    _bases: list[tuple[str, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            if Scratch._own is None:
                Scratch._own = tempfile.mkdtemp(prefix="textquarry-")
                atexit.register(shutil.rmtree, Scratch._own, True)
            base = f"file://{Scratch._own}"
        self.base = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        Scratch._bases.append((spark.sparkContext.applicationId, self.base))
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write df and return the table as read back."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        _delete(self.spark, df._scratch_path)

    def forget(self, name: str) -> None:
        """Delete what a caller wrote below this folder under a name of its own."""
        _delete(self.spark, f"{self.base}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it when the results that come from them are written."""
    own = [base for app, base in Scratch._bases if app == spark.sparkContext.applicationId]
    Scratch._bases[:] = [b for b in Scratch._bases if b[1] not in own]
    for base in own:
        _delete(spark, base)
