"""Tables in the shared folder that cut lineage, and shipping this package to executors.

The folder is that of ``spark.checkpoint.dir``; only where it is unset (as in tests) a temporary folder is set.
Tables are written by Spark's own writer, so any file system that Spark reads will do, and a lost executor
costs only the tasks that it ran.
"""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spanwood-")
        atexit.register(shutil.rmtree, folder, True)
        folder = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str = "part", compression: str = "zstd") -> DataFrame:
    """df, written to a new table in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spanwood/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it anyway."""
    top = os.path.realpath(os.path.join(os.path.dirname(__file__), "..", ".."))
    known = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if top in known or spark.conf.get("spark.spanwood.shipped", None):
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/spanwood", "zip", top, "spanwood"))
    spark.conf.set("spark.spanwood.shipped", "true")
