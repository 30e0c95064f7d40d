"""Files of node trees as a stream: each new file's trees become rows once. Paths without positions run on it as they are."""

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import parse_column

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_node_stream(spark: SparkSession, path: str, form: str = "auto", files_a_trigger: int = 1000, **options) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_a_trigger).load(path)
    return parse_column(files, "path", "content", form, **options)
