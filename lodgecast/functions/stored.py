"""Tables that cut a plan in two: written to the shared folder and read back, so that no later pass computes them again."""

import uuid

from pyspark.sql import DataFrame

from lodgecast.session import shared_folder


def stored(frame: DataFrame, name: str, **options) -> DataFrame:
    """Write once and read back; a lost executor costs the tasks it ran, and the reader knows the table's size.

    ``options`` are the writer's.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
