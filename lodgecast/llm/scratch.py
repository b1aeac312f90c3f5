"""Tables that cut a plan in two: written to the cluster's shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lodgecast.session import shared_folder


def written(frame: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write once to ``spark.checkpoint.dir`` and read back; lost executors cost only the tasks they ran.

    ``folders``: columns whose values get a folder each, so that a filter on them reads no other files.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    frame.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
