"""Cutting the plans of flows that read one intermediate result many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder where one is named, else cached.

    Either way a lost executor costs no more than computing its part again.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return df.cache()
    path = f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
