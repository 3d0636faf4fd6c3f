"""Loading matrix-shaped input: CSV, TSV, Parquet, NPY, NPZ, and data in memory."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix

_FORMATS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "txt": "tsv", "parquet": "parquet", "pq": "parquet", "npy": "npy", "npz": "npz"}


def format_of(path: str, input_format: str = "auto") -> str:
    name = (path.rsplit(".", 1)[-1] if input_format == "auto" else input_format).lower().lstrip(".")
    if name not in _FORMATS or (input_format == "auto" and "." not in path):
        raise ValueError(f"unsupported input format: {name}")
    return _FORMATS[name]


def array_frame(spark: SparkSession, array: np.ndarray) -> DataFrame:
    if array.ndim != 2:
        raise ValueError("arrays must have two dimensions")
    return spark.createDataFrame(pd.DataFrame(array, columns=[f"feature_{i}" for i in range(array.shape[1])]))


def load(spark: SparkSession, path: str, input_format: str = "auto") -> DataFrame:
    """A table by its suffix or a stated format; a byte-order mark in front of the first header is dropped."""
    kind = format_of(path, input_format)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        df = spark.read.csv(path, header=True, inferSchema=True, sep="," if kind == "csv" else "\t")
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    content = spark.read.format("binaryFile").load(path).select("content").first()
    held = np.load(io.BytesIO(bytes(content[0])), allow_pickle=False)
    if kind == "npz":
        if not held.files:
            raise ValueError("the archive holds no array")
        held = held[held.files[0]]
    return array_frame(spark, held)


def as_frame(spark: SparkSession, data) -> DataFrame:
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    if isinstance(data, np.ndarray):
        return array_frame(spark, data)
    raise TypeError(f"cannot load {type(data).__name__}")


def prune_cache(files: DataFrame, now, ttl_seconds: float, max_bytes: int) -> DataFrame:
    """files (path, bytes, modified): those to keep: not expired, and the newest up to the size limit."""
    fresh = files.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("modified") <= ttl_seconds)
    rows, bucket = matrix.order_bucket(fresh, "modified")
    return matrix.running(rows, -bucket, [F.desc("modified"), F.col("path")], F.col("bytes"), "held").where(F.col("held") <= max_bytes)
