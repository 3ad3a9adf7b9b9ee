"""Tables and documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; what is written there goes when the application ends."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="fieldtrace-"))
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(jvm_path)  # only what exists is marked to go
    fs.deleteOnExit(jvm_path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the cluster's shared folder and read from there; it goes when the application ends."""
    path = shared_path(df.sparkSession, f"stage-{name}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_table(spark: SparkSession, path: str, schema: str, fallback: list[tuple]) -> DataFrame:
    """A JSON file of an array of rows; the fallback where there is none."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame(fallback, schema)


def updated(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`table` with the columns of `new` taken where they are not null: an update that keeps old values."""
    columns = [c for c in new.columns if c != key]
    named = new.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    return table.join(named, F.col(key) == F.col("_key"), "left").select(*(F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def pdf_text(df: DataFrame, content: str = "content") -> DataFrame:
    """`df` with `text` from PDF files, empty where no reader is installed or the file cannot be read."""

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            import pdfplumber
        except ImportError:
            pdfplumber = None
        import io

        def one(raw) -> str:
            if pdfplumber is None or raw is None:
                return ""
            try:
                with pdfplumber.open(io.BytesIO(raw)) as pdf:
                    return "\n".join(p.extract_text() or "" for p in pdf.pages)
            except Exception:  # a file that no reader understands has no text
                return ""

        for s in pages:
            yield s.map(one)

    return df.withColumn("text", text(content))
