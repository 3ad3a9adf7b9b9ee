"""What the operators share: reading tables, cutting lineage in shared storage, and the word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as it stands inside a Java character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where the session names none (tests, local mode)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        there = "file://" + tempfile.mkdtemp(prefix="fieldtrace-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


class Saved:
    """A table written to the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, compression: str = "zstd"):
        self.spark = df.sparkSession
        self.path = new_dir(self.spark, name)
        self.schema = df.schema
        df.write.mode("overwrite").option("compression", compression).parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove_dir(self.spark, self.path)


class Scratch:
    """Tables of one computation, dropped together once its result is saved."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[Saved] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(Saved(df, name))
        return self.tables[-1].df

    def drop(self) -> None:
        for t in self.tables:
            t.drop()
        self.tables.clear()
        # Spark removes the shuffle files of finished jobs when the driver's collector finds nothing that needs them.
        self.spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores where the frame has such a column already."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def hash128(*cols: Column) -> Column:
    """Two independently seeded 64-bit hashes as a struct: equal inputs, and for practical purposes only those, agree."""
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


#: Tasks among which the rows of one key are spread where they meet what is known of the key.
SPREAD = 32


def spread_of(*cols: Column) -> Column:
    """Which of the SPREAD shares of its key a row lies in."""
    return F.pmod(F.xxhash64(*cols), F.lit(SPREAD)).cast("int")


def spreads(share: Column) -> Column:
    """Aggregate: the shares that occur, as bits; one number for each key and task before the shuffle."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), share))


def each_spread(df: DataFrame, bits: str, share: str) -> DataFrame:
    """A row of `df` for each share that occurs, in column `share`: a join on key and share splits a hot key's rows."""
    there = F.filter(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.call_function("shiftright", F.col(bits), i).bitwiseAND(F.lit(1)) == 1)
    return df.withColumn(share, F.explode(there)).drop(bits)
