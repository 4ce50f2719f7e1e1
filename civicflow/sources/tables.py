"""Reading inputs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.sources.manifest import published_path


@dataclass(frozen=True)
class DatasetRef:
    """A dataset and one of its versions, such as ``latest`` or ``2019/09/17``."""

    name: str
    version: str = "latest"

    @classmethod
    def parse(cls, text: str) -> "DatasetRef":
        """Read ``name.version`` or ``name."2019/09/17"``."""
        name, _, version = text.partition(".")
        return cls(name, version.strip('"') or "latest")

    def path(self, base: str) -> str:
        """Folder of this version; a slash in the version is not a sub-folder."""
        return f"{base.rstrip('/')}/{self.name}/{self.version.replace('/', '__')}"


def read_versioned(spark: SparkSession, ref: DatasetRef | str, base: str | None = None) -> DataFrame:
    """Scan one version of a dataset.

    Without a base folder the version is a table of the session's catalog, in
    the schema named after the dataset.  With one, it is what the manifests name,
    or else the folder of the version.  Filters and selections made on the
    result reach the Parquet scan (S2, S3).
    """
    ref = DatasetRef.parse(ref) if isinstance(ref, str) else ref
    if base is None:
        return spark.table(f"`{ref.name}`.`{ref.version.replace('/', '__')}`")
    return spark.read.parquet(published_path(spark, ref.name, ref.version, base) or ref.path(base))


def read_csv_text(
    spark: SparkSession, path: str, columns: list[str] | None = None, line: str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header, every column as text.

    Giving the columns saves the pass that reads the header.  Quoted fields may
    hold doubled quotes, and with ``multi_line`` line breaks; each file is then
    one task, while otherwise files are split.  ``line`` names a column to add
    that grows with the files by name and with the lines of each, for
    corrections of which the last one wins.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    rows = reader.csv(path)
    if line is None:
        return rows
    # Ids grow within a piece of a file; pieces are ordered by their place.
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return rows.select("*", F.struct(*[c.alias(f"p{i}") for i, c in enumerate(place)]).alias(line))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; spaces at the ends of values stay."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").option("header", True).option("escape", '"').options(**spaces).csv(path)


def select_renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, under new names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


class Staging:
    """A folder for intermediate results, removed as a whole at the end.

    It lies under a folder that every executor can reach, such as that of the
    outputs, so a lost executor costs no recomputation.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.path = f"{base.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write a frame and read it back; the readers still prune columns."""
        df.write.parquet(f"{self.path}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{label}")

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *error: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
