"""Helpers that every training-data operator shares."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.sources.shared import written as materialise  # noqa: F401

#: Input files that are numbered at most; rows of more are written with their numbers instead.
MOST_FILES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a unique number of each row that stays the same in every use; ids may repeat or be null.

    A row of a Parquet table is told by its file's number and its place in the file, which costs no
    copy of the table. Rows from elsewhere, and of more files than MOST_FILES, are written first.
    """
    try:
        files = [r[0] for r in docs.select(F.col("_metadata.file_path")).distinct().limit(MOST_FILES + 1).collect()]
        place = docs.select("*", F.col("_metadata.file_path").alias("_skylark_file"), F.col("_metadata.row_index").alias("_skylark_index"))
    except AnalysisException:
        files = []
    if not 0 < len(files) <= MOST_FILES:
        return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    known = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(sorted(files))], "_skylark_file string, _skylark_number long")
    row = F.shiftleft(F.col("_skylark_number"), 40) + F.col("_skylark_index")
    return place.join(F.broadcast(known), "_skylark_file").select(*docs.columns, row.alias(name))


def bucket_of(n: int, *cols: str):
    """A stable bucket number 0..n-1 from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(max(1, n))).cast("int")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows out evenly by a hash of a row key, so that Python work follows no input file's size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(c) for c in cols])
