"""Shared folder, written tables and small column helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; on a cluster that would be a folder
    of one machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="revlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what stands before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/revlake/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(df: DataFrame) -> list[Column]:
    """The columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Rows that a cell has on average, at most.
CELL_ROWS = 20_000


def cell_digits(rows: int) -> int:
    """So many hexadecimal digits of a digest name cells of at most CELL_ROWS of so many rows on average."""
    digits = 0
    while rows > CELL_ROWS * 16**digits:
        digits += 1
    return digits


def order_digest(doc_id: str, text_digest: str) -> Column:
    """Hexadecimal digest that puts rows in an order of their own; only rows of equal id and text are alike in it."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("n")), F.col(text_digest)).cast("binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column | str) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))
