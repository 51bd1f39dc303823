"""Helpers shared by the training-data operators: input, durable intermediates, text expressions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests) a temporary folder is made; on a
    cluster without the setting the warehouse, which is shared by contract, is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    made = getattr(spark, "_plumbline_dir", None)
    if made is None:
        made = spark._plumbline_dir = tempfile.mkdtemp(prefix="plumbline-")
    return made


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the shared folder is cleaned by its owner
        pass


def durable(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    It cuts lineage like ``checkpoint()``, but columnar and compressed; a lost executor costs
    only the tasks that were running. With ``by`` the files lie in a folder for each of its values, which
    a filter on it prunes. The files go with ``release`` or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    atexit.register(delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*stored: DataFrame) -> None:
    """Deletes tables made by ``durable`` that nothing will read again."""
    for df in stored:
        delete(df.sparkSession, df.stored_at)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def id_hash(col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text; 0 for a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0))


def words(text: Column) -> Column:
    """Words of the contracts as an array; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
