"""What the training-data operators share: shipping, scratch space, guarded joins."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from meterfold.scratch import materialised, scratch

__all__ = ["dim_join", "is_small", "materialised", "scratch", "ship", "table", "text_or_empty"]

#: Rows up to which a table of a few narrow columns is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Salts of a shuffle join whose many-side may have a hot key.
SALTS = 16

#: Rows and bytes of one Arrow batch, where the session hasn't got smaller ones: they bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application, and bound the session's Arrow batches."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}", str(most + 1)).rstrip("bB")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="meterfold-")) / "meterfold_ship.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> bool:
    """Whether df, cheap to read, has at most so many rows; weight: what a row counts, for rows of no fixed size."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0)).alias("w")).first()
    return seen.n <= rows and seen.w <= 10 * rows


def dim_join(df: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", weight: Column | None = None) -> DataFrame:
    """Join df with a table that has each key once: broadcast if it is small, else by shuffle with df's keys salted.

    The salt spreads a key that holds a large part of df's rows over SALTS tasks; dim, one row a key, is repeated
    as often. Null keys match nothing.
    """
    if is_small(dim, weight=weight):
        return df.join(F.broadcast(dim), keys, how)
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_numbers(df: DataFrame, key: str) -> None:
    """Raise for keys that aren't whole numbers: as such they'd become null."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be a column of whole numbers")
