"""Reading tables and splitting words: what every operator here shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import BROADCAST_BYTES, ROW_BYTES, discard, fit, settle

__all__ = ["BROADCAST_BYTES", "ROW_BYTES", "SPACE", "discard", "fit", "settle", "table", "words_col", "words_of"]

#: Fixed by the contracts: words are runs of anything but these six characters.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() breaks at exactly the six ASCII spaces of SPACE."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def words_col(col: str) -> F.Column:
    """The same words as an array column; null text has none."""
    return F.filter(F.split(F.coalesce(F.col(col), F.lit("")), SPACE), lambda w: w != "")
