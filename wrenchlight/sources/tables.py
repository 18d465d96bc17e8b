"""Tables by name, read when first asked for."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wrenchlight.operators.joins import merged_hot_keys
from wrenchlight.schemas import ARRIVED, TABLES, conform, empty, with_arrival


class Tables:
    """``tables["jobs"]``: conformed frames from any loader.

    The loader returns None for a table that does not exist, which then reads as empty.
    """

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame | None], sketches: Callable[[str], DataFrame | None] | None = None):
        self.spark = spark
        self._load = load
        self._sketches = sketches
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> Tables:
        return cls(spark, frames.get)

    @classmethod
    def in_folder(cls, spark: SparkSession, root: str) -> Tables:
        """Parquet folders ``root/<table>``."""
        return cls(spark, lambda name: read_parquet_if_present(spark, f"{root}/{name}"))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name not in self._frames:
            frame = self._load(name)
            self._frames[name] = empty(self.spark, name) if frame is None else conform(frame, name).drop(ARRIVED)
        return self._frames[name]

    def stored(self, name: str) -> DataFrame:
        """The table with the arrival of each row, as upserts need it."""
        frame = self._load(name)
        return with_arrival(empty(self.spark, name) if frame is None else conform(frame, name))

    def hot_parents(self, name: str) -> DataFrame | None:
        """(hot_key): the frequent parents of a child table, from the sketches kept with it; None if there are none."""
        found = self._sketches(name) if self._sketches else None
        return None if found is None else merged_hot_keys(found)

    def exists(self, name: str) -> bool:
        return self._load(name) is not None


def read_parquet_if_present(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame | None:
    """Parquet files below ``path``, None if there are none.

    With a schema no footer is read up front, and columns that older files lack
    come back as NULL.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
