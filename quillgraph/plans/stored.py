"""Tables that several queries share, built once for each application and kept in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans.shared import fresh_path

_places: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table ``name`` over the tables in ``folder``: written at its first use, read from then on.

    ``by``: a column that its files are ordered by, range by range, so that a filter on it reads little. The tables
    in ``folder`` are taken not to change while the application runs."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _places:
        path = fresh_path(spark, f"stored-{name}")
        df = build()
        if by is not None:
            df = df.repartitionByRange(by).sortWithinPartitions(by)
        df.write.parquet(path)
        _places[key] = path
    return spark.read.parquet(_places[key])
