"""A Python data source over a service that is asked per region and period.

``fetch(region, start, end)`` returns a dict of parallel arrays with a ``time``
array, as column-oriented weather services do. It is given by name
(``package.module:function``), so tests and offline runs name a local one.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Region(InputPartition):
    def __init__(self, region: str):
        self.region = region


class PollReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Region(r) for r in self.options["regions"].split(",") if r]

    def read(self, partition: Region) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        metrics = [m for m in self.options.get("metrics", "precipitation_sum").split(",") if m]
        try:
            got = fetch(partition.region, self.options.get("start"), self.options.get("end"))
        except Exception as e:  # one region's failure is a row of its own, the others go on
            yield partition.region, None, None, None, f"{type(e).__name__}: {e}"
            return
        for metric in got if metrics == ["*"] else metrics:
            if metric != "time":
                for day, value in zip(got.get("time", ()), got.get(metric, ())):
                    yield partition.region, day, metric, None if value is None else str(value), None


class PollSource(DataSource):
    """Format ``poll``: options regions and metrics (comma separated; ``*`` for all), fetch, start, end. Values are texts, as sunrise isn't a number."""

    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return "region string, day string, metric string, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PollReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(PollSource)
