"""Write-ahead logs as a batch source: spark.read.format("tideline_wal").load(path)."""

from __future__ import annotations

import glob
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tideline.session import ship
from tideline.sources.wal import read_file

SCHEMA = "key string, seq bigint, op tinyint, value string, file string"


class LogFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("mode", "recover") == "strict"

    def partitions(self):
        paths = sorted(glob.glob(os.path.join(self.path, "*.log"))) if os.path.isdir(self.path) else [self.path]
        return [LogFile(p) for p in paths]

    def read(self, partition):
        records, _ = read_file(partition.path, strict=self.strict)
        for seq, r in enumerate(records):
            yield r.key, seq, r.op, r.value, partition.path


class LogDataSource(DataSource):
    """Option mode: recover (a torn tail is left out) or strict (it raises)."""

    @classmethod
    def name(cls):
        return "tideline_wal"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LogDataSource)
