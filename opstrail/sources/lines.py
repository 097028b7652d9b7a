"""Text between separators as a data source: ``spark.read.format("opstrail_lines")``.

Partitions are byte ranges of files, planned when the query is; no Spark job runs before
it does. What a file holds is told in the task by its first two bytes: plain files
are read range by range, gzip files are streamed by one task. A file that cannot be
read, at whatever time, is a row with ``scan_error``.

Options: ``path`` (or ``paths``, a JSON list), ``separator``, ``recursive``, ``pattern`` (on
names below a folder), ``split`` and ``cost`` in bytes, and ``first``: a pattern after whose first
match a file is left. Such files are read by one task each, from their start.
"""

from __future__ import annotations

import json
import re
import sys

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from opstrail import tasks
from opstrail.functions.paths import glob_to_regex

# Readers travel to executors whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "file string, block_start bigint, row_id bigint, bytes binary, scan_error string"
#: Defaults of Spark's own file scans.
SPLIT, COST = 128 << 20, 4 << 20


class Ranges(InputPartition):
    def __init__(self, ranges):
        self.ranges = ranges


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.separator = options.get("separator", "\n").encode()
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.recursive = options.get("recursive", "false") == "true"
        self.names = glob_to_regex(options["pattern"]) if options.get("pattern") else None
        self.split, self.cost = int(options.get("split", SPLIT)), int(options.get("cost", COST))
        self.first = options.get("first")

    def files(self):
        named = tasks.name_test(self.names) if self.names else None
        keep = lambda path: path in self.paths or not named or named(path.rsplit("/", 1)[-1])
        return [(path, size) for path, size in tasks.list_inputs(self.paths, self.recursive) if keep(path)]

    def partitions(self):
        if self.first is not None:
            return [Ranges([(p, tasks.file_uri(p), 0, max(n, 1), n)]) for p, n in self.files()]
        return [Ranges(x) for x in tasks.plan_ranges(self.files(), self.split, self.cost)]

    def read(self, partition):
        first = re.compile(self.first.encode()) if self.first is not None else None
        yield from tasks.read_ranges(partition.ranges, self.separator, first)


class Lines(DataSource):
    """Pieces of files as (file, block_start, row_id, bytes, scan_error)."""

    @classmethod
    def name(cls):
        return "opstrail_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LinesReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(Lines)
