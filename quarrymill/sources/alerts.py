"""Alerts as a data sink: a line a row into a folder's log, and optionally a message each; a failing sink never fails the run.

``df.write.format("alerts").option("path", ...)``. Each task writes its lines to a file that only its commit names, so a task
that is run again, or speculated, gives no line twice; an aborted write leaves no log. What can't be written is counted and
reported in the log's summary, not raised.
"""

from __future__ import annotations

import json
import os
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    lines: int
    failed: int
    errors: list[str] = field(default_factory=list)


def line_of(message: str, at: datetime) -> str:
    return f"[{at.astimezone(timezone.utc).isoformat(timespec='seconds')}] ALERT {message}"


def post(url: str, line: str, seconds: float = 10) -> None:
    request = urllib.request.Request(url, json.dumps({"text": line}).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=seconds):
        pass


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.url, self.batch = options["path"].removeprefix("file://"), options.get("webhook"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        path, lines, failed, errors = f"{self.folder}/.{self.batch}-{uuid.uuid4().hex}", 0, 0, []
        try:
            os.makedirs(self.folder, exist_ok=True)
            with open(path, "w", encoding="utf-8") as out:
                for row in iterator:
                    line = line_of(str(row[0]), datetime.now(timezone.utc))
                    out.write(line.replace("\n", " ") + "\n")
                    lines += 1
                    if self.url:
                        try:
                            post(self.url, line)
                        except Exception as e:  # an alert must never take down a run
                            failed += 1
                            errors.append(str(e)[:200])
        except OSError as e:
            return _Written(None, lines, failed + 1, [*errors, str(e)[:200]])
        return _Written(path, lines, failed, errors)

    def commit(self, messages: list[_Written | None]) -> None:
        """The tasks' files become the log's; the summary tells what failed."""
        done = [m for m in messages if m]
        try:
            for i, m in enumerate(done):
                if m.path:
                    os.replace(m.path, f"{self.folder}/{self.batch}-{i:05d}.log")
            with open(f"{self.folder}/{self.batch}.summary.json", "w", encoding="utf-8") as out:
                json.dump({"lines": sum(m.lines for m in done), "failed": sum(m.failed for m in done), "errors": sorted({e for m in done for e in m.errors})}, out)
        except OSError:
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.path:
                try:
                    os.remove(m.path)
                except OSError:
                    pass


class Alerts(DataSource):
    """Writes the first column of each row; options: path (a folder that the executors share), webhook."""

    @classmethod
    def name(cls) -> str:
        return "alerts"

    def schema(self) -> str:
        return "message string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Alerts)
