"""Caption files and event logs as Spark data sources, for tables and streams: spark.dataSource.register(Captions), then format("captions").

A folder's files are the offsets of a stream: a batch takes those that have
come since the one before, in order of their time of change and name. Each file
is a partition, read on an executor line by line; folders must be open to all
executors as paths. Files are written whole and then moved in, not added to.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class File(InputPartition):
    """One file of a folder."""

    def __init__(self, path: str):
        self.path = path


def _listed(path: str, ending: str) -> list[tuple[int, str]]:
    """(time of change, path) of the files of a folder, or of the one file, in order."""
    names = [path] if os.path.isfile(path) else [f"{path}/{n}" for n in os.listdir(path) if n.endswith(ending) and n[0] not in "._"]
    return sorted((os.stat(n).st_mtime_ns, n) for n in names)


def _stamp(text: str) -> float:
    parts = text.strip().split(":")
    return sum(float(x) * 60**i for i, x in enumerate(reversed(parts)))


def caption_rows(path: str) -> Iterator[tuple]:
    """(file, seq, start, until, text) of the cues of a WebVTT file; a cue's lines are joined by a space, notes and styles left out."""
    with open(path, encoding="utf-8", errors="replace") as lines:
        seq, cue, told = 0, None, []
        for line in [*lines, ""]:
            line = line.strip("\r\n")
            if "-->" in line:
                begin, _, end = line.partition("-->")
                try:
                    cue = _stamp(begin), _stamp(end.split()[0])
                except (ValueError, IndexError):
                    cue = None
                told = []
            elif line.strip():
                told.append(line.strip())
            else:
                if cue and told:
                    yield path, seq, *cue, " ".join(told)
                    seq += 1
                cue, told = None, []


EVENT = ["id", "game_id", "ts", "round", "phase", "player", "type", "unit_id", "flag", "text", "amount"]


def event_rows(path: str) -> Iterator[tuple]:
    """Columns of schemas.EVENTS of a log with one JSON object a line; lines that are none are left out."""
    with open(path, encoding="utf-8", errors="replace") as lines:
        for line in lines:
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict):
                yield tuple(float(row[c]) if c == "ts" and row.get(c) is not None else row.get(c) for c in EVENT)


class _Rows(DataSourceReader):
    def __init__(self, path: str, ending: str, rows):
        self.path, self.ending, self.rows = path, ending, rows

    def partitions(self) -> list[InputPartition]:
        return [File(n) for _, n in _listed(self.path, self.ending)] or [File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition.path) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, ending: str, rows):
        self.path, self.ending, self.rows = path, ending, rows

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path, self.ending)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["time"], start["name"]), (end["time"], end["name"])
        return [File(n) for t, n in _listed(self.path, self.ending) if after < (t, n) <= upto]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition.path)


class Captions(DataSource):
    """WebVTT files: file, seq, start, until, text."""

    ending, rows = ".vtt", staticmethod(caption_rows)

    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return "file string, seq int, start double, until double, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Rows(self.options["path"], self.ending, self.rows)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self.ending, self.rows)


class EventLog(Captions):
    """Event logs with a JSON object a line: schemas.EVENTS."""

    ending, rows = ".jsonl", staticmethod(event_rows)

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        from lorespark.schemas import EVENTS

        return EVENTS
