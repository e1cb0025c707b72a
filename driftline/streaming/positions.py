"""Positions of pipelines: small JSON records.

Streams keep their offsets in Spark's checkpoints; these records hold what
spans queries: the stage of a replication and how far each table of a
snapshot is.  They lie in files of a shared folder, in a table of any
connector (JDBC, a document store), or in memory.
"""

from __future__ import annotations

import json
import random
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftline.streaming.tables import Folder

VERSION = "1.0"


@dataclass
class Position:
    """``start`` is the configured start, ``value`` how far the pipeline came."""

    name: str
    stage: str = "batch"
    start: object = None
    value: object = None
    done: list[str] = field(default_factory=list)
    version: str = VERSION
    updated: float = 0.0


class Positions:
    """``get``, ``put`` and ``reset`` over the texts that a store keeps."""

    def _load(self, name: str) -> str | None:
        raise NotImplementedError

    def _save(self, name: str, text: str) -> None:
        raise NotImplementedError

    def reset(self, name: str) -> None:
        raise NotImplementedError

    def get(self, name: str, start: object = None) -> Position:
        """The stored position.  If another start is configured than the one it
        began with, the pipeline begins anew."""
        text = self._load(name)
        if text is None:
            return Position(name, start=start, value=start)
        p = Position(**json.loads(text))
        if start is not None and p.start != start:
            return Position(name, stage=p.stage, start=start, value=start)
        return p

    def put(self, p: Position) -> None:
        p.updated = time.time()
        self._save(p.name, json.dumps(asdict(p)))


class PositionStore(Positions):
    """Files of a shared folder; each write is a new one, the last few stay."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 5):
        self.folder, self.keep = Folder(spark, path), keep

    def _files(self, name: str) -> list[str]:
        return [n for n in self.folder.names(name) if n.endswith(".json")]

    def _load(self, name: str) -> str | None:
        files = self._files(name)
        return self.folder.read(f"{name}/{files[-1]}") if files else None

    def _save(self, name: str, text: str) -> None:
        files = self._files(name)
        n = int(files[-1].partition(".")[0]) + 1 if files else 0
        self.folder.write(f"{name}/{n:012d}.json", text)
        for old in files[: max(0, len(files) + 1 - self.keep)]:
            self.folder.delete(f"{name}/{old}")

    def reset(self, name: str) -> None:
        self.folder.delete(name)


class TablePositions(Positions):
    """Rows (name, n, position) of a table that a connector reads and appends
    to; the greatest n of a name counts, an empty position is none."""

    def __init__(self, spark: SparkSession, fmt: str, **options):
        self.spark, self.fmt, self.options = spark, fmt, options

    def _rows(self, name: str):
        try:
            df = self.spark.read.format(self.fmt).options(**self.options).load()
        except Exception as e:  # the table is made by the first write
            if "PATH_NOT_FOUND" in str(e) or "TABLE_OR_VIEW_NOT_FOUND" in str(e):
                return None
            raise
        return df.where(F.col("name") == name).orderBy(F.desc("n")).select("n", "position").first()

    def _load(self, name: str) -> str | None:
        row = self._rows(name)
        return row.position or None if row else None

    def _save(self, name: str, text: str) -> None:
        row = self._rows(name)
        one = self.spark.createDataFrame([(name, row.n + 1 if row else 0, text)], "name string, n bigint, position string")
        one.write.format(self.fmt).options(**self.options).mode("append").save()

    def reset(self, name: str) -> None:
        self._save(name, "")


class MemoryPositions(Positions):
    """For tests and pipelines that always begin anew."""

    def __init__(self):
        self.texts: dict[str, str] = {}

    def _load(self, name: str) -> str | None:
        return self.texts.get(name)

    def _save(self, name: str, text: str) -> None:
        self.texts[name] = text

    def reset(self, name: str) -> None:
        self.texts.pop(name, None)


SNAPSHOT_VERSION = "v1.0"


@dataclass
class TableProgress:
    """Least, greatest and current key of a table's scan (a list of
    {column, type, value} each), rows expected and read, and whether it is done."""

    least: list[dict] | None = None
    greatest: list[dict] | None = None
    current: list[dict] | None = None
    expected: int = 0
    read: int = 0
    done: bool = False


# Names of the fields in stored snapshot positions.
_PROGRESS = {"least": "min", "greatest": "max", "current": "current", "expected": "estimated-count", "read": "scanned-count", "done": "done"}


@dataclass
class SnapshotPosition:
    """Where a snapshot's log begins and how far each table is."""

    start: dict | None = None
    tables: dict[str, TableProgress] = field(default_factory=dict)

    def encode(self) -> str:
        stats = {t: {n: getattr(p, a) for a, n in _PROGRESS.items()} for t, p in self.tables.items()}
        return json.dumps({"schema-version": SNAPSHOT_VERSION, "start-binlog": self.start, "table-stats": stats})

    @classmethod
    def decode(cls, text: str) -> "SnapshotPosition":
        """Also reads records without version, whose keys were of one column."""
        raw = json.loads(text)
        version = raw.get("schema-version") or ""
        if version not in ("", SNAPSHOT_VERSION):
            raise ValueError(f"unknown version {version!r} of a snapshot position")
        out = cls(raw.get("start-binlog"))
        for t, stats in (raw.get("table-stats") or {}).items():
            p = TableProgress(**{a: stats[n] for a, n in _PROGRESS.items() if stats.get(n) is not None})
            if not version:
                for a in ("least", "greatest", "current"):
                    v = getattr(p, a)
                    setattr(p, a, None if v is None else [v])
            out.tables[t] = p
        return out


def pending_tables(tables: list[str], p: Position) -> list[str]:
    """Tables of a snapshot that are still to be scanned after a restart."""
    return [t for t in tables if t not in p.done]


def retry(fn, times: int = 3, wait_s: float = 1.0, jitter: float = 0.5):
    """Calls ``fn`` again after a failure, waiting twice as long each time and
    up to a share of ``jitter`` longer, so that many don't come back at once.
    For calls to outside systems; Spark repeats its own tasks."""
    for k in range(times + 1):
        try:
            return fn()
        except Exception:
            if k == times:
                raise
            time.sleep(wait_s * 2**k * (1 + random.random() * jitter))
