"""Pipelines from JSON or TOML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline import registry
from driftline.functions.names import plain_op
from driftline.operators import apply, filters, routing


# Fixed value: letters and digits of a name that spell no word.
SAFE_LETTERS = "bcdfghjklmnpqrstvwxz2456789"


def config_hash(text: str) -> str:
    """FNV-1a of 32 bits as a decimal number, each digit in a safe letter."""
    h = 0x811C9DC5
    for b in text.encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return "".join(SAFE_LETTERS[ord(c) % len(SAFE_LETTERS)] for c in str(h))


def upgraded(c: dict) -> dict:
    """Settings of the older form, in which the name of a plugin is the key of
    its settings (``input: {mysql: {...}}``), in the newer one (``input:
    {type: mysql, mode: ..., config: {...}}``).  Only the relational input
    had a mode; all others were streams."""
    inputs = c.get("input") or {}
    if c.get("version") == "1.0" or "type" in inputs or not (len(inputs) == 1 and isinstance(next(iter(inputs.values())), dict)):
        return c
    out = dict(c)
    ((kind, settings),) = inputs.items()
    out["input"] = {"type": kind, "mode": settings["mode"] if kind == "mysql" else "stream", "config": settings}
    out["filters"] = [f if "config" in f else {"type": f["type"], "config": {k: v for k, v in f.items() if k != "type"}} for f in c.get("filters") or []]
    outputs = c.get("output") or {}
    if len(outputs) == 1 and isinstance(next(iter(outputs.values())), dict):
        ((kind, settings),) = outputs.items()
        out["output"] = {"sink": kind, **settings}
    schedulers = c.get("scheduler") or {}
    if len(schedulers) == 1 and isinstance(next(iter(schedulers.values())), dict):
        ((kind, settings),) = schedulers.items()
        out["scheduler"] = {"type": kind, "config": settings}
    return out


def plain(settings):
    """``{type, mode, config: {...}}`` as one dict; what stands outside wins."""
    if isinstance(settings, dict) and isinstance(settings.get("config"), dict):
        return {**settings["config"], **{k: v for k, v in settings.items() if k != "config"}}
    return settings


@dataclass
class Pipeline:
    """name, input, filters in order, output with its routes and engine.  The
    scheduler is Spark; its settings are kept, not used."""

    name: str
    input: dict = field(default_factory=dict)
    filters: list[dict] = field(default_factory=list)
    output: dict = field(default_factory=dict)
    version: str = "1.0"
    internal_db_name: str = "_driftline"
    scheduler: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Pipeline":
        text = Path(path).read_text()
        if path.endswith(".toml"):
            import tomllib

            return cls.of(tomllib.loads(text))
        return cls.of(json.loads(text))

    @classmethod
    def of(cls, c: dict) -> "Pipeline":
        c = upgraded(c)
        if not c.get("name"):
            raise ValueError("a pipeline needs a name")
        known = {"name", "input", "filters", "output", "version", "internal-db-name", "scheduler"}
        if unknown := set(c) - known:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**{k.replace("-", "_"): plain(v) for k, v in c.items()})

    def hash(self) -> str:
        """Short digest of the settings, to see that they changed."""
        return config_hash(json.dumps([self.input, self.filters, self.output], sort_keys=True))

    def transform(self, changes: DataFrame) -> DataFrame:
        """Filters, then routes to tables."""
        return routing.route_tables(filters.chain(changes, self.filters), self.output.get("routes", []))

    def engine(self):
        """The apply engine named: built in, or a plugin."""
        name = self.output.get("engine", "replace")
        return apply.ENGINES[name] if name in apply.ENGINES else registry.plugin("sqlExecutionEngine", name)

    def fold(self, changes: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
        """The target's rows after all changes, by the engine named."""
        return self.engine()(self.transform(changes).where(F.col("op").isNotNull()), ["tgt_db", "tgt_tbl", *keys], order, columns)

    def flat(self, changes: DataFrame) -> DataFrame:
        """Filtered and routed changes with the keys and columns of the output
        taken from the change's maps; changes without operation are no rows."""
        keys, order, columns = self.output["keys"], self.output["order"], self.output.get("columns", [])
        df = self.transform(changes).where(F.col("op").isNotNull())
        maps = {k: F.coalesce(F.try_element_at("pks", F.lit(k)), F.try_element_at("data", F.lit(k))) for k in keys} | {c: F.try_element_at("data", F.lit(c)) for c in columns}
        return df.select("tgt_db", "tgt_tbl", *[x.alias(c) for c, x in maps.items()], plain_op(F.col("op")).alias("op"), order)

    def rows(self, flat: DataFrame) -> DataFrame:
        """The target's rows after flat changes."""
        return self.engine()(flat, ["tgt_db", "tgt_tbl", *self.output["keys"]], self.output["order"], self.output.get("columns", []))

    def folded(self, changes: DataFrame) -> DataFrame:
        return self.rows(self.flat(changes))
