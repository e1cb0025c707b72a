"""Filling containers of fixed capacity with items (bounded-space packing).

Every task keeps a fixed number of open windows, places each item where it
fits best, and emits the fullest window when none fits.  Items are taken as
they lie, without a shuffle.  The items of windows left open at the end of a
task are packed again, largest first, in ever fewer tasks, at last in one task
for each pack; such a task may keep as many windows open as it was handed, a
fixed number as well, and leaves no more open than any other task.

A window is held until it is emitted, so a task needs memory for its open
windows, each of at most ``capacity`` tokens.  Texts without tokens take no
room and stay out of the windows; they come out in the first container of
their pack.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import cut

OPEN = 64  # open windows of a task and pack
MERGE = 8  # tasks of one stage whose leftovers one task of the next packs again

_ITEM = "struct<doc_id:bigint,part:int,start_token:bigint,n_tokens:bigint>"
_SCHEMA = f"pack_id string, capacity bigint, task int, closed boolean, container string, items array<{_ITEM}>"
_ARROW = pa.schema(
    [
        ("pack_id", pa.string()),
        ("capacity", pa.int64()),
        ("task", pa.int32()),
        ("closed", pa.bool_()),
        ("container", pa.string()),
        ("items", pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64())]))),
    ]
)


class BestFit:
    """Open windows of one pack, ordered by free space."""

    def __init__(self, capacity: int, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        self.free: list[int] = []  # ascending
        self.windows: list[list] = []

    def place(self, size: int, item) -> list | None:
        """Places an item of a size from 1 to the capacity; returns a window
        that is full or had to make room."""
        k = bisect.bisect_left(self.free, size)
        emitted = None
        if k < len(self.free):
            free, window = self.free.pop(k) - size, self.windows.pop(k)
            window.append(item)
        else:
            if size < self.capacity and len(self.free) >= self.limit:
                self.free.pop(0)
                emitted = self.windows.pop(0)
            free, window = self.capacity - size, [item]
        if not free:
            return window
        k = bisect.bisect_left(self.free, free)
        self.free.insert(k, free)
        self.windows.insert(k, window)
        return emitted


def _packer(stage: int, limit: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_: dict[tuple, BestFit] = {}
        out, made = [], 0

        def flush():
            rows = list(zip(*out)) if out else [[] for _ in _ARROW]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)

        def emit(pack, capacity, window, closed=True):
            nonlocal made
            out.append((pack, capacity, part, closed, f"{stage}-{part}-{made}", window))
            made += 1

        for b in batches:
            for pack, capacity, item in zip(*[c.to_pylist() for c in b.columns]):
                fit = open_.get((pack, capacity))
                if fit is None:
                    fit = open_[pack, capacity] = BestFit(capacity, limit)
                window = fit.place(item["n_tokens"], item)
                if window is not None:
                    emit(pack, capacity, window)
            if len(out) >= 1024:
                yield flush()
        for (pack, capacity), fit in open_.items():
            # the fullest can gain least from being packed again
            for k, window in enumerate(fit.windows):
                emit(pack, capacity, window, last or k < len(fit.windows) - OPEN)
        yield flush()

    return run


MAX_SPECS = 1_000


def items_of(sized: DataFrame, specs: list[tuple[str, str | None, int]]) -> DataFrame:
    """(pack_id, capacity, item): the items of each pack; an item larger than
    the capacity is cut into pieces of exactly the capacity and a rest.  Specs
    are settings, so each document looks its packs up in a literal array and
    nothing is joined."""
    literal = F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(lang).cast("string").alias("lang"), F.lit(c).cast("bigint").alias("capacity")) for p, lang, c in specs])
    mine = F.filter(literal, lambda s: s["lang"].isNull() | F.coalesce(s["lang"] == F.col("lang"), F.lit(False)))
    joined = sized.select("doc_id", "n_tokens", F.explode(mine).alias("_s")).select("doc_id", "n_tokens", "_s.pack_id", "_s.capacity")
    pieces = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)).cast("int")
    each = joined.select("pack_id", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("part"))
    start = F.col("part").cast("bigint") * F.col("capacity")
    size = F.least(F.col("capacity"), F.col("n_tokens") - start)
    return each.select("pack_id", "capacity", F.struct("doc_id", "part", start.alias("start_token"), size.alias("n_tokens")).alias("item"))


def pack(sized: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, capacity, container, doc_id, part, start_token, n_tokens): each
    token of each document of a pack in exactly one container.

    ``sized``: doc_id, lang, n_tokens (null counts as 0); ``specs``: pack_id,
    lang (null: all), capacity_tokens, at most MAX_SPECS rows.  Specs without
    an id or a positive capacity make nothing.  Texts without tokens lie in
    the first container of their pack (``0`` if it has no other).
    Repeated doc_ids are items of their own.  Empty tables give no rows.
    """
    rows = specs.where("capacity_tokens > 0 and pack_id is not null").select("pack_id", "lang", "capacity_tokens").limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} pack specs")
    known = sized.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0).cast("bigint")).alias("n_tokens"))
    items = items_of(known, [tuple(r) for r in rows]) if rows else items_of(known, [("", None, 1)]).where("false")
    done, stage, limit = None, 0, OPEN
    current = items.where("item.n_tokens > 0").mapInArrow(_packer(0, limit, False), _SCHEMA)
    while True:
        current = cut(current)
        closed = current.where("closed")
        done = closed if done is None else done.unionByName(closed)
        left = current.where("not closed")
        tasks = left.agg(F.count_distinct("task")).first()[0]
        if not tasks:
            break
        n, stage = -(-tasks // MERGE), stage + 1
        # one task takes the windows of at most MERGE * 2 tasks or so, whose number bounds its own
        limit = OPEN * tasks if n == 1 else OPEN * MERGE * 2
        keys = ["pack_id"] if n == 1 else ["pack_id", "_g"]
        again = left.select("pack_id", "capacity", F.pmod("task", F.lit(n)).alias("_g"), F.explode("items").alias("item"))
        moved = again.repartition(n if n > 1 else max(1, len(rows)), *keys).sortWithinPartitions("pack_id", F.desc("item.n_tokens"), "item.doc_id", "item.part")
        current = moved.select("pack_id", "capacity", "item").mapInArrow(_packer(stage, limit, n == 1), _SCHEMA)
    placed = done.select("pack_id", "capacity", "container", F.explode("items").alias("item"))
    first = F.broadcast(done.groupBy("pack_id").agg(F.min("container").alias("container")))  # a row a pack
    empty = items.where("item.n_tokens <= 0").join(first, "pack_id", "left").select("pack_id", "capacity", F.coalesce("container", F.lit("0")).alias("container"), "item")
    return placed.unionByName(empty).select("pack_id", "capacity", "container", "item.doc_id", "item.part", "item.start_token", "item.n_tokens")


def container_report(packed: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, least number of containers and unused share."""
    per = packed.groupBy("pack_id", "capacity").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return per.select("pack_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
