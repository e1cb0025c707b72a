"""Per-key ordered replay of a change feed.

``replay_changes`` rebuilds the current rows of a table from inserts, updates
and deletes that may arrive late, repeated and out of order.

Plan: each input partition is first replayed where it lies (sort inside the
partition, then one state machine over the sorted rows), so a key that holds a
third of all rows leaves every partition as one row.  Only these per-key
states are repartitioned by key, sorted inside the partitions again and merged
by the same state machine.  A state carries the order stamp of its last change
and, for partial updates, a stamp for each column, so merging is independent
of how the rows lay in the input.  Memory is one row's state; no group is ever
collected.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.times import micros

_RAW, _STATE = 0, 1
_NONE = (-(1 << 62), -(1 << 62), "")


def _stamp(row_ts, row_seq, row_src):
    return (_NONE[0] if row_ts is None else row_ts, _NONE[1] if row_seq is None else row_seq, row_src or "")


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


class RowMachine:
    """State of one key: last change, last reset (insert or delete) and, with
    ``partial``, the columns set since then, each with its stamp."""

    __slots__ = ("partial", "last", "op", "seq", "data", "reset", "cols")

    def __init__(self, partial: bool):
        self.partial = partial
        self.last, self.op, self.seq, self.data, self.reset, self.cols = _NONE, None, None, None, _NONE, {}

    def _set(self, name, at, value) -> None:
        """The later value stays; of repeats that differ, the one of the least
        JSON text, so that it doesn't matter which came first."""
        old = self.cols.get(name)
        if old is None or at > old[0] or (at == old[0] and value != old[1] and _text(value) < _text(old[1])):
            self.cols[name] = (at, value)

    def change(self, at, op, seq, data) -> None:
        """Apply a raw change; of one that was applied already only a lesser text counts."""
        repeat = self.op is not None and at == self.last
        if self.op is not None and at < self.last:
            return
        if not repeat:
            self.last, self.op, self.seq = at, op, seq
        if not self.partial:
            data = None if op == "delete" else data
            self.data = data if not repeat or self.data is None or (data is not None and data < self.data) else self.data
            return
        if op != "update" and not repeat:
            self.reset, self.cols = at, {}
        if op != "delete" and data:
            try:
                row = json.loads(data)
            except ValueError:
                row = None
            # a pair is the row's image before and after its key changed
            parts = [p for p in (row if isinstance(row, list) else [row]) if isinstance(p, dict)]
            for k, v in {k: v for p in parts for k, v in p.items()}.items():
                self._set(k, at, v)

    def merge(self, at, op, seq, data) -> None:
        """Merge the state of another partition."""
        newer = self.op is None or at > self.last
        if self.partial:
            reset, cols = json.loads(data)
            self.reset = max(self.reset, tuple(reset))
            for k, (c_at, v) in cols.items():
                self._set(k, tuple(c_at), v)
        elif newer or (at == self.last and data is not None and (self.data is None or data < self.data)):
            self.data = data
        if newer:
            self.last, self.op, self.seq = at, op, seq

    def state(self):
        if not self.partial:
            return self.data
        return json.dumps([self.reset, {k: c for k, c in self.cols.items() if c[0] >= self.reset}], ensure_ascii=False)

    def image(self):
        if not self.partial:
            return self.data
        return json.dumps({k: v for k, (at, v) in sorted(self.cols.items()) if at >= self.reset}, ensure_ascii=False)


def _replayer(keys: Sequence[str], partial: bool, mode: int, schema: pa.Schema):
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, out = None, None, []

        def close():
            if machine is None or (mode == _STATE and machine.op == "delete"):
                return
            out.append((*current, machine.last[0], machine.last[1], machine.last[2], machine.op, machine.seq, machine.state() if mode == _RAW else machine.image()))

        def flush():
            cols = list(zip(*out))
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                key = row[:n]
                if key != current:
                    close()
                    current, machine = key, RowMachine(partial)
                at = _stamp(row[n], row[n + 1], row[n + 2])
                (machine.change if mode == _RAW else machine.merge)(at, row[n + 3], row[n + 4], row[n + 5])
            if len(out) >= 8192:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def replay_changes(
    changes: DataFrame,
    keys: Sequence[str],
    ts: Column,
    seq: Column,
    source: Column,
    op: Column,
    data: Column | None = None,
    partial: bool = False,
) -> DataFrame:
    """Current rows after all changes.

    ``op`` is ``insert``, ``update`` or ``delete``; any other value and null
    are no changes.  Changes apply in the order of (``ts``, ``seq``,
    ``source``), nulls first; a second change of a key with the same stamp is
    a repeat and changes nothing (if it differs, the least JSON text of each
    column stands, whichever came first).  ``data`` is a JSON object (null: nothing).  With
    ``partial`` an update sets only the columns it carries, an insert starts
    the row anew; otherwise the last image stands as it came.  An update of a
    row that does not exist makes it.  Malformed JSON sets nothing.  Null key
    columns group as a key of their own.  Extra columns of ``changes`` are
    ignored.  Returns the keys, ``seq`` (of the last change) and ``image``;
    empty input gives no rows.
    """
    raw = changes.select(
        *keys,
        micros(ts).alias("_ts"),
        seq.cast("bigint").alias("_seq"),
        F.coalesce(source.cast("string"), F.lit("")).alias("_src"),
        op.alias("_op"),
        seq.cast("bigint").alias("seq"),
        (F.lit(None).cast("string") if data is None else data.cast("string")).alias("image"),
    ).where(F.col("_op").isin("insert", "update", "delete"))
    fields = [T.StructField(k, raw.schema[k].dataType) for k in keys]
    fields += [T.StructField("_ts", T.LongType()), T.StructField("_seq", T.LongType()), T.StructField("_src", T.StringType()), T.StructField("_op", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("image", T.StringType())]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    order = [*keys, "_ts", "_seq", "_src"]
    states = raw.sortWithinPartitions(*order).mapInArrow(_replayer(keys, partial, _RAW, arrow), schema)
    merged = states.repartition(*keys).sortWithinPartitions(*order).mapInArrow(_replayer(keys, partial, _STATE, arrow), schema)
    return merged.select(*keys, "seq", "image")


def keyed_changes(feed: DataFrame, with_data: bool = True) -> DataFrame:
    """Change messages as (db, tbl, pk, event_ts, seq_no, stream_key, op,
    data_json, other_pk), one row per row key touched: an update whose old
    image holds another primary key also ends the row of the old key; either
    row names the other's key in other_pk.  Names are in
    canonical form.  Messages that are no dml, lack a name, or whose key is
    missing or not a JSON object touch no row.  The row under the new key is
    begun anew (``insert``) with the old image and what the update sets, as a
    pair ``[old, new]`` (see carried for columns that neither holds).
    Without ``with_data`` the bodies are null and not read."""
    from driftline.functions.names import key_entries, key_text, plain_name, plain_op

    dml = feed.where(plain_op(F.col("msg_type")) == "dml").select(
        plain_name(F.col("db")).alias("db"),
        plain_name(F.col("tbl")).alias("tbl"),
        "event_ts",
        "seq_no",
        "stream_key",
        plain_op(F.col("dml_op")).alias("op"),
        (F.col("data_json") if with_data else F.lit(None).cast("string")).alias("data_json"),
        key_entries(F.col("pks_json")).alias("_new"),
        F.when(plain_op(F.col("dml_op")) == "update", F.from_json("old_json", "map<string,string>")).alias("_old"),
        (F.col("old_json") if with_data else F.lit(None).cast("string")).alias("_before"),
    )
    old_key = F.transform(
        F.col("_new"),
        lambda e: F.struct(e["key"].alias("key"), F.when(F.map_contains_key("_old", e["key"]), F.element_at("_old", e["key"])).otherwise(e["value"]).alias("value")),
    )
    keyed = dml.where("db is not null and tbl is not null").withColumns(
        {"pk": key_text(F.col("_new")), "_old_pk": F.when(F.col("_old").isNotNull(), key_text(old_key))}
    )
    moved = F.col("_old_pk").isNotNull() & (F.col("_old_pk") != F.col("pk"))
    none = F.lit(None).cast("string")
    this = F.struct(F.col("pk"), F.col("op"), F.col("data_json"), none.alias("other_pk"))
    begun = F.struct(F.col("pk"), F.lit("insert").alias("op"), F.concat(F.lit("["), "_before", F.lit(","), F.coalesce("data_json", F.lit("null")), F.lit("]")).alias("data_json"), F.col("_old_pk").alias("other_pk"))
    ended = F.struct(F.col("_old_pk").alias("pk"), F.lit("delete").alias("op"), none.alias("data_json"), F.col("pk").alias("other_pk"))
    # tested here: as a filter it would be pushed down and parse the key once more
    touched = F.when(F.size("_new") > 0, F.when(moved, F.array(begun, ended)).otherwise(F.array(this)))
    return keyed.select("db", "tbl", "event_ts", "seq_no", "stream_key", F.explode(touched).alias("_c")).select(
        "db", "tbl", "_c.pk", "event_ts", "seq_no", "stream_key", "_c.op", "_c.data_json", "_c.other_pk"
    )


_ROW, _MOVE = ["db", "tbl", "pk"], ["_mts", "_mseq", "_msrc"]


def carried(changes: DataFrame) -> DataFrame:
    """Changes of keyed_changes in which rows begun under a new key also bring
    what the row held under its old key when it moved.

    A move ends the old row, so what it held depends only on the changes since
    the move before: changes of keys that moved are put in such epochs and each
    epoch is replayed like any other key, partitions first.  A row that moves
    on takes along what it was brought, so this is repeated until nothing
    more is carried; moves go on in time, so that ends.
    """
    from driftline.functions.joins import null_safe_join
    from driftline.operators.ordering import running
    from driftline.session import cut

    # stored, as keys are parsed once and rows are read four times
    changes = cut(changes)
    stamp = {"_mts": micros("event_ts"), "_mseq": F.col("seq_no"), "_msrc": F.coalesce("stream_key", F.lit(""))}
    ends, begins = (F.col("op") == "delete") & F.col("other_pk").isNotNull(), (F.col("op") == "insert") & F.col("other_pk").isNotNull()
    moves = cut(changes.where(ends).withColumns(stamp).select(*_ROW, "other_pk", *_MOVE).distinct())
    if moves.isEmpty():
        return changes
    theirs = cut(null_safe_join(changes, moves.select(*_ROW).distinct(), _ROW, "inner"))
    back = theirs.withColumns({"_nts": -micros("event_ts"), "_nseq": F.coalesce(-F.col("seq_no"), F.lit(2**62))})
    seen = running(back, _ROW, ["_nts", "_nseq"], F.col("_nts"), _next=("last", F.when(ends, F.struct(*[v.alias(k) for k, v in stamp.items()]))))
    epochs = cut(seen.where(F.col("_next").isNotNull() & ~ends).select(*theirs.columns, "_next.*"))
    brought = None

    def with_brought(rows: DataFrame) -> DataFrame:
        """``rows`` are begun ones."""
        own = rows.withColumns({f"_at{k}": v for k, v in stamp.items()})
        names = {k: f"_at{k}" for k in _MOVE}
        joined = null_safe_join(own, brought.withColumnsRenamed(names), [*_ROW, *names.values()], "left")
        more = F.concat(F.lit("["), "_image", F.lit(","), F.substring(F.col("data_json"), 2, 2**30))
        return joined.withColumn("data_json", F.coalesce(more, "data_json")).select(*rows.columns)

    while True:
        rows = epochs if brought is None else epochs.where(~begins).unionByName(with_brought(epochs.where(begins)))
        held = replay_changes(rows, [*_ROW, *_MOVE], F.col("event_ts"), F.col("seq_no"), F.col("stream_key"), F.col("op"), F.col("data_json"), True)
        now = cut(null_safe_join(held, moves, [*_ROW, *_MOVE], "inner").select("db", "tbl", F.col("other_pk").alias("pk"), *_MOVE, F.col("image").alias("_image")))
        if brought is not None and now.exceptAll(brought).isEmpty():
            break
        brought = now
    return changes.where(~begins | begins.isNull()).unionByName(with_brought(changes.where(begins)))


def current_rows(feed: DataFrame, with_image: bool = False, partial: bool = True) -> DataFrame:
    """Rows that each table of a change feed holds after all messages:
    db, tbl, pk, seq_no and, with ``with_image``, the row as JSON."""
    changes = keyed_changes(feed, with_image)
    if with_image and partial:
        changes = carried(changes)
    rows = replay_changes(
        changes,
        ["db", "tbl", "pk"],
        F.col("event_ts"),
        F.col("seq_no"),
        F.col("stream_key"),
        F.col("op"),
        F.col("data_json") if with_image else None,
        partial and with_image,
    )
    return rows.select("db", "tbl", "pk", F.col("seq").alias("seq_no"), *(["image"] if with_image else []))
