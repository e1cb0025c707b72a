"""Keyed apply semantics: what a target table holds after ordered changes.

Changes have ``op``, key columns and an order column that is unique per key.
Rows that the target holds already are changes of order -1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.joins import null_safe_join
from driftline.operators.ordering import running


def _last(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    picked = F.max_by(F.struct("op", *columns, order), order)
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def replace_rows(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Last writer wins: the row of the last change unless that is a delete.
    One aggregate with map-side combine; no sort, no window."""
    return _last(df, keys, order, columns).where("op <> 'delete'").drop("op")


def replace_with_unique_keys(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], unique: Sequence[Sequence[str]]) -> DataFrame:
    """As replace_rows; besides, a row falls to a later write of another key
    that has the same non-null value in a unique key.  Only the
    latest writer of each unique value is kept, by one aggregate with map-side
    combine, so a hot value never pairs its writers."""
    live = replace_rows(df, keys, order, columns)
    writes = df.where("op <> 'delete'")
    for uk in unique:
        some = " and ".join(f"{c} is not null" for c in uk)
        me = F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys])
        held = writes.where(some).select(*uk, me.alias("_pk"), F.col(order).alias("_o"))
        latest = held.groupBy(*uk).agg(F.max_by("_pk", "_o").alias("_pk"), F.max("_o").alias("_o"))
        kept = live.where(some).withColumn("_me", me).join(latest, list(uk), "left").where(F.col("_pk").isNull() | (F.col("_pk") == F.col("_me")) | (F.col("_o") < F.col(order)))
        # rows without the value can't fall and stay out of the join
        live = kept.select(*live.columns).unionByName(live.where(f"not ({some})"))
    return live.select(*keys, *columns, order)


def insert_ignore(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Inserts and updates take effect only where no row is: the first write
    after the last delete of the key.  A null key is a key of its own."""
    last_delete = df.where("op = 'delete'").groupBy(*keys).agg(F.max(order).alias("_d"))
    writes = null_safe_join(df.where("op <> 'delete'"), last_delete, keys, "left").where(F.col("_d").isNull() | (F.col(order) > F.col("_d")))
    return writes.groupBy(*keys).agg(F.min_by(F.struct(*columns, order), order).alias("_r")).select(*keys, "_r.*")


def insert_ignore_unique(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], unique: Sequence[str], group: Sequence[str]) -> DataFrame:
    """INSERT IGNORE with further unique keys: what a write does depends on all
    rows that can collide with it, so their order can't be split.  ``group``
    names columns that colliding rows share (a shard, a tenant); each group is
    replayed in sorted partitions.  Its state is the live keys and their
    unique values; the rows themselves are joined to the winners afterwards.
    Null unique values never collide, a null key is a key of its own; of
    equal orders in a group any may come first."""
    state = list(dict.fromkeys([*group, *keys, *unique, order, "op"]))
    src = df.select(*state)
    place = {c: i for i, c in enumerate(state)}
    schema = src.select(*group, *keys, order).schema
    names = schema.names

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        current, rows, taken = None, {}, set()
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out)) if out else [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for v in zip(*[c.to_pylist() for c in b.columns]):
                g = tuple(v[place[c]] for c in group)
                if g != current:
                    out.extend(r for r, _ in rows.values())
                    current, rows, taken = g, {}, set()
                k = tuple(v[place[c]] for c in keys)
                mine = [(u, v[place[u]]) for u in unique if v[place[u]] is not None]
                if v[place["op"]] == "delete":
                    gone = rows.pop(k, None)
                    if gone is not None:
                        taken.difference_update(gone[1])
                elif k not in rows and taken.isdisjoint(mine):
                    rows[k] = (tuple(v[place[c]] for c in names), mine)
                    taken.update(mine)
            if len(out) > 8192:
                yield flush()
        out.extend(r for r, _ in rows.values())
        yield flush()

    winners = src.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(run, schema)
    rest = list(dict.fromkeys([*group, *keys, *unique, *columns, order]))
    return null_safe_join(df.where("op <> 'delete'").select(*rest), winners, names, "inner").select(*rest)


def upsert_rows(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE: as last writer wins, for tables with
    one unique key; absent columns become null."""
    if unique:
        raise ValueError("upsert needs a table with a single unique key")
    return replace_rows(df, keys, order, columns)


def conflicts(df: DataFrame, keys: Sequence[str], order: str, image: Column, old: Column | None = None) -> DataFrame:
    """Adds ``conflict``: an insert conflicts if the row is there, an update if
    the row isn't there as its old image says.  Conflicting writes override
    the row, so the row before a change is the image of the change before it."""
    seen = running(df.withColumn("_image", image), keys, [order], F.col(order), _op=("lag", F.col("op")), _before=("lag", F.col("_image")))
    there = F.col("_op").isNotNull() & (F.col("_op") != "delete")
    differs = F.lit(False) if old is None else ~F.col("_before").eqNullSafe(old)
    found = F.when(F.col("op") == "insert", there).when(F.col("op") == "update", ~there | differs).otherwise(F.lit(False))
    return seen.withColumn("conflict", F.coalesce(found, F.lit(False))).drop("_op", "_before", "_image")


def conflicts_kept(df: DataFrame, keys: Sequence[str], order: str, image: str, old: str) -> DataFrame:
    """Conflict detection without override: a conflicting write changes
    nothing, so each step depends on the one before.  Rows are replayed by key
    in sorted partitions, one state a key, no key is gathered.  Returns the
    keys, ``order``, ``op`` and ``conflict``."""
    src = df.select(*keys, order, "op", F.col(image).cast("string").alias("_i"), F.col(old).cast("string").alias("_o"))
    schema = src.select(*keys, order, "op").withColumn("conflict", F.lit(True)).schema
    n = len(keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, state = None, None
        for b in batches:
            flags = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                k, (op, i, o) = row[:n], row[n + 1 :]
                if k != current:
                    current, state = k, None
                if op == "insert":
                    flags.append(state is not None)
                    state = state if state is not None else (i,)
                elif op == "update":
                    bad = state is None or state != (o,)
                    flags.append(bad)
                    state = state if bad else (i,)
                else:
                    flags.append(False)
                    state = None
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 2], pa.array(flags, pa.bool_())], names=[*keys, order, "op", "conflict"])

    return src.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def conflict_preview(df: DataFrame, target: DataFrame, keys: Sequence[str], unique: Sequence[Sequence[str]] = (), old: dict[str, Column] | None = None, deletes: bool = True) -> DataFrame:
    """Adds ``verdict`` (ok, conflict, skipped) against a target.  An insert
    must find no row with its key or any of its ``unique`` keys (nulls never
    clash); an update must find a row as its ``old`` image says (column to
    value, null equal to null; without one: its key) and, where its new image
    differs, none that is as the new one; a delete must find its row, and is
    skipped without ``deletes``."""
    old = old or {}
    columns = list(old)
    out = df.withColumns({f"_old_{c}": v for c, v in old.items()})
    flags = []

    def probe(out: DataFrame, names: dict[str, Column], flag: str, nulls: bool) -> DataFrame:
        """``flag``: the target has a row with these values."""
        there = target.select(*[F.col(c).alias(f"_t_{c}") for c in names]).distinct().withColumn(flag, F.lit(True))
        on = F.lit(True)
        for c, v in names.items():
            on = on & (v.eqNullSafe(F.col(f"_t_{c}")) if nulls else v == F.col(f"_t_{c}"))
        flags.append(flag)
        return out.join(there, on, "left").drop(*[f"_t_{c}" for c in names])

    for i, u in enumerate([keys, *unique]):
        out = probe(out, {c: F.col(c) for c in u}, f"_u{i}", False)
    clash = F.lit(False)
    for i in range(1 + len(unique)):
        clash = clash | F.col(f"_u{i}").isNotNull()
    lacks = F.col("_u0").isNull()
    moved = F.lit(False)
    if old:
        out = probe(out, {c: F.col(f"_old_{c}") for c in columns}, "_before", True)
        out = probe(out, {c: F.col(c) for c in columns}, "_after", True)
        changed = F.lit(False)
        for c in columns:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
        moved = F.col("_before").isNull() | (changed & F.col("_after").isNotNull())
    bad = F.when(F.col("op") == "insert", clash).when(F.col("op") == "update", moved if old else lacks).otherwise(lacks)
    verdict = F.when(bad, "conflict").otherwise("ok")
    if not deletes:
        verdict = F.when(F.col("op") == "delete", "skipped").otherwise(verdict)
    return out.withColumn("verdict", verdict).drop(*flags, *[f"_old_{c}" for c in columns])


def delete_by_key(target: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        raise ValueError("delete needs a key")
    return target.join(deletes.select(*keys).distinct(), list(keys), "left_anti")


def manual_sql(spark: SparkSession, template: str, changes: DataFrame, view: str = "changes", **args) -> DataFrame:
    """A user's SQL over the changes; values come in as parameters only."""
    changes.createOrReplaceTempView(view)
    return spark.sql(template, args=args)


def fill_missing(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Target columns (name to type and default) in order: absent ones get the
    default, present nulls stay null; columns the target lacks are an error."""
    extra = [c for c in df.columns if c not in columns]
    if extra:
        raise ValueError(f"the target lacks columns {extra}")
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(v).cast(t).alias(c) for c, (t, v) in columns.items()])


def tagged(df: DataFrame, pipeline: str, slots: int = 999) -> DataFrame:
    """Marks written rows with the pipeline that wrote them and a slot from 1
    to ``slots``, so that a pipeline the other way knows them."""
    return df.withColumns({"txn_tag": F.lit(pipeline), "txn_slot": (F.pmod(F.crc32(F.lit(pipeline).cast("binary")), F.lit(slots)) + 1).cast("int")})


def with_generated(df: DataFrame, generated: dict[str, Column]) -> DataFrame:
    """Generated columns are computed anew, never copied."""
    return df.withColumns(generated)


ENGINES = {"replace": replace_rows, "insert-ignore": insert_ignore, "upsert": upsert_rows}
