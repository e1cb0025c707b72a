"""One consistent table, and a report of each change, from rows whose fields
and names drift between files.

Rows are loaded as path-value maps with their raw JSON kinds.  Kinds are
counted by file, table and statement epoch (the stretch between two
statements) with map-side combine; only these statistics, a few rows a table
and epoch, are put in order and folded with the statements, per lineage (a
table through its renames), by a streaming state machine that holds one
schema.  Renames that no statement tells are verified on the values: each id
must keep its value under the new name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.ddl import actions
from driftline.functions.names import plain_name, plain_op
from driftline.functions.times import from_micros, micros
from driftline.operators.ordering import running
from driftline.session import cut

BROADCAST_EVENTS = 100_000  # statements (some 50 bytes each) up to which the epochs of names are broadcast
LISTED_EVENTS = 200  # statements of one name up to which its messages search a list
KEPT_SHARE = 0.5  # of the ids with values on both sides, the share that must agree in a rename

_ACTION = "db string, tbl string, ts bigint, seq bigint, pos int, kind string, field string, new_name string, type_word string, new_db string, columns string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["db", "tbl", "ts", "seq", "pos", "kind", "field", "new_name", "type_word", "new_db", "columns"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 6]
    for batch in batches:
        out = []
        for db, tbl, ts, seq, sql in zip(*[c.to_pylist() for c in batch.columns]):
            for pos, (a_db, a_tbl, a) in enumerate(actions(sql)):
                # the row names the table; a statement on several tables names each
                at = (a_db or db, a_tbl or tbl) if a.kind == "rename_table" and pos else (db, tbl)
                out.append((*at, ts, seq, pos, a.kind, a.field, a.new_name, a.type_word, a.new_db or at[0], None if a.columns is None else json.dumps(a.columns)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)


def statements(feed: DataFrame) -> DataFrame:
    """Actions of the statements, each delivered statement once."""
    ddl = feed.where(plain_op(F.col("msg_type")) == "ddl").where("ddl_sql is not null").dropDuplicates(["stream_key", "seq_no"])
    rows = ddl.select(plain_name(F.col("db")).alias("db"), plain_name(F.col("tbl")).alias("tbl"), micros("event_ts").alias("ts"), F.col("seq_no").alias("seq"), "ddl_sql")
    return rows.mapInArrow(_parse, _ACTION)


def name_events(acts: DataFrame) -> DataFrame:
    """(db, tbl, ts, seq, start): places at which a statement touches a name;
    start marks that a new table begins to bear it."""
    own = acts.select("db", "tbl", "ts", "seq", (F.col("kind") == "create").alias("start"))
    into = acts.where("kind = 'rename_table'").select(F.col("new_db").alias("db"), F.col("new_name").alias("tbl"), "ts", "seq", F.lit(True).alias("start"))
    return own.unionByName(into).groupBy("db", "tbl", "ts", "seq").agg(F.max("start").alias("start"))


def _place(df: DataFrame, events: DataFrame, small: bool) -> DataFrame:
    """Adds inst (how many tables bore the name before or now) and the place
    of the last statement (e_ts, e_seq).  Few statements are broadcast as one
    sorted array a name; many are merged with the rows in running sums over
    binned streams, so neither a hot table nor one with very many statements
    is gathered."""
    never = F.lit(-(2**62)).cast("bigint")
    if small:
        per = events.groupBy("db", "tbl").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "start"))).alias("_events"))
        joined = df.join(F.broadcast(per), ["db", "tbl"], "left")
        past = F.filter(F.coalesce("_events", F.array().cast("array<struct<ts:bigint,seq:bigint,start:boolean>>")), lambda e: (e["ts"] < F.col("ts")) | ((e["ts"] == F.col("ts")) & (e["seq"] <= F.col("seq"))))
        last = F.try_element_at("_past", F.lit(-1))
        return (
            joined.withColumn("_past", past)
            .withColumns({"inst": F.size(F.filter("_past", lambda e: e["start"])).cast("bigint"), "e_ts": F.coalesce(last["ts"], never), "e_seq": F.coalesce(last["seq"], never)})
            .drop("_events", "_past")
        )
    both = df.withColumn("_row", F.lit(1)).unionByName(events.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    here = F.when(F.col("_row") == 0, F.struct("ts", "seq"))
    ran = running(both, ["db", "tbl"], ["ts", "seq", "_row"], F.col("ts"), inst=("sum", F.col("start").cast("int")), _last=("last", here))
    return ran.where("_row = 1").withColumns({"e_ts": F.coalesce(F.col("_last.ts"), never), "e_seq": F.coalesce(F.col("_last.seq"), never)}).drop("_row", "start", "_last")


def images(feed: DataFrame) -> DataFrame:
    """Inserts and updates: db, tbl, ts, seq, src_file, typed, data_json.
    Deletes carry the key only and say nothing of the schema."""
    op = plain_op(F.col("dml_op"))
    return feed.where((plain_op(F.col("msg_type")) == "dml") & op.isin("insert", "update") & F.col("data_json").isNotNull()).select(
        plain_name(F.col("db")).alias("db"),
        plain_name(F.col("tbl")).alias("tbl"),
        micros("event_ts").alias("ts"),
        F.col("seq_no").alias("seq"),
        "src_file",
        F.coalesce(F.col("msg_version") != "0.1", F.lit(True)).alias("typed"),
        "data_json",
    )


def once(feed: DataFrame) -> DataFrame:
    """Each delivered message once, as it came first; messages without stream or number are no repeats."""
    known = F.col("stream_key").isNotNull() & F.col("seq_no").isNotNull()
    own = F.when(~known, F.col("rec_no"))
    rows = feed.where(plain_op(F.col("msg_type")) == "dml").groupBy("stream_key", "seq_no", own.alias("_own"))
    return rows.agg(F.min_by(F.struct(*feed.columns), "rec_no").alias("_m")).select("_m.*")


def path_values(df: DataFrame) -> DataFrame:
    """Adds ``paths``: array of (field, kind, value as text) with kind i (integer), f (number
    with fraction), t (text), b (boolean), o (object or array) or empty (null,
    or a version that writes every value as text)."""
    raw, var = F.from_json("data_json", "map<string,string>"), F.map_values(F.from_json("data_json", "map<string,variant>"))
    # by the first letters of a value's type; numbers are told apart by their text
    kinds = F.create_map(*[F.lit(x) for pair in {"VOI": "", "STR": "t", "BOO": "b", "OBJ": "o", "ARR": "o"}.items() for x in pair])

    def kind(v: Column, text: Column) -> Column:
        code = F.coalesce(F.try_element_at(kinds, F.substring(F.schema_of_variant(v), 1, 3)), F.when(v.isNotNull(), "n"), F.lit(""))
        return F.when(text.rlike("^[-+0-9.]*[.eE]"), F.replace(code, F.lit("n"), F.lit("f"))).otherwise(F.replace(code, F.lit("n"), F.lit("i")))

    each = F.transform(F.map_entries(F.col("_raw")), lambda e, i: F.struct(F.lower(F.btrim(e["key"])).alias("field"), F.when(F.col("_typed"), kind(F.get("_var", i), e["value"])).otherwise("").alias("kind"), e["value"].alias("value")))
    read = df.withColumns({"_typed": F.col("typed"), "_raw": raw, "_var": F.when(F.col("typed"), var)})
    return read.withColumn("paths", F.coalesce(each, F.array().cast("array<struct<field:string,kind:string,value:string>>"))).drop("_raw", "_var", "_typed")


_SEQS = "1" + "0" * 19


def place(ts: Column, seq: Column) -> Column:
    """(ts, seq) as one number in the same order, which aggregates without sorting; a null seq is 0."""
    return (F.coalesce(ts, F.lit(0)).cast("decimal(19,0)") * F.lit(_SEQS).cast("decimal(20,0)") + F.coalesce(seq, F.lit(0))).cast("decimal(38,0)")


def _unplace(n) -> tuple[int, int]:
    return divmod(int(n), 10**19)


def file_statistics(placed: DataFrame) -> DataFrame:
    """Path-kind statistics by file, table and epoch: first and last place and
    count.  The empty field stands for the message itself."""
    whole = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("value")))
    rows = path_values(placed).select("src_file", "db", "tbl", "inst", "e_ts", "e_seq", place(F.col("ts"), F.col("seq")).alias("at"), F.explode(F.concat(whole, "paths")).alias("_p"))
    return rows.groupBy("src_file", "db", "tbl", "inst", "e_ts", "e_seq", F.col("_p.field").alias("field"), F.col("_p.kind").alias("kind")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))


def kinds_by_file(feed: DataFrame) -> DataFrame:
    """(src_file, db, tbl, field, kind, n): how often each file carries each
    field with which JSON kind."""
    named = feed.where("db is not null and tbl is not null")
    rows = path_values(images(named)).select("src_file", "db", "tbl", F.explode("paths").alias("_p"))
    return rows.groupBy("src_file", "db", "tbl", F.col("_p.field").alias("field"), F.col("_p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def failed_casts(feed: DataFrame) -> DataFrame:
    """(db, tbl, field, kind, n, failed): the values of each field cast to the
    kind most of its typed values have (see typed_columns: integers without
    fraction, numbers, booleans, objects or arrays, text), with the number of
    casts that fail.  Values of the version that writes
    text are cast like the others."""
    named = feed.where("db is not null and tbl is not null")
    kinds = kinds_by_file(named).where("kind <> ''").groupBy("db", "tbl", "field", "kind").agg(F.sum("n").alias("n"))
    best = kinds.groupBy("db", "tbl", "field").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    raw = images(named).select("db", "tbl", F.explode(F.map_entries(F.from_json("data_json", "map<string,string>"))).alias("_e")).select("db", "tbl", F.lower(F.btrim("_e.key")).alias("field"), F.col("_e.value").alias("value"))
    # equal values are counted before they meet their kind
    counted = raw.where("value is not null").groupBy("db", "tbl", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    bad = F.coalesce(*[c.cast("string") for c in typed_columns(F.col("kind"), F.col("value")).values()]).isNull()
    return counted.join(best, ["db", "tbl", "field"]).groupBy("db", "tbl", "field", "kind").agg(F.sum("n").alias("n"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("failed"))


_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def typed_columns(kind: Column, value: Column) -> dict[str, Column]:
    """The value cast to the type of its kind, in the column of that type; null where the cast fails."""
    exact = F.when(value.rlike(_NUMBER), value.try_cast("decimal(38,18)"))
    whole, parsed = exact.try_cast("decimal(20,0)"), F.try_parse_json(value)
    shape = F.schema_of_variant(parsed)
    return {
        "as_int": F.when((kind == "i") & (exact == whole), whole),
        "as_decimal": F.when(kind == "f", exact),
        "as_double": F.when((kind == "f") & value.rlike(_NUMBER), value.try_cast("double")),
        "as_boolean": F.when(kind == "b", value.try_cast("boolean")),
        "as_json": F.when((kind == "o") & (shape.startswith("OBJECT") | shape.startswith("ARRAY")), value),
        "as_text": F.when(kind == "t", value),
    }


def consistent_rows(feed: DataFrame) -> DataFrame:
    """(db, tbl, id, event_ts, field, value, kind, as_int, as_decimal,
    as_double, as_boolean, as_json, as_text, failed): everything in one set of
    rows with the newest field and table names, repeated deliveries once.
    A message's fields are those its table had at its time, so a name that was
    given up and given again names two fields, each with its own newest name.
    ``kind`` is the one most typed values of the newest field have (text, if
    none is typed); the value is cast to its type in the column of that type,
    and ``failed`` tells that it doesn't fit."""
    h = history(feed)
    lives, tables = newest_fields(h)
    named = once(feed.where("db is not null and tbl is not null"))
    placed = _rooted(_place(images(named), h.events, h.small), h.links)
    rows = path_values(placed).select("root", "db", "tbl", "ts", place(F.col("ts"), F.col("seq")).alias("at"), F.get_json_object("data_json", "$.id").alias("id"), F.explode("paths").alias("_p"))
    flat = rows.select("root", "db", "tbl", "id", "ts", "at", "_p.*").join(lives, ["root", "field"], "left").join(tables, "root", "left")
    now = F.try_element_at(F.filter(F.coalesce("_lives", F.array().cast("array<struct<at:decimal(38,0),newest:string>>")), lambda x: x["at"] <= F.col("at")), F.lit(-1))
    flat = cut(flat.select(F.coalesce("_db", "db").alias("db"), F.coalesce("_tbl", "tbl").alias("tbl"), "id", "ts", F.coalesce(now["newest"], "field").alias("field"), F.col("kind").alias("_kind"), "value"))
    kinds = flat.where("_kind <> ''").groupBy("db", "tbl", "field", "_kind").agg(F.count(F.lit(1)).alias("n"))
    best = kinds.groupBy("db", "tbl", "field").agg(F.max_by("_kind", F.struct("n", "_kind")).alias("kind"))
    cast = flat.drop("_kind").join(best, ["db", "tbl", "field"], "left").withColumn("kind", F.coalesce("kind", F.lit("t")))
    typed = typed_columns(F.col("kind"), F.col("value"))
    # a decimal out of range still has its double
    fits = F.coalesce(*[F.col(c).cast("string") for c in typed]).isNotNull()
    out = cast.withColumns(typed)
    return out.select("db", "tbl", "id", from_micros(F.col("ts")).alias("event_ts"), "field", "value", "kind", *typed, (F.col("value").isNotNull() & ~fits).alias("failed"))


def newest_fields(h: "History") -> tuple[DataFrame, DataFrame]:
    """(root, field, _lives) with the newest name of each field a table ever
    had, by the place from which it bore the name, and (root, _db, _tbl) with
    the newest name of each table.  Fields whose renames only messages show
    are followed from life to life by pointer jumping; lives follow in time,
    so no field comes back to itself."""
    life = h.found.where("kind = 'life'").select("root", "life", "field", F.col("new_name").alias("newest"), place(F.col("ts"), F.col("seq")).alias("at"))
    ends = h.found.where("silent and kind in ('added', 'removed')").select("root", "kind", "field", "life")
    went = ends.where("kind = 'removed'").select("root", "field", "life")
    came = ends.where("kind = 'added'").select("root", F.col("field").alias("new_name"), F.col("life").alias("into"))
    links = cut(h.renames.select("root", "field", "new_name").join(went, ["root", "field"]).join(came, ["root", "new_name"]).where("life < into").groupBy("root", "life").agg(F.min("into").alias("into")))
    while True:
        up = links.select("root", F.col("life").alias("into"), F.col("into").alias("_up"))
        jumped = cut(links.join(up, ["root", "into"], "left").select("root", "life", F.coalesce("_up", "into").alias("into"), F.col("_up").isNotNull().alias("_moved")))
        links = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            break
    last = life.groupBy("root", F.col("life").alias("into")).agg(F.max("newest").alias("_last"))
    ended = links.join(last, ["root", "into"]).select("root", "life", "_last")
    named = life.join(ended, ["root", "life"], "left").select("root", "field", F.struct("at", F.coalesce("_last", "newest").alias("newest")).alias("_l"))
    lives = named.groupBy("root", "field").agg(F.array_sort(F.collect_list("_l")).alias("_lives"))
    tables = h.found.where("kind = 'table'").select("root", F.col("db").alias("_db"), F.col("tbl").alias("_tbl"))
    return cut(lives), cut(tables)


def row_casts(rows: DataFrame) -> DataFrame:
    """(db, tbl, field, kind, n, failed): the casts of consistent_rows by newest
    field, and how many failed."""
    return rows.where("value is not null").groupBy("db", "tbl", "field", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("bigint")).alias("failed"))


def _node(db: str = "db", tbl: str = "tbl", inst: str = "inst") -> Column:
    return F.concat_ws("\x01", db, tbl, F.col(inst).cast("string"))


def lineages(acts: DataFrame, events: DataFrame, small: bool) -> DataFrame:
    """(node, root) for each name that a rename gave to a table, by pointer
    jumping; names that begin with CREATE are their own root."""
    ren = acts.where("kind = 'rename_table'").select("db", "tbl", "ts", "seq", "new_db", "new_name")
    before = _place(ren.withColumn("seq", F.col("seq") - 1), events, small).withColumn("seq", F.col("seq") + 1).select(_node().alias("root"), F.col("new_db").alias("db"), F.col("new_name").alias("tbl"), "ts", "seq")
    # each rename makes a new bearer of the name, so no chain comes back to itself
    links = cut(_place(before, events, small).select(_node().alias("node"), "root").where("node <> root").dropDuplicates(["node"]))
    while True:
        up = links.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = cut(links.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        links = jumped.select("node", "root")
        if jumped.where("_moved").isEmpty():
            break
    return links


# JSON kinds in which a change feed writes MySQL types; all others are text.
_KIND_OF = {"tinyint": "i", "smallint": "i", "mediumint": "i", "int": "i", "integer": "i", "bigint": "i", "year": "i", "bit": "i", "decimal": "f", "numeric": "f", "float": "f", "double": "f", "real": "f", "json": "o"}

_FOUND = "root string, db string, tbl string, kind string, field string, new_name string, silent boolean, ts bigint, seq bigint, life bigint"
_FOUND_ARROW = pa.schema([("root", pa.string()), ("db", pa.string()), ("tbl", pa.string()), ("kind", pa.string()), ("field", pa.string()), ("new_name", pa.string()), ("silent", pa.bool_()), ("ts", pa.int64()), ("seq", pa.int64()), ("life", pa.int64())])


_EVER = (-(2**62), 0)


class _Field:
    __slots__ = ("type", "kind", "due", "last", "gone", "life", "names")

    def __init__(self, life: int, name: str, at: tuple = _EVER, type_word: str = ""):
        self.type, self.kind, self.due, self.last, self.gone = type_word, "", "", None, None
        self.life, self.names = life, [(name, at)]


class SchemaMachine:
    """The schema of one lineage, fed with statements and epoch statistics in
    order.  Each field is a life, numbered as they begin, with its names."""

    def __init__(self):
        self.fields: dict[str, _Field] = {}
        self.known = False
        self.epoch: dict = {}
        self.name = None
        self.table = None
        self.lives = 0
        self.out: list = []

    def tell(self, kind, field, new, silent, at, life=None):
        self.out.append((*self.name, kind, field, new, silent, at[0], at[1], life))

    def begin(self, name, at=_EVER, type_word=""):
        self.lives += 1
        self.fields[name] = _Field(self.lives, name, at, type_word)
        return self.lives

    def end(self, name):
        state = self.fields.pop(name)
        for n, at in state.names:
            self.tell("life", n, state.names[-1][0], False, at, state.life)
        return state

    def observe(self, name, field, kind, first, last):
        self.name = self.table = name
        self.epoch.setdefault(field, []).append((first, last, kind))

    def settle(self):
        """Closes an epoch: what its messages show against the schema."""
        seen, self.epoch = self.epoch, {}
        if "" not in seen:
            return
        messages_last = max(x[1] for x in seen.pop(""))
        for f, spans in sorted(seen.items(), key=lambda x: min(s[0] for s in x[1])):
            first, last = min(s[0] for s in spans), max(s[1] for s in spans)
            if f not in self.fields:
                life = self.begin(f, first if self.known else _EVER)
                if self.known:
                    self.tell("added", f, "", True, first, life)
            state = self.fields[f]
            state.last, state.gone = last, None
            for start, _, k in sorted(s for s in spans if s[2]):
                if state.kind and k != state.kind and k != state.due:
                    self.tell("retyped", f, "", True, start)
                if k != state.kind:
                    state.due = ""
                state.kind = k
        self.known = True
        for state in self.fields.values():
            if (state.last is None or state.last < messages_last) and state.gone is None:
                state.gone = self.name

    def vanish(self, f):
        """A field that no message has carried since is removed without a statement."""
        state = self.end(f)
        self.out.append((*state.gone, "removed", f, "", True, *(state.last or (-(2**62), 0)), state.life))

    def retype(self, f, type_word, at):
        state = self.fields[f]
        if type_word and state.type and type_word != state.type:
            self.tell("retyped", f, "", False, at)
            state.kind, state.due = "", _KIND_OF.get(type_word, "t")
        state.type = type_word or state.type

    def statement(self, name, at, a, field, new, type_word, columns, new_db):
        self.settle()
        self.name = self.table = name
        if a == "create":
            if not self.fields:
                for c in json.loads(columns) if columns else []:
                    self.begin(c[0], type_word=c[1])
                self.known = columns is not None
        elif a == "add":
            if field in self.fields and self.fields[field].gone and self.fields[field].last is not None:
                self.vanish(field)
            if field not in self.fields:
                self.tell("added", field, "", False, at)
                self.begin(field, at, type_word)
        elif a == "drop":
            if field in self.fields:
                self.end(field)
                self.tell("removed", field, "", False, at)
        elif a == "modify":
            if field in self.fields:
                self.retype(field, type_word, at)
        elif a == "change":
            if field in self.fields:
                self.retype(field, type_word, at)
                if new != field:
                    self.tell("renamed", field, new, False, at)
                    if new in self.fields:
                        self.end(new)
                    self.fields[new] = self.fields.pop(field)
                    self.fields[new].names.append((new, at))
        elif a == "rename_table":
            self.tell("table_renamed", "", new, False, at)
            self.table = (new_db or name[0], new)

    def close(self):
        self.settle()
        for f in [f for f, s in self.fields.items() if s.gone and s.last is not None]:
            self.vanish(f)
        for f in list(self.fields):
            self.end(f)
        self.out.append((*(self.table or self.name), "table", "", "", False, 0, 0, None))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root, machine, out = None, None, []

    def flush():
        rows = list(zip(*out)) if out else [[] for _ in _FOUND_ARROW]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(rows, _FOUND_ARROW)], schema=_FOUND_ARROW)

    def close():
        if machine is not None:
            machine.close()
            out.extend((root, *r) for r in machine.out)

    epoch = None
    for batch in batches:
        for r_root, db, tbl, ts, seq, stat, a, field, new, type_word, columns, new_db, kind, first, last in zip(*[c.to_pylist() for c in batch.columns]):
            if r_root != root:
                close()
                root, machine, epoch = r_root, SchemaMachine(), None
            if stat:
                if epoch != (ts, seq, db, tbl):
                    machine.settle()
                    epoch = (ts, seq, db, tbl)
                machine.observe((db, tbl), field, kind, _unplace(first), _unplace(last))
            else:
                machine.statement((db, tbl), (ts, seq), a, field, new, type_word, columns, new_db)
            if len(machine.out) > 4096:
                out.extend((root, *r) for r in machine.out)
                machine.out.clear()
        if len(out) > 4096:
            yield flush()
    close()
    yield flush()


class History(NamedTuple):
    """What a feed tells of its tables: epochs of names, lineages (node, root),
    ``found`` (changes as statements and messages show them, lives of fields,
    newest table names) and ``renames`` without a statement."""

    events: DataFrame
    small: bool
    links: DataFrame
    found: DataFrame
    renames: DataFrame


def _rooted(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Adds the lineage each message belongs to."""
    return placed.withColumn("node", _node()).join(links, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def history(feed: DataFrame, id_field: str = "id", broadcast_events: int = BROADCAST_EVENTS) -> History:
    named = feed.where("db is not null and tbl is not null")
    acts = cut(statements(named))
    events = cut(name_events(acts))
    most = events.groupBy("db", "tbl").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    small = most[0] <= broadcast_events and most[1] <= LISTED_EVENTS
    links = lineages(acts, events, small)
    placed = _place(images(named), events, small)
    by_file = file_statistics(placed)
    stats = by_file.groupBy("db", "tbl", "inst", "e_ts", "e_seq", "field", "kind").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # a rename acts on the table that bore the old name before it
    acted = _place(acts, events, small)
    none = F.lit(None).cast("string")
    at = F.lit(None).cast("decimal(38,0)")
    rows = acted.select(_node().alias("node"), "db", "tbl", "ts", "seq", F.lit(0).alias("stat"), "pos", F.col("kind").alias("a"), "field", "new_name", "type_word", "columns", "new_db", none.alias("kind"), at.alias("first"), at.alias("last"))
    rows = rows.unionByName(stats.select(_node().alias("node"), "db", "tbl", F.col("e_ts").alias("ts"), F.col("e_seq").alias("seq"), F.lit(1).alias("stat"), F.lit(0).alias("pos"), none.alias("a"), "field", none.alias("new_name"), none.alias("type_word"), none.alias("columns"), none.alias("new_db"), "kind", "first", "last"))
    rooted = rows.join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ordered = rooted.repartition("root").sortWithinPartitions("root", "ts", "seq", "stat", "pos", "first", "field")
    found = cut(ordered.select("root", "db", "tbl", "ts", "seq", "stat", "a", "field", "new_name", "type_word", "columns", "new_db", "kind", "first", "last").mapInArrow(_fold, _FOUND))
    return History(events, small, links, found, cut(_silent_renames(found, placed, links, id_field)))


def schema_changes(feed: DataFrame, id_field: str = "id", broadcast_events: int = BROADCAST_EVENTS) -> DataFrame:
    """``db, tbl, kind, field, new_name``: every change of a field or table
    name after CREATE TABLE, told by a statement or, without one, by messages.

    Rows without db or tbl name no table and are left out; null statements and
    bodies, malformed JSON and unreadable SQL change nothing; repeated
    deliveries count once.  A table without CREATE starts with the fields of
    its first epoch.  An empty feed gives no rows.
    """
    h = history(feed, id_field, broadcast_events)
    gone = h.renames.select("root", F.col("field").alias("field"), F.lit("removed").alias("kind")).unionByName(h.renames.select("root", F.col("new_name").alias("field"), F.lit("added").alias("kind"))).withColumn("silent", F.lit(True))
    rest = h.found.where("kind not in ('life', 'table')").join(gone, ["root", "kind", "field", "silent"], "left_anti")
    return rest.select("db", "tbl", "kind", "field", "new_name").unionByName(h.renames.select("db", "tbl", F.lit("renamed").alias("kind"), "field", "new_name")).distinct()


def _silent_renames(found: DataFrame, placed: DataFrame, links: DataFrame, id_field: str) -> DataFrame:
    """(root, db, tbl, field, new_name) of fields that go in the message in
    which another comes, ids keeping their values.  Only the first field that
    comes after a field's last message can be its new name."""
    at = F.struct("ts", "seq")
    added = found.where("silent and kind = 'added'").select("root", "db", "tbl", F.col("field").alias("g"), at.alias("g_first"))
    ends = found.where("silent and kind in ('added', 'removed')").select("root", F.col("field").alias("f"), at.alias("f_last"), (F.col("kind") == "added").alias("_comes"))
    # from the latest on, the last one that came is the nearest that comes after
    later = Window.partitionBy("root").orderBy(F.desc("f_last"), "_comes").rowsBetween(Window.unboundedPreceding, 0)
    nearest = ends.withColumn("g_first", F.last(F.when(F.col("_comes"), F.col("f_last")), ignorenulls=True).over(later))
    removed = nearest.where("not _comes and g_first is not null").select("root", "f", "f_last", "g_first")
    pairs = cut(removed.join(added, ["root", "g_first"]))
    tables = pairs.select("root", "f", "g", "f_last", "g_first")
    messages = _rooted(placed, links).join(tables.select("root").distinct(), "root", "left_semi")
    low = F.from_json(F.lower("data_json"), "map<string,string>")
    values = messages.select("root", F.struct("ts", "seq").alias("at"), low.alias("m"))
    plain = lambda name: F.regexp_replace(F.regexp_replace(F.col("m")[F.col(name)], r"(\d)t(\d)", "$1 $2"), r"(\d)z$", "$1")
    each = values.join(tables, "root").select(
        "root", "f", "g", "g_first", "at", F.col("m")[F.lit(id_field)].alias("id"), F.col("f_last"), F.when(F.col("at") <= F.col("f_last"), plain("f")).alias("v_f"), F.when(F.col("at") >= F.col("g_first"), plain("g")).alias("v_g")
    )
    per_id = each.groupBy("root", "f", "g", "g_first", "id").agg(
        F.max_by("v_f", F.when(F.col("v_f").isNotNull(), F.col("at"))).alias("before"),
        F.min_by("v_g", F.when(F.col("v_g").isNotNull(), F.col("at"))).alias("after"),
        F.min(F.when(F.col("at") > F.col("f_last"), F.col("at"))).alias("next"),
    )
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    judged = per_id.groupBy("root", "f", "g", "g_first").agg(F.sum(F.when(both, 1).otherwise(0)).alias("n"), F.sum(F.when(both & (F.col("before") == F.col("after")), 1).otherwise(0)).alias("kept"), F.min("next").alias("next"))
    good = judged.where((F.col("next") == F.col("g_first")) & (F.col("kept") >= 1) & (F.col("kept") >= KEPT_SHARE * F.col("n")))
    rank = lambda *by: F.row_number().over(Window.partitionBy("root", *by).orderBy(F.desc("kept"), "f", "g"))
    left, best = cut(good.select("root", "f", "g", "kept")), None
    while True:
        # fields that lose a name to a better pair may still find another
        mutual = cut(left.withColumns({"_1": rank("f"), "_2": rank("g")}).where("_1 = 1 and _2 = 1").select("root", "f", "g"))
        best = mutual if best is None else best.unionByName(mutual)
        left = cut(left.join(mutual.select("root", "f"), ["root", "f"], "left_anti").join(mutual.select("root", "g"), ["root", "g"], "left_anti"))
        if left.isEmpty():
            return best.join(pairs, ["root", "f", "g"]).select("root", "db", "tbl", F.col("f").alias("field"), F.col("g").alias("new_name"))
