"""Queries of the general problems on their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.names import key_entries, key_text, plain_name, plain_op
from driftline.functions.times import micros
from driftline.operators import dedup, inlining, replay, schema_drift, skew, table_diff
from driftline.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that exist after all messages of change_feed."""
    return replay.current_rows(table(spark, d, "change_feed"))


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same rows with their values, updates setting the columns they carry."""
    return replay.current_rows(table(spark, d, "change_feed"), with_image=True)


def _named(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "change_feed")
    return feed.where(plain_op(F.col("msg_type")) == "dml").withColumns({"db": plain_name(F.col("db")), "tbl": plain_name(F.col("tbl"))})


HOT_SHARE = 0.04


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Tables that hold at least 4 % of all dml rows of change_feed."""
    vf = skew.value_frequencies(_named(spark, d).select("db", "tbl", "event_ts"), ["db", "tbl"], F.to_date("event_ts"))
    per = skew.from_frequencies(vf, ["db", "tbl"])
    total = table(spark, d, "change_feed").where(plain_op(F.col("msg_type")) == "dml").agg(F.count(F.lit(1)))
    return per.where(F.col("n_rows") >= HOT_SHARE * total.scalar()).where("db is not null and tbl is not null").select("db", "tbl")


def p6_table_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per table: messages, latest event, distinct keys and the key changed most often."""
    named = _named(spark, d).select("db", "tbl", "event_ts", "pks_json")
    keyed = named.select("db", "tbl", F.col("event_ts").alias("_at"), "pks_json").groupBy("db", "tbl", "pks_json").agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("_at"))
    vf = keyed.select("db", "tbl", key_text(key_entries(F.col("pks_json"))).alias("value"), "n", "_at").groupBy("db", "tbl", "value").agg(F.sum("n").alias("n"), F.max("_at").alias("_at"))
    per = skew.from_frequencies(vf, ["db", "tbl"], F.max("_at").alias("latest_ts"))
    return per.select("db", "tbl", F.col("n_rows").cast("bigint").alias("n_messages"), "latest_ts", "n_distinct", F.col("mode").alias("hot_pk"), F.col("mode_n").cast("bigint").alias("hot_pk_messages"))


def p6_delay_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per table: exact 50th, 90th and 99th percentile of the delivery delay in seconds."""
    named = _named(spark, d).select("db", "tbl", (micros("recv_ts") - micros("event_ts")).alias("delay"))
    vf = skew.value_frequencies(named, ["db", "tbl"], F.floor(F.col("delay") / 1_000_000).cast("bigint"))
    return skew.weighted_percentiles(vf, ["db", "tbl"], [0.5, 0.9, 0.99]).select("db", "tbl", "p", F.col("value").alias("delay_s"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field or table name in schema_feed."""
    return schema_drift.schema_changes(table(spark, d, "schema_feed"))


def p2_kinds_by_file(spark: SparkSession, d: str) -> DataFrame:
    """How often each file carries each field with which JSON kind."""
    return schema_drift.kinds_by_file(table(spark, d, "schema_feed"))


def p2_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    """Values that don't fit the kind most values of their field have."""
    return schema_drift.failed_casts(table(spark, d, "schema_feed"))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows of schema_feed under the newest names."""
    return schema_drift.consistent_rows(table(spark, d, "schema_feed"))


def p2_row_casts(spark: SparkSession, d: str) -> DataFrame:
    """The casts of p2_rows by newest field, and how many failed."""
    return schema_drift.row_casts(p2_rows(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of dcp_messages that are later copies of another record."""
    m = table(spark, d, "dcp_messages")
    return dedup.repeated_records(m, "rec_no", F.col("msg_id"), F.col("msg_tag"), F.col("msg_time")).select("rec_no")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """dcp_messages with exactly one copy of each message."""
    m = table(spark, d, "dcp_messages")
    return m.join(p3_found(spark, d), "rec_no", "left_anti").select("rec_no", "msg_id", "msg_tag", "payload_id", "msg_time")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows and fields in which dcp_source and dcp_target differ."""
    return table_diff.table_differences(table(spark, d, "dcp_source"), table(spark, d, "dcp_target"))


def _students(spark: SparkSession, d: str) -> DataFrame:
    """The document of each insert (data_json) and update (row_json)."""
    ops = table(spark, d, "oplog_ops")
    op = plain_op(F.col("operation"))
    return ops.select("op_no", "obj_id", F.when(op == "i", F.col("data_json")).when(op == "u", F.col("row_json")).alias("doc"))


STUDENT_TABLES = [
    "student_parent",
    "student_parent.phones",
    "student_class",
    "student_class.terms",
    "student_class.terms.marks",
    "student_class.terms.marks.remarks",
    "student_detail.awards",
]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object in an array of the student documents with its place."""
    docs = _students(spark, d)
    graph = inlining.schema_graph(docs, F.col("doc"))
    rows = inlining.child_rows(docs, ["op_no"], F.col("doc"), graph, [tuple(t.split(".")) for t in STUDENT_TABLES])
    return rows.select("op_no", F.col("path").alias("child_path"), F.col("index").alias("child_index"))


def _student_table(name: str, path: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _students(spark, d)
        graph = inlining.schema_graph(docs, F.col("doc"))
        return inlining.flat_table(docs, ["op_no"], F.col("doc"), graph, path)

    run.__name__ = name
    run.__doc__ = f"The flat table of {path or 'students with all singleton parts inlined'}, tied to its parent by parent_path and parent_index."
    return run


FLAT_TABLES = {"p5_students": "", "p5_parents": "student_parent", "p5_phones": "student_parent.phones", "p5_classes": "student_class", "p5_terms": "student_class.terms", "p5_marks": "student_class.terms.marks", "p5_remarks": "student_class.terms.marks.remarks", "p5_awards": "student_detail.awards"}


QUERIES = {f.__name__: f for f in (p1_found, p1_rows, p6_found, p6_table_stats, p6_delay_percentiles, p2_found, p2_kinds_by_file, p2_failed_casts, p2_rows, p2_row_casts, p3_found, p3_kept, p4_found, p5_found)}
QUERIES |= {n: _student_table(n, path) for n, path in FLAT_TABLES.items()}

_NAMES = "lower(trim(replace(trim(db), '`', ''))) as db, lower(trim(replace(trim(tbl), '`', ''))) as tbl"

_COPIES = r"""
    with f as (
      select rec_no, msg_id, msg_tag, payload_id, msg_time,
             regexp_extract(lower(msg_id), '([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})[^0-9a-f]*:[ \t\n]*0*([0-9]+)', 1) as u,
             regexp_extract(lower(msg_id), '([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})[^0-9a-f]*:[ \t\n]*0*([0-9]+)', 2) as n
      from dcp_messages
    ), r as (
      select *, case when u <> '' then row_number() over (partition by msg_tag, replace(u, '-', ''), n order by msg_time nulls last, rec_no) else 1 end as rn from f
    )
"""

_VALUE = """
      case json_type(j, '$."' || k || '"')
        when 'NULL' then null
        when 'VARCHAR' then case
          when v like '0000-00-00%' then 'z' || replace(replace(v, 'T', ' '), 'Z', '')
          when regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?Z?$')
            then 't' || epoch_us(cast(replace(replace(v, 'T', ' '), 'Z', '') as timestamp))
          else 's' || v end
        when 'BOOLEAN' then 'b' || v
        when 'OBJECT' then 'j' || v
        when 'ARRAY' then 'j' || v
        else 'n' || cast(cast(v as decimal(38,15)) as varchar) end
"""


def _held(side: str, name: str) -> str:
    return f"""
    {name} as (
      select tbl, payload_id, substr(payload_content, strpos(payload_content, ' ') + 1) as j from (
        select *, row_number() over (partition by tbl, payload_id order by msg_time desc nulls last, rec_no desc) as rn from {side}
      ) where rn = 1 and split_part(payload_content, ' ', 1) <> 'DELETE'
    ),
    {name}_cells as (
      select * from (
        select tbl, payload_id, k as field, {_VALUE} as value from (
          select tbl, payload_id, j, k, json_extract_string(j, '$."' || k || '"') as v from (select tbl, payload_id, j, unnest(json_keys(j)) as k from {name})
        )
      ) where value is not null
    )"""


def _part(x: str, field: str) -> str:
    at = f"'$.{field}'"
    return f"case when json_type({x}, {at}) = 'VARCHAR' then json_extract_string({x}, {at}) else json_extract({x}, {at}) end"


def _child_ctes() -> str:
    """One relation (op_no, idx, obj) for each student table, named by its path."""
    ctes = ["docs as (select op_no, case operation when 'i' then data_json else row_json end as obj, '' as idx from oplog_ops where operation in ('i', 'u'))", f"details as (select op_no, {_part('obj', 'student_detail')} as obj, '' as idx from docs where obj is not null)"]
    for path in STUDENT_TABLES:
        parent, _, field = path.rpartition(".")
        name = path.replace(".", "_")
        above = {"": "docs", "student_detail": "details"}.get(parent, parent.replace(".", "_"))
        ctes.append(f"""
          {name}_parts as (select op_no, idx, {_part('obj', field)} as x from {above} where obj is not null),
          {name}_kinds as (select op_no, idx, x, json_type(x) as t from {name}_parts where x is not null),
          {name}_each as (select op_no, idx, x, t, unnest(range(0, case t when 'ARRAY' then cast(json_array_length(x) as bigint) when 'OBJECT' then 1 else 0 end)) as i from {name}_kinds),
          {name}_elements as (select op_no, case when idx = '' then '' else idx || '.' end || i as idx, case t when 'ARRAY' then {_part('x', '').replace("'$.'", "'$[' || i || ']'")} else x end as obj from {name}_each),
          {name} as (select op_no, idx, obj from {name}_elements where obj is not null and json_type(obj) = 'OBJECT')""")
    return "with " + ",".join(ctes)


def _child_sql() -> str:
    return _child_ctes() + " union all ".join(f" select op_no, '{p}' as child_path, idx as child_index from {p.replace('.', '_')}" for p in STUDENT_TABLES)


def _text(x: str, *steps: str) -> str:
    for s in steps[:-1]:
        x = _part(x, s)
    return f"json_extract_string({x}, '$.{steps[-1]}')"


# columns of each student table as its SQL reads them from obj
_FLAT_COLUMNS = {
    "": {
        "_id_oid": """json_extract_string(obj, '$._id."$oid"')""",
        "address_city": _text("obj", "address", "city"),
        "address_geo_lat": f"cast({_text('obj', 'address', 'geo', 'lat')} as double)",
        "address_geo_lon": f"cast({_text('obj', 'address', 'geo', 'lon')} as double)",
        "address_street": _text("obj", "address", "street"),
        "birthday_date": """json_extract_string(obj, '$.birthday."$date"')""",
        "name": _text("obj", "name"),
        "student_detail_hobbies": _text("obj", "student_detail", "hobbies"),
        "student_detail_introduce": _text("obj", "student_detail", "introduce"),
    },
    "student_parent": {"name": _text("obj", "name"), "relation": _text("obj", "relation")},
    "student_parent.phones": {"kind": _text("obj", "kind"), "no": _text("obj", "no")},
    "student_class": {"name": _text("obj", "name"), "teacher_name": _text("obj", "teacher", "name"), "teacher_rooms": _text("obj", "teacher", "rooms")},
    "student_class.terms": {"term": _text("obj", "term")},
    "student_class.terms.marks": {"score": f"cast({_text('obj', 'score')} as bigint)", "subject": _text("obj", "subject")},
    "student_class.terms.marks.remarks": {"by": _text("obj", "by"), "text": _text("obj", "text")},
    "student_detail.awards": {"title": _text("obj", "title"), "year": f"cast({_text('obj', 'year')} as bigint)"},
}


def _flat_sql(path: str) -> str:
    columns = ", ".join(f'{x} as "{c}"' for c, x in _FLAT_COLUMNS[path].items())
    if not path:
        return f"{_child_ctes()} select op_no, {columns} from docs where obj is not null"
    parent = path.rpartition(".")[0]
    parent = parent if parent in STUDENT_TABLES else ""
    return f"{_child_ctes()} select op_no, '{path}' as path, idx as index, '{parent}' as parent_path, regexp_replace(idx, '[.]?[0-9]+$', '') as parent_index, {columns} from {path.replace('.', '_')}"


SQL: dict[str, str] = {
    "p4_found": f"""
      with {_held('dcp_source', 's')}, {_held('dcp_target', 't')}
      select s.tbl, s.payload_id, 'missing_in_target' as kind, '' as field from s left join t on s.tbl = t.tbl and s.payload_id = t.payload_id where t.tbl is null
      union all
      select t.tbl, t.payload_id, 'missing_in_source', '' from t left join s on s.tbl = t.tbl and s.payload_id = t.payload_id where s.tbl is null
      union all
      select coalesce(a.tbl, b.tbl), coalesce(a.payload_id, b.payload_id), 'value_differs', coalesce(a.field, b.field)
      from s_cells a full join t_cells b on a.tbl = b.tbl and a.payload_id = b.payload_id and a.field = b.field
      where a.value is distinct from b.value
        and exists (select 1 from s where s.tbl = coalesce(a.tbl, b.tbl) and s.payload_id = coalesce(a.payload_id, b.payload_id))
        and exists (select 1 from t where t.tbl = coalesce(a.tbl, b.tbl) and t.payload_id = coalesce(a.payload_id, b.payload_id))
    """,
    "p5_found": _child_sql(),
    **{n: _flat_sql(path) for n, path in FLAT_TABLES.items()},
    "p2_kinds_by_file": r"""
      with m as (select src_file, lower(trim(replace(db, '`', ''))) as db, lower(trim(replace(tbl, '`', ''))) as tbl, data_json as j, msg_version <> '0.1' as typed from schema_feed where msg_type = 'dml' and dml_op in ('insert', 'update') and data_json is not null),
      e as (select *, unnest(json_keys(j)) as k from m)
      select src_file, db, tbl, lower(k) as field, case when not typed then '' else case json_type(j, '$."' || k || '"') when 'NULL' then '' when 'VARCHAR' then 't' when 'BOOLEAN' then 'b' when 'OBJECT' then 'o' when 'ARRAY' then 'o' when 'DOUBLE' then 'f' else 'i' end end as kind, count(*) as n
      from e group by 1, 2, 3, 4, 5
    """,
    "p2_failed_casts": r"""
      with m as (select lower(trim(replace(db, '`', ''))) as db, lower(trim(replace(tbl, '`', ''))) as tbl, data_json as j, msg_version <> '0.1' as typed from schema_feed where msg_type = 'dml' and dml_op in ('insert', 'update') and data_json is not null),
      e as (select *, unnest(json_keys(j)) as k from m),
      v as (select db, tbl, lower(k) as field, json_extract_string(j, '$."' || k || '"') as x, case when not typed then '' else case json_type(j, '$."' || k || '"') when 'NULL' then '' when 'VARCHAR' then 't' when 'BOOLEAN' then 'b' when 'OBJECT' then 'o' when 'ARRAY' then 'o' when 'DOUBLE' then 'f' else 'i' end end as kind from e),
      c as (select db, tbl, field, kind, count(*) as n from v where kind <> '' group by all),
      best as (select db, tbl, field, kind from (select *, row_number() over (partition by db, tbl, field order by n desc, kind desc) as rn from c) where rn = 1)
      select v.db, v.tbl, v.field, best.kind, count(*) as n, cast(sum(case when
          best.kind = 't' then 0
          when best.kind = 'b' then case when lower(trim(x)) in ('t', 'true', 'y', 'yes', '1', 'f', 'false', 'n', 'no', '0') then 0 else 1 end
          when best.kind = 'o' then case when json_valid(x) and json_type(case when json_valid(x) then x end) in ('OBJECT', 'ARRAY') then 0 else 1 end
          when not regexp_full_match(x, '\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*') then 1
          when best.kind = 'f' then 0
          else case when try_cast(x as decimal(38, 18)) = floor(try_cast(x as decimal(38, 18))) then 0 else 1 end end) as bigint) as failed
      from v join best on v.db = best.db and v.tbl = best.tbl and v.field = best.field where x is not null group by all
    """,
    "p3_found": _COPIES + " select rec_no from r where rn > 1",
    "p3_kept": _COPIES + " select rec_no, msg_id, msg_tag, payload_id, msg_time from r where rn = 1",
    "p6_found": f"""
        with f as (select {_NAMES} from change_feed where msg_type = 'dml')
        select db, tbl from f group by db, tbl having count(*) >= 0.04 * (select count(*) from f)
    """,
    "p1_found": """
        with f as (
          select lower(trim(replace(db, '`', ''))) as db, lower(trim(replace(tbl, '`', ''))) as tbl, event_ts, seq_no, stream_key,
                 lower(trim(dml_op)) as op, pks_json, old_json,
                 list_sort(json_keys(pks_json)) as ks
          from change_feed where msg_type = 'dml'
        ), k as (
          select db, tbl, event_ts, seq_no, stream_key, op,
                 array_to_string(list_transform(ks, lambda k: json_extract_string(pks_json, '$.' || k)), '|') as pk,
                 case when op = 'update' then array_to_string(list_transform(ks, lambda k: coalesce(json_extract_string(old_json, '$.' || k), json_extract_string(pks_json, '$.' || k))), '|') end as old_pk
          from f
        ), c as (
          select db, tbl, pk, event_ts, seq_no, stream_key, op from k
          union all
          select db, tbl, old_pk, event_ts, seq_no, stream_key, 'delete' from k where old_pk is not null and old_pk <> pk
        ), l as (
          select *, row_number() over (partition by db, tbl, pk order by event_ts desc, seq_no desc, stream_key desc) as rn from c
        )
        select db, tbl, pk, seq_no from l where rn = 1 and op <> 'delete'
    """,
    "p1_rows": """
        with f as (
          select lower(trim(replace(db, '`', ''))) as db, lower(trim(replace(tbl, '`', ''))) as tbl, event_ts, seq_no, stream_key,
                 lower(trim(dml_op)) as op, pks_json, old_json, data_json, list_sort(json_keys(pks_json)) as ks
          from change_feed where msg_type = 'dml'
        ), k as (
          select *, array_to_string(list_transform(ks, lambda k: json_extract_string(pks_json, '$.' || k)), '|') as pk,
                 case when op = 'update' then array_to_string(list_transform(ks, lambda k: coalesce(json_extract_string(old_json, '$.' || k), json_extract_string(pks_json, '$.' || k))), '|') end as old_pk
          from f
        ), c as (
          select db, tbl, pk, event_ts, seq_no, stream_key, case when old_pk is not null and old_pk <> pk then 'insert' else op end as op,
                 data_json as data, case when old_pk is not null and old_pk <> pk then old_json end as prior from k
          union all
          select db, tbl, old_pk, event_ts, seq_no, stream_key, 'delete', null, null from k where old_pk is not null and old_pk <> pk
        ), n as (
          select *, dense_rank() over (partition by db, tbl, pk order by event_ts, seq_no, stream_key) as n from c
        ), z as (
          select *, max(case when op <> 'update' then n else 0 end) over (partition by db, tbl, pk) as reset, max(n) over (partition by db, tbl, pk) as newest from n
        ), live as (select distinct db, tbl, pk, seq_no from z where n = newest and op <> 'delete'),
        e as (
          select db, tbl, pk, 2 * n + 1 as n, data, unnest(json_keys(data)) as col from z where n >= reset and op <> 'delete' and data is not null
          union all
          select db, tbl, pk, 2 * n, prior, unnest(json_keys(prior)) from z where n >= reset and op <> 'delete' and prior is not null
        ),
        x as (select db, tbl, pk, col, n, coalesce(cast(json_extract(data, '$."' || col || '"') as varchar), 'null') as val, max(n) over (partition by db, tbl, pk, col) as top from e),
        v as (select db, tbl, pk, col, min(val) as val from x where n = top group by all),
        i as (select db, tbl, pk, '{' || string_agg('"' || col || '": ' || val, ', ' order by col) || '}' as image from v group by all)
        select l.db, l.tbl, l.pk, l.seq_no, coalesce(i.image, '{}') as image from live l left join i on l.db = i.db and l.tbl = i.tbl and l.pk = i.pk
    """,
    "p6_table_stats": f"""
        with f as (
          select {_NAMES}, event_ts,
                 array_to_string(list_transform(list_sort(json_keys(pks_json)), lambda k: json_extract_string(pks_json, '$.' || k)), '|') as pk
          from change_feed where msg_type = 'dml'
        ), v as (select db, tbl, pk, count(*) as n, max(event_ts) as m from f group by db, tbl, pk),
        r as (select *, row_number() over (partition by db, tbl order by n desc, pk) as rn from v)
        select db, tbl, cast(sum(n) as bigint) as n_messages, max(m) as latest_ts, count(pk) as n_distinct,
               max(case when rn = 1 then pk end) as hot_pk, cast(max(case when rn = 1 then n end) as bigint) as hot_pk_messages
        from r group by db, tbl
    """,
    "p6_delay_percentiles": f"""
        with f as (
          select {_NAMES}, cast(floor((epoch_us(recv_ts) - epoch_us(event_ts)) / 1000000.0) as bigint) as delay from change_feed where msg_type = 'dml'
        ), p as (select 0.5 as p union all select 0.9 union all select 0.99),
        r as (select db, tbl, delay, row_number() over (partition by db, tbl order by delay) as rn, count(*) over (partition by db, tbl) as n from f)
        select r.db, r.tbl, cast(p.p as double) as p, min(r.delay) as delay_s from r, p where r.rn >= ceil(p.p * r.n) group by r.db, r.tbl, p.p
    """,
}
