"""Queries of the change-pipeline operators, each beside its SQL.

The change feed is derived from ``events`` (see sources.feeds); documents come
from customers, nations, regions and orders; verification from lineitem.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import mysql_types, scalar
from driftline.functions.names import plain_name, plain_op
from driftline.functions.retarget import retarget
from driftline.functions.times import micros
from driftline.operators import apply, changes, documents, encode, filters, oplog, ordering, predicates, routing, snapshot, verify
from driftline.session import table
from driftline.sources import sinks
from driftline.sources.feeds import derived_feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FEED = """
  feed as (
    select 'app' as db, 'events_' || (user_id % 4) as tbl, user_id as pk, event_id as seq, user_id % 2 as stream,
           cast(floor(event_id / 8) as bigint) as txn_id, ts as event_ts,
           case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end as op,
           event_type, value, cast(json_extract_string(props, '$.k') as int) as k,
           nullif(cast(json_extract_string(props, '$.k') as int), 0) as uk
    from events
  )
"""


def query(sql: str | None = None):
    """Registers a query; ``{feed}`` in the SQL stands for the derived feed."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.replace("{feed}", FEED)
        return fn

    return add


_LWW = """
  with {feed}, r as (select *, row_number() over (partition by pk order by seq desc) as rn from feed)
  select pk, value, event_type, seq from r where rn = 1 and op <> 'delete'
"""


@query(_LWW)
def cdc_replace_lww(spark, d):
    return apply.replace_rows(derived_feed(spark, d), ["pk"], "seq", ["value", "event_type"]).select("pk", "value", "event_type", "seq")


@query("""
  with {feed}, r as (select *, row_number() over (partition by pk order by seq desc) as rn from feed),
  l as (select pk, uk, value, seq from r where rn = 1 and op <> 'delete')
  select pk, uk, value from l where not exists (
    select 1 from feed o where o.op <> 'delete' and o.seq > l.seq and o.pk <> l.pk and o.uk = l.uk)
""")
def cdc_replace_unique_keys(spark, d):
    return apply.replace_with_unique_keys(derived_feed(spark, d), ["pk"], "seq", ["uk", "value"], [["uk"]]).select("pk", "uk", "value")


@query("""
  with {feed}, g as (select *, sum(case when op = 'delete' then 1 else 0 end) over (partition by pk order by seq) as e,
    sum(case when op = 'delete' then 1 else 0 end) over (partition by pk) as m from feed),
  r as (select *, row_number() over (partition by pk order by seq) as rn from g where e = m and op <> 'delete')
  select pk, value, event_type, seq from r where rn = 1
""")
def cdc_insert_ignore(spark, d):
    return apply.insert_ignore(derived_feed(spark, d), ["pk"], "seq", ["value", "event_type"]).select("pk", "value", "event_type", "seq")


@query("""
  with recursive {feed}, f as (select *, row_number() over (partition by stream order by seq) as rn from feed),
  s as (
    select distinct stream, cast(0 as bigint) as rn, cast([] as struct(pk bigint, uk int, seq bigint)[]) as live from f
    union all
    select s.stream, f.rn, case when f.op = 'delete' then list_filter(s.live, lambda x: x.pk <> f.pk)
      when len(list_filter(s.live, lambda x: x.pk = f.pk or x.uk = f.uk)) > 0 then s.live
      else list_append(s.live, cast({'pk': f.pk, 'uk': f.uk, 'seq': f.seq} as struct(pk bigint, uk int, seq bigint))) end
    from s join f on f.stream = s.stream and f.rn = s.rn + 1
  ), e as (select stream, unnest(live) as r from s where rn = (select max(rn) from f where f.stream = s.stream))
  select e.stream, e.r.pk as pk, e.r.uk as uk, feed.value, e.r.seq as seq from e join feed on feed.seq = e.r.seq
""")
def cdc_insert_ignore_unique(spark, d):
    """Keys and a further unique key, within each stream."""
    rows = apply.insert_ignore_unique(derived_feed(spark, d), ["pk"], "seq", ["value"], ["uk"], ["stream"])
    return rows.select("stream", "pk", "uk", "value", "seq")


@query(_LWW)
def cdc_upsert_single_key(spark, d):
    return apply.upsert_rows(derived_feed(spark, d), ["pk"], "seq", ["value", "event_type"]).select("pk", "value", "event_type", "seq")


@query("""
  with {feed}, b as (select op, lag(op) over (partition by pk order by seq) as b from feed)
  select op, count(*) as n, cast(sum(case when op = 'insert' and b is not null and b <> 'delete' then 1
    when op = 'update' and (b is null or b = 'delete') then 1 else 0 end) as bigint) as conflicts from b group by op
""")
def cdc_conflicts_override(spark, d):
    found = apply.conflicts(derived_feed(spark, d), ["pk"], "seq", F.col("value"))
    return found.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("conflict").cast("bigint")).alias("conflicts"))


@query("""
  with {feed}, b as (select op, pk, k, lag(op) over (partition by pk order by seq) as b, lag(k) over (partition by pk order by seq) as bk, lag(k, 2) over (partition by pk order by seq) as old_k from feed)
  select op, count(*) as n, cast(sum(case when op = 'insert' and b is not null and b <> 'delete' then 1
    when op = 'update' and (b is null or b = 'delete' or bk is distinct from old_k) then 1 else 0 end) as bigint) as conflicts from b group by op
""")
def cdc_conflicts_old_image(spark, d):
    feed = ordering.running(derived_feed(spark, d), ["pk"], ["seq"], F.col("seq"), before=("lag", F.col("k")))
    feed = ordering.running(feed, ["pk"], ["seq"], F.col("seq"), old_k=("lag", F.col("before")))
    found = apply.conflicts(feed, ["pk"], "seq", F.col("k"), F.col("old_k"))
    return found.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("conflict").cast("bigint")).alias("conflicts"))


@query("""
  with recursive {feed}, f as (select op, pk, k as i, lag(k) over (partition by pk order by seq) as o, row_number() over (partition by pk order by seq) as rn from feed),
  s as (
    select pk, rn, op, op = 'update' as conflict, op = 'insert' as there, case when op = 'insert' then i end as v from f where rn = 1
    union all
    select f.pk, f.rn, f.op, case f.op when 'insert' then s.there when 'update' then not s.there or s.v is distinct from f.o else false end,
      case f.op when 'insert' then true when 'update' then s.there else false end,
      case when f.op = 'insert' and not s.there then f.i when f.op = 'update' and s.there and s.v is not distinct from f.o then f.i when f.op = 'delete' then null else s.v end
    from s join f on f.pk = s.pk and f.rn = s.rn + 1
  ) select op, count(*) as n, cast(sum(case when conflict then 1 else 0 end) as bigint) as conflicts from s group by op
""")
def cdc_conflicts_kept(spark, d):
    feed = ordering.running(derived_feed(spark, d), ["pk"], ["seq"], F.col("seq"), old_k=("lag", F.col("k")))
    found = apply.conflicts_kept(feed, ["pk"], "seq", "k", "old_k")
    return found.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("conflict").cast("bigint")).alias("conflicts"))


@query("""
  with {feed}, t as (select c_custkey as pk, cast(c_nationkey as int) as uk, c_acctbal as value from customer where c_nationkey % 2 = 0)
  select f.op, case when (f.op = 'insert') = (t.pk is not null) then 'conflict' else 'ok' end as verdict, count(*) as n
  from feed f left join t on f.pk = t.pk group by 1, 2
""")
def cdc_conflict_preview(spark, d):
    target = table(spark, d, "customer").where(F.pmod("c_nationkey", F.lit(2)) == 0).select(F.col("c_custkey").alias("pk"))
    return apply.conflict_preview(derived_feed(spark, d), target, ["pk"]).groupBy("op", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
  with {feed}, t as (select c_custkey as pk, cast(c_nationkey as int) as uk from customer where c_nationkey % 4 = 0),
  f as (select *, uk as old_uk, case when seq % 2 = 0 then pk + 1 else pk end as old_pk from feed)
  select op, case
      when op = 'insert' then case when exists (select 1 from t where t.pk = f.pk) or exists (select 1 from t where t.uk = f.uk) then 'conflict' else 'ok' end
      when op = 'update' then case when not exists (select 1 from t where t.pk = f.old_pk and t.uk is not distinct from f.old_uk) then 'conflict'
        when (f.pk <> f.old_pk or f.uk is distinct from f.old_uk) and exists (select 1 from t where t.pk = f.pk and t.uk is not distinct from f.uk) then 'conflict' else 'ok' end
      else 'skipped' end as verdict, count(*) as n
  from f group by 1, 2
""")
def cdc_conflict_preview_unique(spark, d):
    """All unique keys count for inserts, old and new image for updates; deletes are off."""
    target = table(spark, d, "customer").where(F.pmod("c_nationkey", F.lit(4)) == 0).select(F.col("c_custkey").alias("pk"), F.col("c_nationkey").cast("int").alias("uk"))
    old = {"pk": F.when(F.pmod("seq", F.lit(2)) == 0, F.col("pk") + 1).otherwise(F.col("pk")), "uk": F.col("uk")}
    found = apply.conflict_preview(derived_feed(spark, d), target, ["pk"], [["uk"]], old, deletes=False)
    return found.groupBy("op", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("with {feed} select c_custkey as pk, c_name from customer where c_custkey not in (select pk from feed where op = 'delete')")
def cdc_delete_by_pk(spark, d):
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("pk"), "c_name")
    return apply.delete_by_key(target, derived_feed(spark, d).where("op = 'delete'"), ["pk"])


@query("""
  with {feed}, a as (select *, case when op = 'delete' or coalesce(lag(op) over (partition by txn_id order by seq) = 'delete', true) then 1 else 0 end as n0 from feed),
  i as (select *, sum(n0) over (partition by txn_id order by seq) as isl from a)
  select txn_id, cast(isl as bigint) as isl, count(*) as n, min(seq) as lo from i group by txn_id, isl
""")
def cdc_batch_split(spark, d):
    isl = changes.batch_islands(derived_feed(spark, d), "seq", ["txn_id"])
    return isl.groupBy("txn_id", F.col("island").cast("bigint").alias("isl")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"))


@query("""
  with {feed}, o as (select *, case when seq % 3 = 0 then pk + 1 else pk end as old_pk, case when seq % 5 = 0 then null else value / 2 end as old_value from feed)
  select seq as event_id, 0 as sub, case when op = 'update' and old_pk <> pk then 'delete' else op end as op,
    case when op = 'update' then old_pk else pk end as pk, case when op = 'update' and old_pk <> pk then old_value else value end as value from o
  union all select seq, 1, 'insert', pk, value from o where op = 'update' and old_pk <> pk
""")
def cdc_pk_change_split(spark, d):
    old = {"pk": F.when(F.pmod("seq", F.lit(3)) == 0, F.col("pk") + 1).otherwise(F.col("pk")), "value": F.when(F.pmod("seq", F.lit(5)) != 0, F.col("value") / 2)}
    return changes.split_key_updates(derived_feed(spark, d), old, ["pk"]).select(F.col("seq").alias("event_id"), "sub", "op", "pk", "value")


@query("""
  with {feed}, tagged as (select txn_id, max(seq) as last from feed group by txn_id having max(case when event_type = 'error' and seq % 10 = 0 then 1 else 0 end) = 1)
  select f.seq, f.pk, f.op from feed f left join tagged t on f.txn_id = t.txn_id where t.txn_id is null or f.seq = t.last
""")
def cdc_txn_loop_filter(spark, d):
    tag = (F.col("event_type") == "error") & (F.pmod("seq", F.lit(10)) == 0)
    return changes.suppress_loops(derived_feed(spark, d), "txn_id", tag, "seq").select("seq", "pk", "op")


@query("with {feed} select tbl as pipeline, count(*) as n from feed where event_type = 'error' and tbl glob 'events_*' and not tbl glob '*_9' group by tbl")
def cdc_fail_on_tag(spark, d):
    tags = derived_feed(spark, d).where("event_type = 'error'").withColumn("pipeline", F.col("tbl"))
    checked = changes.fail_on_tag(tags, F.col("pipeline"), predicates.match_table("*_9", "pipeline"))
    return checked.where(predicates.match_table("events_*", "pipeline")).groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))


@query("with v as (select distinct cast(l_quantity as bigint) - 26 as raw from lineitem) select raw, cast(case when raw < 0 then raw + 16777216 else raw end as decimal(20,0)) as decoded from v")
def cdc_unsigned_decode(spark, d):
    raw = table(spark, d, "lineitem").select((F.col("l_quantity").cast("bigint") - 26).alias("raw")).distinct()
    return raw.select("raw", scalar.unsigned(F.col("raw"), 24).alias("decoded"))


@query("""
  with {feed}, e as (select sum(case when event_type = 'signup' and seq % 7 = 0 then 1 else 0 end) over (partition by stream order by seq) as epoch, stream from feed)
  select stream, cast(epoch as bigint) as epoch, count(*) as n from e group by stream, epoch
""")
def cdc_ddl_epochs(spark, d):
    is_ddl = (F.col("event_type") == "signup") & (F.pmod("seq", F.lit(7)) == 0)
    e = changes.statement_epochs(derived_feed(spark, d), ["stream"], "seq", is_ddl)
    return e.groupBy("stream", F.col("epoch").cast("bigint").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))


@query("""
  with {feed}, b as (select seq, op, uk, lag(uk) over (partition by pk order by seq) as old_uk from feed)
  select seq, 1 + case when uk is not null then 1 else 0 end
    + case when op = 'update' and uk is distinct from old_uk and old_uk is not null then 1 else 0 end as n_hashes from b
""")
def cdc_dependency_count(spark, d):
    feed = ordering.running(derived_feed(spark, d), ["pk"], ["seq"], F.col("seq"), before=("lag", F.col("uk")))
    feed = feed.withColumn("old_uk", F.when(F.col("op") == "update", F.col("before")).otherwise(F.col("uk")))
    keys = changes.dependency_keys(F.col("db"), F.col("tbl"), {"PRIMARY": [(F.col("pk"), F.col("pk"))], "uk": [(F.col("uk"), F.col("old_uk"))]})
    return feed.select("seq", F.size(keys).alias("n_hashes"))


@query("""
  with {feed}, s as (select stream as st, row_number() over (partition by stream order by seq) as sn, seq from feed)
  select st, count(*) as n, coalesce(min(case when (seq + 1) % 501 = 0 then sn end) - 1, count(*)) as committed from s group by st
""")
def cdc_commit_prefix(spark, d):
    s = changes.stream_sequence(derived_feed(spark, d), ["stream"], ["seq"])
    return changes.committed_prefix(s.withColumnRenamed("stream", "st"), "st", "seq_no", F.pmod(F.col("seq") + 1, F.lit(501)) != 0)


@query("""
  with {feed} select stream as st, least(max(event_ts), max(case when (seq + 1) % 501 <> 0 and op <> 'delete' then event_ts end)) as event_ts_low from feed group by stream
""")
def cdc_low_watermark(spark, d):
    done = (F.pmod(F.col("seq") + 1, F.lit(501)) != 0) & (F.col("op") != "delete")
    return changes.low_watermark(derived_feed(spark, d).withColumnRenamed("stream", "st"), "st", F.col("event_ts"), F.when(done, F.col("event_ts"))).withColumnRenamed("watermark", "event_ts_low")


@query("with {feed} select stream as st, row_number() over (partition by stream order by seq) as seq_no, seq as event_id from feed")
def cdc_stream_sequence(spark, d):
    return changes.stream_sequence(derived_feed(spark, d), ["stream"], ["seq"]).select(F.col("stream").alias("st"), "seq_no", F.col("seq").alias("event_id"))


@query("with {feed} select seq, tbl, op from feed where db glob 'a*' and tbl glob '*_1'")
def filter_accept_glob(spark, d):
    return filters.accept(derived_feed(spark, d), predicates.matcher({"match-schema": "a*", "match-table": "*_1"})).select("seq", "tbl", "op")


@query("with {feed} select seq, tbl, op from feed where op not in ('delete', 'insert')")
def filter_reject_op(spark, d):
    return filters.reject(derived_feed(spark, d), predicates.matcher({"match-dml-op": ["delete", "insert"]})).select("seq", "tbl", "op")


@query("with {feed} select seq, tbl from feed where regexp_matches(tbl, '_[02]') or regexp_matches(tbl, '^x')")
def filter_table_regex(spark, d):
    return filters.accept(derived_feed(spark, d), predicates.matcher({"match-table-regex": ["_[02]", "^x"]})).select("seq", "tbl")


@query("select rec_no, ddl_sql from schema_feed where msg_type = 'ddl' and regexp_matches(ddl_sql, '(?i)^alter.*drop')")
def filter_ddl_regex(spark, d):
    feed = table(spark, d, "schema_feed").withColumn("ddl", F.col("ddl_sql"))
    return filters.accept(feed, predicates.matcher({"match-ddl-regex": "(?i)^alter.*drop"})).select("rec_no", "ddl_sql")


def _mapped(spark, d) -> DataFrame:
    feed = derived_feed(spark, d)
    return feed.select("seq", "tbl", "op", encode.text_map(["pk", "event_type", "k"]).alias("data"), encode.text_map(["pk"]).alias("pks"))


@query("with {feed} select seq, cast(pk as varchar) as pk, case when tbl = 'events_1' then null else cast(k as varchar) end as k, event_type, case when tbl = 'events_1' then 2 else 3 end as n from feed")
def filter_delete_columns(spark, d):
    f = filters.chain(_mapped(spark, d), [{"type": "delete-dml-column", "config": {"match-table": "events_1", "columns": ["k"]}}])
    return f.select("seq", F.try_element_at("data", F.lit("pk")).alias("pk"), F.try_element_at("data", F.lit("k")).alias("k"), F.try_element_at("data", F.lit("event_type")).alias("event_type"), F.size("data").alias("n"))


@query("""
  with {feed} select seq, cast(pk as varchar) as id, event_type as kind, cast(null as varchar) as extra, cast(pk as varchar) as pk_id, case when tbl glob 'events_*' then 4 end as n from feed
""")
def filter_rename_columns(spark, d):
    conf = {"match-table": "events_*", "from": ["pk", "event_type", "absent"], "to": ["id", "kind", "extra"]}
    f = filters.chain(_mapped(spark, d), [{"type": "rename-dml-column", "config": conf}])
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return f.select("seq", at("data", "id").alias("id"), at("data", "kind").alias("kind"), at("data", "extra").alias("extra"), at("pks", "id").alias("pk_id"), F.size("data").alias("n"))


@query("with {feed} select seq, tbl, op from feed where tbl glob 'events_*' and op <> 'delete' and not (tbl = 'events_3' and op = 'insert')")
def filter_chain(spark, d):
    return filters.chain(
        derived_feed(spark, d),
        [
            {"type": "accept", "config": {"match-table": "events_*"}},
            {"type": "reject", "config": {"match-dml-op": "delete"}},
            {"type": "reject", "config": {"match-table": "events_3", "match-dml-op": ["insert"]}},
        ],
    ).select("seq", "tbl", "op")


@query("with {feed} select seq, value * 2 as value from feed where op <> 'delete'")
def filter_python_sidecar(spark, d):
    def double(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(value=f["value"] * 2)

    return filters.sidecar(derived_feed(spark, d).where("op <> 'delete'").select("seq", "value"), double, "seq bigint, value double")


@query("""
  with {feed}, t as (select case when tbl glob '*_0' then 'app' when tbl glob 'events_*' and op = 'delete' then 'trash' when tbl glob 'events_*' then 'shop' end as tgt_db,
    case when tbl glob '*_0' then 'zero' when tbl glob 'events_*' and op = 'delete' then tbl else 'merged' end as tgt_tbl from feed)
  select tgt_db, tgt_tbl, count(*) as n from t group by 1, 2
""")
def route_first_match(spark, d):
    routes = [
        {"match-table": "*_0", "target-table": "zero"},
        {"match-table": "events_*", "match-dml-op": "delete", "target-schema": "trash"},
        {"match-table": "events_*", "target-schema": "shop", "target-table": "merged"},
    ]
    return routing.route_tables(derived_feed(spark, d), routes).groupBy("tgt_db", "tgt_tbl").agg(F.count(F.lit(1)).alias("n"))


@query("""
  with {feed} select 'all' as model, count(*) as n from feed union all select 'writes', count(*) from feed where op <> 'delete'
  union all select 'zero', count(*) from feed where tbl in ('events_0', 'events_2')
""")
def route_fanout_models(spark, d):
    models = [{"name": "all", "match-table": "*"}, {"name": "writes", "match-dml-op": ["insert", "update"]}, {"name": "zero", "match-table": "events_0"}, {"name": "zero", "match-table": "events_2"}]
    return routing.route_models(derived_feed(spark, d), models).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("""
  with {feed}, t as (select case when op = 'delete' then 'gone' when tbl in ('events_0', 'events_1') then 'low' end as topic, cast(pk % 5 as int) as partition from feed)
  select topic, partition, count(*) as n from t where topic is not null group by 1, 2
""")
def route_topic_partition(spark, d):
    routes = [{"match-dml-op": "delete", "dml-topic": "gone"}, {"match-table": ["events_0", "events_1"], "dml-topic": "low"}]
    return routing.route_topics(derived_feed(spark, d), routes, F.col("pk"), 5).groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"))


@query("""
  select (select l_orderkey from lineitem order by l_orderkey, l_linenumber limit 1) as min_l_orderkey,
         (select l_linenumber from lineitem order by l_orderkey, l_linenumber limit 1) as min_l_linenumber,
         (select l_orderkey from lineitem order by l_orderkey desc, l_linenumber desc limit 1) as max_l_orderkey,
         (select l_linenumber from lineitem order by l_orderkey desc, l_linenumber desc limit 1) as max_l_linenumber
""")
def snapshot_minmax(spark, d):
    return snapshot.key_bounds(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders where (o_orderkey, o_custkey) > (100, 7) order by o_orderkey, o_custkey limit 50")
def snapshot_keyset_page(spark, d):
    return snapshot.page_after(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], (100, 7), 50)


@query("with t as (select o_orderkey, ntile(16) over (order by o_orderkey) as chunk from orders) select chunk, count(*) as n, min(o_orderkey) as lo, max(o_orderkey) as hi from t group by chunk")
def snapshot_chunks(spark, d):
    return snapshot.chunk_bounds(table(spark, d, "orders"), "o_orderkey", 16)


@query("""
  with {feed}, u as (select c_custkey as pk, 'insert' as op, c_acctbal as value, -1 as seq from customer union all select pk, op, value, seq from feed where seq > 500),
  r as (select *, row_number() over (partition by pk order by seq desc) as rn from u)
  select pk, value, cast(seq as bigint) as seq from r where rn = 1 and op <> 'delete'
""")
def replication_handover(spark, d):
    snap = table(spark, d, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_acctbal").alias("value"))
    return snapshot.replicate(snap, derived_feed(spark, d), 500, ["pk"], "seq", ["value"])


@query("""
  with {feed}, r as (select *, row_number() over (partition by pk order by seq desc) as rn from feed),
  l as (select pk, value from r where rn = 1 and op <> 'delete')
  select f.seq, l.value as row_value from feed f left join l on f.pk = l.pk where f.op = 'update'
""")
def lookup_enrich(spark, d):
    feed = derived_feed(spark, d)
    current = apply.replace_rows(feed, ["pk"], "seq", ["value"]).select("pk", F.col("value").alias("row_value"))
    return snapshot.lookup(feed.where("op = 'update'").select("seq", "pk"), current, ["pk"], "row_value").select("seq", "row_value")


@query("""
  select c.c_custkey, c.c_name, coalesce(string_agg(o.o_orderkey || ':' || o.o_orderstatus, ',' order by o.o_orderkey), '') as orders
  from customer c left join orders o on o.o_custkey = c.c_custkey group by 1, 2
""")
def doc_one_many(spark, d):
    docs = documents.attach_many(
        table(spark, d, "customer").select("c_custkey", "c_name"),
        table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey")),
        ["c_custkey"],
        "orders",
        documents.pick_columns(["o_orderkey", "o_orderstatus"]),
        ["o_orderkey"],
    )
    return docs.select("c_custkey", "c_name", F.array_join(F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit(":"), o["o_orderstatus"])), ",").alias("orders"))


@query("select c_custkey, n_name as nation_name, n_regionkey as nation_region from customer left join nation on c_nationkey = n_nationkey")
def doc_one_one_object(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    doc = documents.attach_object(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"], "nation", [("n_name", "name"), ("n_regionkey", "region")])
    return doc.select("c_custkey", F.col("nation.name").alias("nation_name"), F.col("nation.region").alias("nation_region"))


@query("select c_custkey, n_name as label, n_regionkey as nation_n_regionkey from customer left join nation on c_nationkey = n_nationkey")
def doc_one_one_flatten(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    cols = documents.pick_columns(["c_nationkey", "n_name", "n_regionkey"], exclude=["c_nationkey"], convert={"n_name": "label"}, prefix="nation_")
    return documents.attach_flat(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"], cols).drop("c_nationkey")


@query("with {feed} select seq, concat_ws('_', pk, seq) as doc_id, lower(ltrim('_-' || upper(tbl), '_-+')) as index_name from feed")
def doc_id_index(spark, d):
    f = derived_feed(spark, d)
    return f.select("seq", documents.document_id(F.col("pk"), F.col("seq")).alias("doc_id"), documents.index_name(F.concat(F.lit("_-"), F.upper("tbl"))).alias("index_name"))


@query("""
  with {feed} select seq, '{"version":"0.1","database":"' || db || '","table":"' || tbl || '","type":"' || op || '","ts":' || cast(floor(epoch(event_ts)) as bigint)
    || ',"time_zone":"Asia/Shanghai","data":{"pk":"' || pk || '","event_type":"' || event_type || '","uk":' || coalesce('"' || uk || '"', 'null') || '},"old":null,"pks":{"pk":"' || pk || '"}}' as json from feed
""")
def encode_json_v01(spark, d):
    f = derived_feed(spark, d)
    return f.select("seq", encode.json_v01(F.col("db"), F.col("tbl"), F.col("op"), F.to_timestamp("event_ts"), encode.text_map(["pk", "event_type", "uk"]), None, encode.text_map(["pk"])).alias("json"))


@query("""
  with {feed} select seq, '{"version":"2.0.alpha","database":"' || db || '","table":"' || tbl || '","type":"' || op || '","ts":"' || strftime(date_trunc('second', event_ts), '%Y-%m-%dT%H:%M:%SZ')
    || '","Data":{"pk":' || pk || ',"event_type":"' || event_type || '","uk":' || coalesce(cast(uk as varchar), 'null') || '},"Old":null,"Pks":{"pk":' || pk || '}}' as json from feed
""")
def encode_json_v20(spark, d):
    f = derived_feed(spark, d)
    ts = scalar.rfc3339(F.date_trunc("second", F.col("event_ts")))
    return f.select("seq", encode.json_v20(F.col("db"), F.col("tbl"), F.col("op"), ts, F.struct("pk", "event_type", "uk"), None, F.struct("pk")).alias("json"))


_MONGO = """
  with o as (select op_no, operation, obj_id, op_source, coalesce('"' || split_part(op_ns, '.', 1) || '"', 'null') as db, coalesce('"' || regexp_replace(op_ns, '^[^.]*[.]?', '') || '"', 'null') as coll, op_ns,
    case when data_json is null then 'null' when json_valid(data_json) then data_json else cast(to_json(data_json) as varchar) end as data,
    case when row_json is null then 'null' when json_valid(row_json) then row_json else cast(to_json(row_json) as varchar) end as doc from oplog_ops)
"""


def _mongo_ops(spark, d) -> tuple:
    o = table(spark, d, "oplog_ops")
    return o, F.substring_index("op_ns", ".", 1), F.regexp_replace("op_ns", r"^[^.]*\.?", "")


@query(_MONGO + """ select op_no, '{"version":"2.0.alpha","database":' || db || ',"collection":' || coll || ',"data":' || data || ',"row":' || doc || '}' as json from o""")
def encode_mongo(spark, d):
    o, db, coll = _mongo_ops(spark, d)
    return o.select("op_no", encode.mongo_json("2.0.alpha", db, coll, F.col("data_json"), F.col("row_json")).alias("json"))


@query(_MONGO + """
  select op_no, '{"version":"0.1","database":' || db || ',"collection":' || coll || ',"unique_source_name":"mongo-1","oplog":{"_id":' || coalesce('"' || obj_id || '"', 'null') || ',"operation":' || coalesce('"' || operation || '"', 'null')
    || ',"namespace":' || coalesce('"' || op_ns || '"', 'null') || ',"data":' || data || ',"row":' || doc || ',"source":' || coalesce(cast(op_source as varchar), 'null') || '}}' as json from o
""")
def encode_mongo_v01(spark, d):
    o, db, coll = _mongo_ops(spark, d)
    return o.select("op_no", encode.mongo_json("0.1", db, coll, F.col("data_json"), F.col("row_json"), F.lit("mongo-1"), F.col("obj_id"), F.col("operation"), F.col("op_source")).alias("json"))


@query("with {feed} select seq, 26 + strlen(cast(pk as varchar)) + strlen(event_type) as size from feed")
def encode_message_size(spark, d):
    return derived_feed(spark, d).select("seq", encode.message_size(F.col("pk").cast("string"), F.col("event_type")).cast("bigint").alias("size"))


@query("select c_custkey, c_name, 'none' as note, cast(null as int) as score from customer")
def fill_missing_columns(spark, d):
    src = table(spark, d, "customer").select("c_custkey", "c_name")
    return apply.fill_missing(src, {"c_custkey": ("bigint", None), "c_name": ("string", ""), "note": ("string", "none"), "score": ("int", None)})


_COUNTS = """
  with s as (select cast(floor(l_orderkey / 64) as bigint) as b, count(*) as src, cast(sum(case when l_orderkey % 97 <> 0 then 1 else 0 end) as bigint) as tgt from lineitem group by 1)
"""


def _copies(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return li, li.where(F.pmod("l_orderkey", F.lit(97)) != 0)


@query(_COUNTS + " select b, src, tgt, tgt - src as diff from s where src <> tgt")
def verify_range_counts(spark, d):
    return verify.range_counts(*_copies(spark, d), "l_orderkey", 64)


_WIDTH, _LEVELS = 1 << 20, 14


_RANGES = """
  f as (select cast(floor(l_orderkey / 64) as bigint) as b, count(*) as src, cast(sum(case when l_orderkey % 97 <> 0 then 1 else 0 end) as bigint) as tgt from lineitem group by 1),
  l as (select cast(unnest(range(0, 15)) as int) as lvl),
  r as (select l.lvl, f.b >> (14 - l.lvl) as b, cast(sum(src) as bigint) as src, cast(sum(tgt) as bigint) as tgt, cast(sum(tgt - src) as bigint) as diff from f, l group by 1, 2 having sum(tgt - src) <> 0)
"""


@query("with " + _RANGES + """
  select r.lvl, r.b, r.diff from r where not exists (select 1 from r c where c.lvl > r.lvl and c.b >> (c.lvl - r.lvl) = r.b and c.diff = r.diff)
""")
def verify_range_prune(spark, d):
    ranges = verify.bisect_counts(*_copies(spark, d), "l_orderkey", 0, _WIDTH, _LEVELS)
    return verify.prune_ranges(ranges).select("lvl", "b", "diff")


@query("with recursive " + _RANGES + """,
  v as (select * from r where lvl = 0
    union all
    select c.* from v join r c on c.lvl = v.lvl + 1 and c.b >> 1 = v.b
    where not ((((1048576 >> v.lvl) - 1 < 10) or (v.src < 20 and v.tgt < 20)) and v.diff < 10))
  select lvl, b, src, tgt, diff from v
""")
def verify_range_bisect(spark, d):
    """The ranges that a bisection with its stop rule looks at."""
    ranges = verify.bisect_counts(*_copies(spark, d), "l_orderkey", 0, _WIDTH, _LEVELS)
    return verify.visited_ranges(ranges).select("lvl", "b", "src", "tgt", "diff")


@query("""
  with a as (select distinct lower(trim(replace(tbl, '`', ''))) as name from change_feed where tbl is not null), b as (select distinct lower(trim(replace(tbl, '`', ''))) as name from schema_feed where tbl is not null)
  select name, 'source' as side from (select name from a except select name from b) union all select name, 'target' from (select name from b except select name from a)
""")
def verify_table_set(spark, d):
    names = lambda t: table(spark, d, t).where("tbl is not null").select(plain_name(F.col("tbl")).alias("name")).distinct()
    return verify.table_set_difference(names("change_feed"), names("schema_feed"))


_SEGMENTS = """
  with s as (select event_id as seq, cast(floor(event_id / 100) as bigint) as seg, user_id as payload_id, ts, event_id as id, md5(event_type) as checksum from events),
  t as (select seq, seg, payload_id, ts, id, case when seq % 1009 = 0 then 'broken' else checksum end as checksum from s where seq % 1511 <> 0 and seg % 50 <> 7),
  a as (select seg, payload_id, string_agg(checksum, ',' order by ts, id) as c from s group by 1, 2), b as (select seg, payload_id, string_agg(checksum, ',' order by ts, id) as c from t group by 1, 2),
  j as (select coalesce(a.seg, b.seg) as seg, bool_and(coalesce(a.c = b.c, false)) as ok from a full join b on a.seg = b.seg and a.payload_id = b.payload_id group by 1)
  select j.seg, case when j.seg not in (select seg from t) then 'timeout' when ok then 'same' else 'diff' end as verdict from j
"""


@query(_SEGMENTS)
def verify_segments(spark, d):
    e = table(spark, d, "events")
    s = e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 100).cast("bigint").alias("seg"), F.col("user_id").alias("payload_id"), "ts", F.col("event_id").alias("id"), F.md5(F.col("event_type").cast("binary")).alias("checksum"))
    t = s.where((F.pmod("seq", F.lit(1511)) != 0) & (F.pmod("seg", F.lit(50)) != 7)).withColumn("checksum", F.when(F.pmod("seq", F.lit(1009)) == 0, "broken").otherwise(F.col("checksum")))
    return verify.compare_segments(s, t)


@query("""
  with s as (select msg_tag, payload_id, msg_time, rec_no, last_value(barrier ignore nulls) over (partition by msg_tag order by rec_no rows between unbounded preceding and current row) as seg from dcp_messages)
  select msg_tag, seg, count(*) as n, count(distinct payload_id) as payloads from s group by 1, 2
""")
def verify_barrier_segments(spark, d):
    s = verify.segments(table(spark, d, "dcp_messages"), "msg_tag", "rec_no", "barrier")
    return s.groupBy("msg_tag", "seg").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("payload_id").alias("payloads"))


@query("""
  with s as (select msg_tag, rec_no, barrier, row_number() over (partition by msg_tag order by rec_no) as n, last_value(barrier ignore nulls) over (partition by msg_tag order by rec_no rows between unbounded preceding and 1 preceding) as before from dcp_messages)
  select msg_tag, rec_no, case when n = 1 and barrier is null then 'no first barrier' else 'jump' end as error from s where (n = 1 and barrier is null) or barrier <> before + 1
""")
def verify_barrier_errors(spark, d):
    return verify.barrier_errors(table(spark, d, "dcp_messages"), "msg_tag", "rec_no", "barrier")


@query("""
  select (select count(*) from lineitem) as n_source, (select count(*) from lineitem where l_orderkey % 97 <> 0) as n_target,
    (select count(*) from lineitem) = (select count(*) from lineitem where l_orderkey % 97 <> 0) as equal, true as self_equal
""")
def verify_checksum(spark, d):
    s, t = _copies(spark, d)
    a, b, again = (verify.table_checksum(x, ["l_orderkey", "l_linenumber", "l_quantity"]) for x in (s, t, s.repartition("l_linenumber")))
    one = spark.range(1)
    val = lambda x, c: x.select(c).scalar()
    same = lambda x, y: (val(x, "n") == val(y, "n")) & (val(x, "sum_lo") == val(y, "sum_lo")) & (val(x, "sum_hi") == val(y, "sum_hi"))
    return one.select(val(a, "n").alias("n_source"), val(b, "n").alias("n_target"), same(a, b).alias("equal"), same(a, again).alias("self_equal"))


@query("with {feed} select seq as event_id, md5(upper(op) || ' ' || '{\"pk\":' || pk || ',\"event_type\":\"' || event_type || '\"}') as h from feed")
def verify_md5_payload(spark, d):
    return derived_feed(spark, d).select(F.col("seq").alias("event_id"), encode.checksum(F.col("op"), F.to_json(F.struct("pk", "event_type"))).alias("h"))


@query("with {feed} select cast(floor(log2(value / 0.0005)) as int) as b, count(*) as n from feed where value > 0 group by 1")
def latency_histogram(spark, d):
    return derived_feed(spark, d).where("value > 0").groupBy(scalar.latency_bucket(F.col("value")).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("with {feed} select c_custkey as id, c_name as name from customer where c_acctbal > 5000.0")
def manual_statement(spark, d):
    return apply.manual_sql(spark, "select c_custkey as id, c_name as name from manual_changes where c_acctbal > :least", table(spark, d, "customer"), view="manual_changes", least=5000.0)


@query("with {feed} select seq, 'app`.`' || tbl || ':' || pk || '_' as signature from feed")
def key_signatures(spark, d):
    return derived_feed(spark, d).select("seq", scalar.key_signature(F.col("db"), F.col("tbl"), F.col("pk")).alias("signature"))


_GROUPS = [(12, 5), (5, 2), (7, 3), (3, 5), (9, 6), (10, 4)]


@query(f"""
  with g(partitions, members) as (values {', '.join(map(str, _GROUPS))}),
  m as (select partitions, members, unnest(range(0, members)) as member from g),
  r as (select *, cast(floor(member * (partitions / members) + 0.5) as bigint) as lo, cast(floor((member + 1) * (partitions / members) + 0.5) as bigint) as hi from m)
  select partitions, members, unnest(range(lo, hi)) as partition_no, cast(member as int) as member from r
""")
def consumer_ranges(spark, d):
    parts = [spark.range(p).select(F.lit(p).alias("partitions"), F.lit(m).alias("members"), F.col("id").alias("partition_no"), scalar.range_partition(F.col("id"), m, p).alias("member")) for p, m in _GROUPS]
    return functools.reduce(DataFrame.unionByName, parts)


@query("select i as partition_no, cast(i % 5 as int) as member from range(0, 12) t(i)")
def consumer_round_robin(spark, d):
    return spark.range(12).select(F.col("id").alias("partition_no"), scalar.round_robin(F.col("id"), 5).alias("member"))


@query("""
  with p as (select l_orderkey, l_linenumber, 'bin.' || l_linenumber as a, 'bin.' || (l_partkey % 7 + 1) as b, l_suppkey as x, l_partkey as y from lineitem)
  select l_orderkey, l_linenumber, cast(case when a < b then -1 when a > b then 1 when abs(x - y) <= 5 then 0 when x < y then -1 else 1 end as int) as c from p
""")
def compare_log_positions(spark, d):
    li = table(spark, d, "lineitem")
    name = lambda n: F.concat(F.lit("bin."), n.cast("string"))
    c = scalar.compare_positions(name(F.col("l_linenumber")), F.col("l_suppkey"), name(F.pmod("l_partkey", F.lit(7)) + 1), F.col("l_partkey"), 5)
    return li.select("l_orderkey", "l_linenumber", c.alias("c"))


@query(_LWW)
def stream_cdc_lww(spark, d):
    """The batch fold run as a stream of several batches over the same rows.
    The target lies below the shared checkpoint folder."""
    import uuid

    from driftline.session import ensure_checkpoint_dir
    from driftline.sources.feeds import events_as_changes
    from driftline.streaming.changes import apply_batches, live_rows, run_to_end
    from driftline.streaming.tables import KeyedTable

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    # arrives in four files, each a batch of its own, in no order
    events.repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    target = KeyedTable(spark, f"{base}/target", ["pk"], 16)
    run_to_end(stream, f"{base}/checkpoint", apply_batches(target, "seq", ["value", "event_type"], events_as_changes))
    return live_rows(target).select("pk", "value", "event_type", "seq")


@query("""
  with {feed}, n as (select seq, txn_id, row_number() over (partition by txn_id order by seq) as n, max(seq) over (partition by txn_id) as m from feed)
  select seq, txn_id, cast(floor((n - 1) / 3.0) as bigint) as batch, seq = m as last from n
""")
def cdc_transaction_batches(spark, d):
    return changes.transaction_batches(derived_feed(spark, d).select("seq", "txn_id"), "txn_id", "seq", 3).select("seq", "txn_id", "batch", "last")


@query("""
  with f as (select rec_no, lower(trim(replace(db, '`', ''))) as db, lower(trim(replace(tbl, '`', ''))) as tbl, json_extract_string(pks_json, '$.name') as name from change_feed where msg_type = 'dml')
  select rec_no from f where not (db = 'mysql' or tbl in ('positions', 'dead_signals') or (regexp_matches(tbl, 'heartbeat') and coalesce(name, '') <> 'gw-main'))
""")
def cdc_internal_traffic(spark, d):
    feed = table(spark, d, "change_feed").where("msg_type = 'dml'").select("rec_no", plain_name(F.col("db")).alias("db"), plain_name(F.col("tbl")).alias("tbl"), F.from_json("pks_json", "map<string,string>").alias("pks"))
    return changes.internal_traffic(feed, "gw-main").select("rec_no")


@query("""
  select op_no, case operation when 'i' then 'insert' when 'u' then 'update' when 'd' then 'delete' else 'drop' end as op, split_part(op_ns, '.', 1) as db,
    case when operation = 'c' then json_extract_string(data_json, '$.drop') else regexp_replace(op_ns, '^[^.]*[.]?', '') end as coll,
    case when operation in ('i', 'd') then coalesce(json_extract_string(data_json, '$._id."$oid"'), obj_id) when operation = 'u' then obj_id end as id
  from oplog_ops where operation in ('i', 'u', 'd') or (operation = 'c' and json_extract_string(data_json, '$.drop') is not null)
""")
def oplog_changes(spark, d):
    return oplog.parse(table(spark, d, "oplog_ops")).drop("body")


@query("""
  with p as (select split_part(op_ns, '.', 1) || '|' || regexp_replace(op_ns, '^[^.]*[.]?', '') as ns, case when operation in ('i', 'd') then coalesce(json_extract_string(data_json, '$._id."$oid"'), obj_id) else obj_id end as id from oplog_ops where operation in ('i', 'u', 'd'))
  select 'log' as ordering, cast(1 as bigint) as streams union all select 'namespace', count(distinct ns) from p union all select 'document', count(distinct ns || '|' || coalesce(id, '')) from p
""")
def oplog_ordering(spark, d):
    p = oplog.parse(table(spark, d, "oplog_ops")).where("op <> 'drop'")
    each = p.select(F.explode(F.create_map(*[c for o in oplog.ORDERINGS for c in (F.lit(o), oplog.ordering_key(o, F.col("db"), F.col("coll"), F.col("id")))])).alias("ordering", "k"))
    return each.groupBy("ordering").agg(F.count_distinct("k").alias("streams"))


@query("""
  with h as (select lower(trim(replace(db, '`', ''))) as db, (epoch_us(recv_ts) - epoch_us(event_ts)) / 1000000.0 as s from change_feed where msg_type = 'dml' and lower(tbl) like '%heartbeat%')
  select db, count(*) as n, cast(min(s) as double) as least_s, cast(max(s) as double) as most_s, cast(sum(case when s > 60 then 1 else 0 end) as bigint) as unhealthy from h group by db
""")
def heartbeat_latency(spark, d):
    from driftline.streaming.changes import is_healthy

    h = table(spark, d, "change_feed").where("msg_type = 'dml'").where(F.lower("tbl").contains("heartbeat"))
    s = (micros("recv_ts") - micros("event_ts")) / 1_000_000
    sick = ~is_healthy(F.to_timestamp("event_ts"), F.to_timestamp("recv_ts")) | (s > 60)
    return h.groupBy(plain_name(F.col("db")).alias("db")).agg(F.count(F.lit(1)).alias("n"), F.min(s).alias("least_s"), F.max(s).alias("most_s"), F.sum(sick.cast("bigint")).alias("unhealthy"))


@query()
def ddl_retarget(spark, d):
    """Statements of schema_feed as they run at a target schema ``copy``."""

    def rewrite(batches):
        import pyarrow as pa

        for b in batches:
            out = [(n, s) for n, db, sql in zip(*[c.to_pylist() for c in b.columns]) for s in retarget(sql or "", db or "", lambda _, t: ("copy", t))]
            yield pa.RecordBatch.from_pydict({"rec_no": pa.array([o[0] for o in out], pa.int64()), "statement": pa.array([o[1] for o in out], pa.string())})

    ddl = table(spark, d, "schema_feed").where(plain_op(F.col("msg_type")) == "ddl")
    return ddl.select("rec_no", "db", "ddl_sql").mapInArrow(rewrite, "rec_no bigint, statement string")


@query("select o_orderkey, cast(o_totalprice as decimal(12,2)) as price, cast(o_custkey as decimal(20,0)) as cust, o_orderdate as placed, cast(null as timestamp) as zero from orders")
def decode_types(spark, d):
    o = table(spark, d, "orders")
    text = o.select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("p"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderdate").cast("string").alias("t"), F.lit("0000-00-00 00:00:00").alias("z"))
    return text.select("o_orderkey", mysql_types.decode(F.col("p"), "decimal(12,2)").alias("price"), mysql_types.decode(F.col("c"), "bigint(20) unsigned").alias("cust"), mysql_types.decode(F.col("t"), "datetime(6)").alias("placed"), mysql_types.decode(F.col("z"), "datetime").alias("zero"))


@query("""
  with {feed}, r as (select *, row_number() over (partition by tbl, pk order by seq desc) as rn from feed)
  select tbl as index, cast(pk as varchar) as doc_id, '{"pk":' || pk || ',"event_type":"' || event_type || '","uk":' || coalesce(cast(uk as varchar), 'null') || '}' as document from r where rn = 1 and op <> 'delete'
""")
def doc_index_table(spark, d):
    return sinks.documents(derived_feed(spark, d), ["pk"], "seq", ["event_type", "uk"])


@query("""
  with {feed}, r as (select *, row_number() over (partition by pk, k order by seq desc) as rn from feed),
  l as (select pk, k, event_type from r where rn = 1 and op <> 'delete')
  select c.c_custkey as pk, coalesce(string_agg(l.k || '=' || l.event_type, ',' order by l.k), '') as parts from customer c left join l on l.pk = c.c_custkey group by 1
""")
def doc_children_of_changes(spark, d):
    """Children folded per own key, then gathered in their parent's document."""
    live = apply.replace_rows(derived_feed(spark, d).where("k is not null"), ["pk", "k"], "seq", ["event_type"])
    docs = documents.attach_many(table(spark, d, "customer").select(F.col("c_custkey").alias("pk")), live, ["pk"], "parts", [("k", "k"), ("event_type", "t")], ["k"])
    return docs.select("pk", F.array_join(F.transform("parts", lambda p: F.concat(p["k"].cast("string"), F.lit("="), p["t"])), ",").alias("parts"))


@query("with {feed} select distinct pk, 'pipe-a' as txn_tag, " + str(zlib.crc32(b"pipe-a") % 999 + 1) + " as txn_slot from feed where op <> 'delete'")
def txn_tagged_rows(spark, d):
    return apply.tagged(derived_feed(spark, d).where("op <> 'delete'").select("pk").distinct(), "pipe-a")


@query("""
  with {feed}, t as (select case when tbl = 'events_0' then 'zero' when op = 'delete' then lower(tbl) when tbl in ('events_1', 'events_2') then lower(tbl) end as index,
    case when tbl = 'events_0' then 'row' else 'doc' end as doc_type, tbl <> 'events_0' and op = 'delete' as ignore_without_key from feed)
  select index, doc_type, ignore_without_key, count(*) as n from t where index is not null group by 1, 2, 3
""")
def route_to_indexes(spark, d):
    routes = [{"match-table": "events_0", "target-index": "zero", "target-type": "row"}, {"match-dml-op": "delete", "ignore-no-primary-key": True}, {"match-table": ["events_1", "events_2"]}]
    routed = routing.route_documents(derived_feed(spark, d), routes, documents.index_name(F.col("tbl")))
    return routed.groupBy("index", "doc_type", "ignore_without_key").agg(F.count(F.lit(1)).alias("n"))


@query("""
  with {feed}, z as (select *, max(case when op <> 'update' then seq end) over (partition by pk) as reset, arg_max(op, seq) over (partition by pk) as last_op from feed),
  l as (select * from z where last_op <> 'delete' or op = 'x'), s as (select * from l where op <> 'delete' and (reset is null or seq >= reset)),
  e as (select pk, seq, 'kind' as f, event_type as v from s union all select pk, seq, 'k', cast(k as varchar) from s where seq % 2 = 0 union all select pk, seq, 'uk', cast(uk as varchar) from s where seq % 3 = 0)
  select pk, string_agg(f || '=' || coalesce(v, '-'), ',' order by f) as fields from (select pk, f, arg_max(coalesce(v, '-'), seq) as v from e group by pk, f) group by pk
""")
def doc_children_merged(spark, d):
    """Updates carry some fields only and are merged field by field."""
    text = lambda c: F.col(c).cast("string")
    some = F.map_filter(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.when(F.pmod("seq", F.lit(2)) == 0, F.coalesce(text("k"), F.lit("-"))), F.lit("uk"), F.when(F.pmod("seq", F.lit(3)) == 0, F.coalesce(text("uk"), F.lit("-")))), lambda k, v: v.isNotNull())
    merged = documents.merged_fields(derived_feed(spark, d).select("pk", "seq", "op", some.alias("data")), ["pk"], "seq")
    return merged.select("pk", F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


@query("select o_orderkey, o_custkey from orders where (o_orderkey, o_custkey) >= (100, 7)")
def snapshot_resumed(spark, d):
    return snapshot.resume(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], (100, 7))


@query("""
  with h as (select json_extract_string(pks_json, '$.name') as name, try_cast(json_extract_string(data_json, '$.offset') as bigint) as o, (epoch_us(recv_ts) - epoch_us(event_ts)) / 1000000.0 as s from change_feed where msg_type = 'dml' and lower(tbl) like '%heartbeat%')
  select name, count(*) as n, max(o) as "offset", cast(min(s) as double) as least_s, cast(avg(s) as double) as mean_s, cast(quantile_cont(s, 0.95) as double) as p95_s, cast(max(s) as double) as most_s from h group by name
""")
def probe_latencies(spark, d):
    from driftline.streaming.changes import probe_latency

    h = table(spark, d, "change_feed").where("msg_type = 'dml'").where(F.lower("tbl").contains("heartbeat"))
    seen = h.select(F.get_json_object("pks_json", "$.name").alias("name"), F.get_json_object("data_json", "$.offset").try_cast("bigint").alias("offset"), "event_ts", "recv_ts")
    return probe_latency(seen, "name", "event_ts", "recv_ts")
