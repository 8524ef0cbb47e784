"""Queries over feature tables and lineage."""

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import featuretables as S
from tidewatch.operators import lineage as G
from tidewatch.plans.registry import query
from tidewatch.session import scratch_root
from tidewatch.sources.tables import dirty_log, query_log, table

AS_OF = "2024-02-01 00:00:00"


def _path(spark):
    return f"{scratch_root(spark)}/tidewatch/{uuid.uuid4().hex}"


def _features(spark, d):
    """Per user and day: credits and queries, known at the end of the day."""
    log = query_log(spark, d).groupBy("USER_NAME", F.date_trunc("day", "START_TIME").cast("timestamp_ntz").alias("day")).agg(
        F.sum("CREDITS_USED").alias("credits"), F.count("*").alias("queries"))
    return S.prepare(log.withColumn("known_at", F.expr("day + interval 1 day")).drop("day"), AS_OF, "known_at")


FEAT = "ft as (select USER_NAME, date_trunc('day', START_TIME)::timestamp + interval 1 day as known_at, sum(CREDITS_USED) as credits, count(*) as queries from qlog group by 1, 2)"


@query("fs01_write_warnings", "select 'absent' as column_name, 'missing' as warning union all select 'sparse', 'half_null' union all select 'row_id', 'extra'")
def write_warnings(spark, d):
    return S.write_warnings(dirty_log(spark, d).select("row_id", "value", "sparse"), ["value", "sparse", "absent"])


@query("fs01_prepared_rows", f"with {FEAT} select USER_NAME, round(credits,6) as credits, queries, known_at, timestamp '{AS_OF}' as _ingestion_timestamp, known_at as _event_timestamp from ft")
def prepared_rows(spark, d):
    return _features(spark, d).drop("_data_hash")


@query("fs02_written_table", f"with {FEAT} select USER_NAME, round(sum(credits),6) as credits, 2*count(*) as rows from ft group by 1")
def written_table(spark, d):
    path = _path(spark)
    rows = _features(spark, d).withColumn("part", F.date_format("_event_timestamp", "yyyyMMdd"))
    S.write(rows, path, ["part"])
    S.write(rows, path, ["part"])
    return S.read(spark, path, ["credits"], keys=["USER_NAME"]).groupBy("USER_NAME").agg((F.sum("credits") / 2).alias("credits"), F.count("*").alias("rows"))


@query("fs03_read_features", f"with {FEAT} select USER_NAME, round(credits,6) as credits, known_at as _event_timestamp from ft where known_at between timestamp '2024-01-10' and timestamp '2024-01-20' and queries >= 2 and USER_NAME in ('U1','U2','U3','U4','U5')")
def read_features(spark, d):
    path = _path(spark)
    S.write(_features(spark, d), path)
    return S.read(spark, path, ["credits"], "2024-01-10 00:00:00", "2024-01-20 00:00:00", {"queries": {"gte": 2}, "USER_NAME": {"in": ["U1", "U2", "U3", "U4", "U5"]}}, keys=["USER_NAME"])


@query("fs04_feature_view", """with a as (select USER_NAME, sum(CREDITS_USED) as credits, count(*) as n from qlog group by 1), b as (select USER_NAME, avg(CREDITS_USED) as credits, count(distinct QUERY_TYPE) as kinds from qlog group by 1)
select USER_NAME, round(max(a.credits),6) as credits_max, round(avg(b.credits),6) as mean_credits_avg, max(kinds) as kinds_max from a join b using (USER_NAME) group by 1""")
def feature_view(spark, d):
    log = query_log(spark, d)
    a = log.groupBy("USER_NAME").agg(F.sum("CREDITS_USED").alias("credits"), F.count("*").alias("n"))
    b = log.groupBy("USER_NAME").agg(F.avg("CREDITS_USED").alias("credits"), F.count_distinct("QUERY_TYPE").alias("kinds"))
    return S.view({"total": a, "mean": b}, ["USER_NAME"], {"credits": "max", "mean_credits": "avg", "kinds": "max"})


STATS = """select 'value' as feature, count(value) as count, count(*)-count(value) as missing, count(distinct value) as unique_count, round(avg(value),6) as mean, round(stddev_samp(value),6) as std, min(value) as min, round(quantile_cont(value,0.25),6) as p25, round(median(value),6) as p50, round(quantile_cont(value,0.75),6) as p75,
 max(value) as max, round(count(*) filter (value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1))*100.0/count(value),6) as outlier_percentage, null::double as mean_length from dirty, (select quantile_cont(value,0.25) as q1, quantile_cont(value,0.75) as q3 from dirty)
 union all select 'kind', count(kind), count(*)-count(kind), count(distinct kind), null, null, null, null, null, null, null, null, round(avg(length(kind)),6) from dirty"""


@query("fs05_statistics", STATS)
def statistics(spark, d):
    return S.statistics(dirty_log(spark, d).select("value", "kind"))


@query("fs06_quality", f"""with s as ({STATS}), r as (select feature, 'missing' as rule, missing/(count+missing)*100 as value, (missing/(count+missing)*100 <= 10)::int as passed from s union all select feature, 'unique', unique_count, (unique_count >= 2)::int from s union all select feature, 'outliers', coalesce(outlier_percentage,0), (coalesce(outlier_percentage,0) <= 5)::int from s)
select feature, rule, round(value,6) as value, passed from r union all select '*', 'duplicates', round((count(*)-(select count(*) from (select distinct value, kind from dirty)))/count(*)*100,6), ((count(*)-(select count(*) from (select distinct value, kind from dirty)))/count(*)*100 <= 5)::int from dirty""")
def quality(spark, d):
    return S.quality(dirty_log(spark, d).select("value", "kind"))


@query("fs07_snapshot", f"with {FEAT} select 'daily' as snapshot_name, timestamp '{AS_OF}' as created_at, count(*) as row_count from ft")
def snapshot(spark, d):
    return S.snapshot(_features(spark, d), _path(spark), "daily", AS_OF).drop("path", "data_hash")


@query("fs08_expired", f"with {FEAT} select date_trunc('day', known_at)::timestamp as event_date, count(*) as rows from ft where known_at < timestamp '2024-01-12' group by 1")
def expired(spark, d):
    return S.expired(_features(spark, d), AS_OF, 20)


@query("fs09_offline", f"with {FEAT} select USER_NAME, round(credits,6) as credits, queries, known_at from ft where known_at between timestamp '2024-01-05' and timestamp '2024-01-25' and cast(substr(USER_NAME,2) as int) in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def offline(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("USER_NAME"))
    return S.offline(_features(spark, d), ids, "USER_NAME", "2024-01-05 00:00:00", "2024-01-25 00:00:00").select("USER_NAME", "credits", "queries", "known_at")


@query("fs10_point_in_time", f"with {FEAT} select q.QUERY_ID, q.START_TIME, q.USER_NAME, f.known_at as feature_time, round(f.credits,6) as credits, f.queries from qlog q asof left join ft f on q.USER_NAME = f.USER_NAME and q.START_TIME >= f.known_at")
def point_in_time(spark, d):
    spine = query_log(spark, d).select("QUERY_ID", "START_TIME", "USER_NAME")
    return S.as_of_join(spine, _features(spark, d), "USER_NAME", "START_TIME", ["credits", "queries"], "known_at")


@query("fs10_single_time", f"with {FEAT}, r as (select *, row_number() over (partition by USER_NAME order by known_at desc) as n from ft where known_at <= timestamp '2024-01-15') select USER_NAME, known_at as _event_timestamp, round(credits,6) as credits from r where n = 1")
def single_time(spark, d):
    return S.point_in_time(_features(spark, d), "USER_NAME", "2024-01-15 00:00:00", ["credits"], "queries")


@query("fs11_online_table", f"with {FEAT}, r as (select *, row_number() over (partition by USER_NAME order by known_at desc) as n from ft) select USER_NAME, known_at as _event_timestamp, round(credits,6) as credits, queries from r where n = 1")
def online_table(spark, d):
    return S.latest(_features(spark, d), "USER_NAME", ["credits", "queries"], "queries")


@query("fs13_freshness", f"""with {FEAT}, m as (select max(known_at) as t from ft) select 'credits' as feature, t as last_seen, round((epoch(timestamp '{AS_OF}')-epoch(t))/60,6) as age_minutes, case when (epoch(timestamp '{AS_OF}')-epoch(t))/60 <= 1000 then 'fresh' else 'stale' end as status from m union all select 'absent', null, null, 'missing'""")
def freshness(spark, d):
    return S.freshness(_features(spark, d), ["credits", "absent"], AS_OF, 1000)


def _meta(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("feature_group"), F.col("p_type").alias("description"),
                    F.when(F.col("p_size") > 25, "active").otherwise("draft").alias("status"), F.array(F.lower("p_type"), F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("tags"))


@query("fs14_metadata_search", "select p_name || '_' || p_partkey as name, p_brand as feature_group, p_type as description, case when p_size > 25 then 'active' else 'draft' end as status from part where p_size > 25 and (lower(p_type) = 'economy' or p_size = 28) and contains(lower(p_name || '_' || p_partkey), 'red') order by 1 limit 100")
def metadata_search(spark, d):
    return S.search_metadata(_meta(spark, d), status="active", tags=["economy", "s28"], text="RED").drop("tags")


def _edges(spark, d):
    """Lineage from orders: customer c feeds c/2 (a tree), priorities are relations."""
    o = table(spark, d, "orders").filter("o_custkey > 0")
    return o.select(F.concat(F.lit("n"), F.floor(F.col("o_custkey") / 2).cast("string")).alias("source"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("target"),
                    F.lit("derives").alias("relation")).distinct()


def _nodes(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_custkey") % 5 == 0, "model").when(F.col("o_custkey") % 5 == 1, "pipeline").otherwise("feature")
    return o.groupBy(F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("node_id"), kind.alias("node_type")).agg(F.max("o_orderdate").alias("changed_at"))


EDGES = "ed as (select distinct 'n' || (o_custkey // 2) as source, 'n' || o_custkey as target from orders where o_custkey > 0), nd as (select 'n' || o_custkey as node_id, case when o_custkey % 5 = 0 then 'model' when o_custkey % 5 = 1 then 'pipeline' else 'feature' end as node_type, max(o_orderdate) as changed_at from orders group by 1, 2)"


def _reach(name, start, a, b, depth):
    return f"{name} as (select '{start}' as node_id, 0 as depth union select ed.{b}, {name}.depth+1 from {name} join ed on ed.{a} = {name}.node_id where {name}.depth < {depth})"


def _found(name):
    return f"(select node_id, min(depth) as depth from {name} where depth > 0 and node_id <> 'x' group by 1)"


@query("fs15_dependencies", f"with recursive {EDGES}, {_reach('up', 'n700', 'target', 'source', 20)} select node_id, depth from {_found('up')} where node_id <> 'n700'")
def dependencies(spark, d):
    return G.dependencies(_edges(spark, d), "n700")


@query("fs16_cycle_check", f"with recursive {EDGES}, {_reach('dn', 'n5', 'source', 'target', 20)} select cast(count(*) > 0 as int) as would_cycle from dn where node_id = 'n701'")
def cycle_check(spark, d):
    return G.would_cycle(_edges(spark, d), "n5", "n701")


LIN = f"{_reach('up', 'n20', 'target', 'source', 5)}, {_reach('dn', 'n20', 'source', 'target', 5)}"


@query("fs18_lineage", f"with recursive {EDGES}, {LIN}, f as (select node_id, depth, 'upstream' as direction from {_found('up')} union all select node_id, depth, 'downstream' from {_found('dn')}) select f.node_id, depth, direction, node_type from f left join nd using (node_id)")
def lineage(spark, d):
    return G.lineage(_edges(spark, d), _nodes(spark, d), "n20")


@query("fs18_lineage_edges", f"with recursive {EDGES}, {LIN}, f as (select node_id from {_found('up')} union select node_id from {_found('dn')} union select 'n20') select source, target, 'derives' as relation from ed where source in (select node_id from f) and target in (select node_id from f)")
def lineage_edges(spark, d):
    edges = _edges(spark, d)
    return G.edges_within(edges, G.lineage(edges, _nodes(spark, d), "n20"), "n20")


@query("fs19_impact", f"""with recursive {EDGES}, {_reach('dn', 'n20', 'source', 'target', 10)}, f as (select * from {_found('dn')} left join nd using (node_id)) select count(*) filter (depth = 1) as direct, count(*) filter (depth > 1) as indirect, count(*) filter (node_type='pipeline') as pipelines, count(*) filter (node_type='model') as models,
 case when count(*) > 20 then 'high' when count(*) > 5 then 'medium' when count(*) > 0 then 'low' else 'none' end as risk from f""")
def impact(spark, d):
    return G.impact(_edges(spark, d), _nodes(spark, d), "n20")


def _events(spark, d):
    o = table(spark, d, "orders")
    node = lambda k: F.concat(F.lit("n"), k.cast("string"))
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("actor"),
                    F.array(node(F.floor(F.col("o_custkey") / 2)), node(F.col("o_custkey"))).alias("nodes"))


@query("fs20_root_cause", f"""with recursive {EDGES}, {_reach('up', 'n700', 'target', 'source', 10)}, ev as (select unnest(['n' || (o_custkey // 2), 'n' || o_custkey]) as node_id, o_orderdate from orders), c as (select node_id, count(*) as n from ev where o_orderdate >= timestamp '2001-01-01' group by 1)
select f.node_id, f.depth, changed_at, coalesce(c.n,0) as recent_events from {_found('up')} f join nd on nd.node_id = f.node_id left join c on c.node_id = f.node_id where changed_at >= timestamp '2001-01-01'""")
def root_cause(spark, d):
    return G.root_cause(_edges(spark, d), _nodes(spark, d), _events(spark, d), "n700", "2001-01-01 00:00:00")


@query("fs21_timeline", "select o_orderkey as event_id, o_orderpriority as event_type, o_orderdate as \"at\", o_orderstatus as actor from orders where (o_custkey = 20 or o_custkey // 2 = 20) and o_orderdate between timestamp '1996-01-01' and timestamp '2000-01-01'")
def timeline(spark, d):
    return G.timeline(_events(spark, d), "n20", "1996-01-01 00:00:00", "2000-01-01 00:00:00")


@query("fs21_timeline_summary", "select o_orderpriority as event_type, count(*) as events, min(o_orderdate) as first_at, max(o_orderdate) as last_at, count(distinct o_orderstatus) as actors from orders group by 1")
def timeline_summary(spark, d):
    return G.timeline_summary(_events(spark, d))


@query("fs22_tracked_events", "select o_orderpriority as event_type, count(*) as events, min(o_orderdate) as first_at, max(o_orderdate) as last_at, count(distinct o_orderstatus) as actors from orders where o_orderdate >= timestamp '2001-04-23' group by 1")
def tracked_events(spark, d):
    root = _path(spark)
    G.track(_events(spark, d).filter("at >= timestamp_ntz'2001-01-01'"), root)
    return G.timeline_summary(G.live_events(spark.read.parquet(f"{root}/lineage_events"), "2001-08-01 00:00:00", 100))
