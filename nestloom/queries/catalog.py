"""All queries of the document engine, with their SQL counterparts. Sums and means of doubles are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import algebra_frames
from ..operators import coverage, history
from ..operators.multi import MultiQuery
from ..operators.relational import rows
from ..plans import dialects
from ..plans.build import field
from ..sources.session import Session

#: Tables and their keys.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": ["l_orderkey", "l_linenumber"], "events": "event_id", "conversations": ["conv_id", "turn"]}


def session(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    s = Session(spark)
    for n in names or KEYS:
        s.bind(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), KEYS[n])
    return s


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def text(name: str, source: str, sql: str, tables: tuple[str, ...], drop: tuple[str, ...] = (), **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(session(spark, sf_dir, *tables).run_all(source, **params).drop(*drop))

    _queries[name], _sql[name] = run, sql


def frame(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


O, L, C, E = ("orders",), ("lineitem",), ("customer",), ("events",)
_OK, _CK = "CAST(o_orderkey AS VARCHAR) AS _key", "CAST(c_custkey AS VARCHAR) AS _key"

text("topk_orders", 'from orders where o_orderstatus = "P" project o_orderkey, o_totalprice order by o_totalprice desc limit 10', f"SELECT {_OK}, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY orders.o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10", O)
text("where_equal", 'from orders where o_orderstatus = "F" project o_orderkey', f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderstatus = 'F'", O)
text("where_not_equal", 'from orders where o_orderstatus != "F" project o_orderkey', f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderstatus <> 'F'", O)
text("where_range", "from orders where o_totalprice >= 1000 and o_totalprice < 50000 project o_orderkey", f"SELECT {_OK}, o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000", O)
text("where_time_range", 'from orders where o_orderdate >= "1996-01-01" and o_orderdate < "1997-01-01" project o_orderkey', f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'", O)
text("where_paths", "from lineitem where l_partkey < l_suppkey project l_orderkey, l_linenumber", "SELECT l_orderkey || '/' || l_linenumber AS _key, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey", L)
text("where_in", 'from orders where o_orderpriority in ["1-URGENT", "2-HIGH"] project o_orderkey', f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", O)
text("where_not_in", 'from orders where o_orderpriority not in ["1-URGENT", "2-HIGH"] project o_orderkey', f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", O)
text("where_present_missing", "from orders where present(o_orderstatus) and missing(no_such_field) project o_orderkey", f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL", O)
text("where_not_null", "from orders where o_orderstatus is not null and not (o_orderstatus is null) project o_orderkey", f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL", O)
text("where_starts_with", 'from part where starts_with(p_type, "S") project p_partkey, p_type', "SELECT CAST(p_partkey AS VARCHAR) AS _key, p_partkey, p_type FROM part WHERE p_type LIKE 'S%'", ("part",))
text("where_contains", 'from part where contains(p_name, "a") and p_type contains "E" project p_partkey', "SELECT CAST(p_partkey AS VARCHAR) AS _key, p_partkey FROM part WHERE contains(p_name, 'a') AND contains(p_type, 'E')", ("part",))
text("where_boolean", 'from orders where not (o_orderstatus = "F" or o_totalprice > 100000) and (true or false) project o_orderkey', f"SELECT {_OK}, o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)", O)
text("where_not_absent", 'from orders where not (no_such_field = 1) project o_orderkey', f"SELECT {_OK}, o_orderkey FROM orders", O)
text("where_parameter", "from orders where o_orderstatus = $st project o_orderkey", f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderstatus = 'O'", O, st="O")
text("group_count", "from lineitem group by l_returnflag project l_returnflag, count() as n", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag", L)
text("group_aggregates", "from lineitem group by l_returnflag, l_linestatus project l_returnflag, count() as n, sum(l_quantity) as total, min(l_extendedprice) as lo, max(l_extendedprice) as hi, avg(l_discount) as mean", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(min(l_extendedprice), 2) AS lo, round(max(l_extendedprice), 2) AS hi, round(avg(l_discount), 2) AS mean FROM lineitem GROUP BY ALL", L)
text("group_filtered", 'from orders where o_orderstatus = "O" group by o_custkey project o_custkey, count() as n', "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey", O)
text("group_many_keys", "from lineitem group by l_orderkey project l_orderkey, count() as n, sum(l_extendedprice) as total", "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey", L)
text("group_keys_only", "from orders group by o_orderpriority, o_orderstatus", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders", O)
text("group_by_document_key", "from customer group by _key project _key, count() as n", "SELECT CAST(c_custkey AS VARCHAR) AS _key, count(*) AS n FROM customer GROUP BY 1", C)
text("group_order_limit", "from lineitem group by l_suppkey project l_suppkey, count() as n order by n desc, l_suppkey asc limit 7", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 7", L)
text("aggregate_global", "from orders project count() as n, min(o_totalprice) as lo, max(o_totalprice) as hi, avg(o_totalprice) as mean", "SELECT count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(avg(o_totalprice), 2) AS mean FROM orders HAVING count(*) > 0", O)
text("aggregate_global_empty", "from orders where o_totalprice < 0 project count() as n", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0", O)
text("aggregate_text_ignored", "from orders group by o_orderstatus project o_orderstatus, sum(o_orderpriority) as total, max(o_orderpriority) as hi", "SELECT o_orderstatus, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS hi FROM orders GROUP BY o_orderstatus", O)
text("order_two_terms", "from customer order by c_mktsegment asc, c_acctbal desc limit 25 project c_custkey", f"SELECT {_CK}, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 25", C)
text("order_by_key", "from nation order by _key asc limit 5 project n_name", "SELECT CAST(n_nationkey AS VARCHAR) AS _key, n_name FROM nation ORDER BY 1 LIMIT 5", ("nation",))
text("project_block", 'from orders project { id: o_orderkey, o_totalprice, level: if o_totalprice < 1000 then "low" else if o_totalprice < 100000 then "mid" else "high" }', f"SELECT {_OK}, o_orderkey AS id, round(o_totalprice, 2) AS o_totalprice, CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 100000 THEN 'mid' ELSE 'high' END AS level FROM orders", O)
text("project_computed", 'from orders project o_orderkey, urgent = if o_orderpriority = "1-URGENT" then true else false', f"SELECT {_OK}, o_orderkey, o_orderpriority = '1-URGENT' AS urgent FROM orders", O)
text("enrich_exactly_one", "from orders enrich customer using customer matching o_custkey = c_custkey expect exactly_one project { o_orderkey, segment: customer.c_mktsegment }", f"SELECT {_OK}, o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey", ("orders", "customer"))
text("enrich_optional", 'from orders enrich c using customer matching o_custkey = c_custkey where c_mktsegment = "BUILDING" expect optional project { o_orderkey, customer: c.c_custkey }', f"SELECT {_OK}, o_orderkey, c_custkey AS customer FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey", ("orders", "customer"))
text("enrich_post_where", 'from orders enrich c using customer matching o_custkey = c_custkey expect optional where c.c_acctbal > 5000 project { o_orderkey }', f"SELECT {_OK}, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000", ("orders", "customer"))
text("enrich_two_levels", "from customer enrich nation using nation matching c_nationkey = n_nationkey expect exactly_one enrich region using region matching nation.n_regionkey = r_regionkey expect exactly_one project { c_custkey, nation: nation.n_name, region: region.r_name }", f"SELECT {_CK}, c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", ("customer", "nation", "region"))
text("enrich_none_is_anti", 'from customer enrich orders using orders matching c_custkey = o_custkey where o_orderpriority = "1-URGENT" expect many where orders = [] project { c_custkey }', f"SELECT {_CK}, c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", ("customer", "orders"))
text("enrich_some_is_semi", "from customer enrich orders using orders matching c_custkey = o_custkey where o_totalprice > 100000 expect many where orders != [] project { c_custkey }", f"SELECT {_CK}, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", ("customer", "orders"))


@frame("enrich_many", "SELECT CAST(o_orderkey AS VARCHAR) AS _key, count(l_orderkey) AS n, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _many(spark, sf_dir):
    df = session(spark, sf_dir, "orders", "lineitem").run_all("from orders enrich items using lineitem matching o_orderkey = l_orderkey expect many project { items { l_quantity } }")
    return df.select("_key", F.size("items").cast("bigint").alias("n"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2).alias("quantity"))


@frame("within_where_project", "SELECT CAST(o_orderkey AS VARCHAR) AS _key, l_linenumber AS line, round(l_quantity, 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 30")
def _within(spark, sf_dir):
    df = session(spark, sf_dir, "orders", "lineitem").run_all("from orders enrich items using lineitem matching o_orderkey = l_orderkey expect many within items as item { where item.l_quantity > 30 project { line: l_linenumber, quantity: l_quantity } }")
    return _rounded(df.select("_key", F.inline("items")))


@frame("within_enrich", "SELECT CAST(o_orderkey AS VARCHAR) AS _key, l_linenumber, p_brand AS brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P'")
def _within_enrich(spark, sf_dir):
    df = session(spark, sf_dir, "orders", "lineitem", "part").run_all('from orders where o_orderstatus = "P" enrich items using lineitem matching o_orderkey = l_orderkey expect many within items as item { enrich part using part as p matching item.l_partkey = p.p_partkey expect exactly_one } project { items { l_linenumber, part { p_brand } } }')
    return df.select("_key", F.explode("items").alias("i")).select("_key", "i.l_linenumber", F.col("i.part.p_brand").alias("brand"))


@frame("key_get", "SELECT CAST(o_orderkey AS VARCHAR) AS _key, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def _get(spark, sf_dir):
    return session(spark, sf_dir, "orders").collection("orders").find("7").select("_key", "o_orderkey", "o_orderstatus")


@frame("key_get_many", "SELECT k AS _key, o_orderkey IS NOT NULL AS found_, o_orderkey FROM (VALUES ('1'), ('2'), ('nope')) v(k) LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = k")
def _get_many(spark, sf_dir):
    return session(spark, sf_dir, "orders").collection("orders").get_many(["1", "2", "nope"]).select("_key", "found_", "o_orderkey")


@frame("scan_page", f"SELECT {_CK}, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) > '100' ORDER BY 1 LIMIT 20")
def _scan_page(spark, sf_dir):
    return session(spark, sf_dir, "customer").collection("customer").scan_page(20, after_key="100")[0].select("_key", "c_name")


@frame("scan_fields", f"SELECT {_CK}, c_mktsegment FROM customer")
def _scan_fields(spark, sf_dir):
    return session(spark, sf_dir, "customer").collection("customer").scan_fields("c_mktsegment")


@frame("pages_concatenated", f"SELECT {_CK}, c_custkey FROM customer WHERE c_acctbal > 9000")
def _pages(spark, sf_dir):
    return session(spark, sf_dir, "customer").pages_together("from customer where c_acctbal > 9000 project c_custkey order by c_mktsegment desc, c_acctbal asc page size 64")


@frame("upsert_delete", "SELECT * FROM (SELECT CAST(r_regionkey AS VARCHAR) AS _key, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 2)")
def _upsert(spark, sf_dir):
    c = session(spark, sf_dir, "region").collection("region")
    c.put(c.df.where("_key = '1'").withColumn("r_name", F.lit("changed")))
    c.delete(spark.createDataFrame([("2",)], "_key string"))
    return c.df.select("_key", "r_name")


@frame("multi_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 50000 AND c_mktsegment = 'BUILDING'")
def _multi(spark, sf_dir):
    s = session(spark, sf_dir, "orders", "customer", "nation")
    q = MultiQuery(s).from_("orders", "o").where(dialects.object_filter({"o_totalprice": {"$gt": 50000}})).join("customer", "c").on("o_custkey", "c_custkey").where(dialects.object_filter({"c_mktsegment": "BUILDING"})).join("nation", "n").on("c_nationkey", "n_nationkey")
    return q.collect_frame().select("o.o_orderkey", "c.c_name", "n.n_name")


@frame("multi_join_from", "SELECT s_suppkey, p_partkey, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size < 5")
def _multi_from(spark, sf_dir):
    s = session(spark, sf_dir, "lineitem", "supplier", "part")
    q = MultiQuery(s).from_("lineitem", "l").join("supplier", "s").on("l_suppkey", "s_suppkey").join("part", "p").on_from("l", "l_partkey", "p_partkey").where(dialects.object_filter({"p_size": {"$lt": 5}}))
    return q.collect_frame().select("s.s_suppkey", "p.p_partkey", "l.l_orderkey")


@frame("object_filter", f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_totalprice < 20000 OR o_orderpriority LIKE '1%') AND NOT (o_custkey IN (1, 2, 3))")
def _filter(spark, sf_dir):
    test = dialects.json_filter('{"o_orderstatus": {"$ne": "F"}, "$or": [{"o_totalprice": {"$lt": 20000}}, {"o_orderpriority": {"$prefix": "1"}}], "$not": {"o_custkey": {"$in": [1, 2, 3]}}, "nothing": {"$exists": false}}')
    return session(spark, sf_dir, "orders").collection("orders").where(test).select("_key", "o_orderkey")


@frame("small_sql", "SELECT CAST(p_partkey AS VARCHAR) AS _key, p_partkey, p_brand FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand <> 'Brand#11'")
def _small_sql(spark, sf_dir):
    q = dialects.small_sql("SELECT p_partkey, p_brand FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_brand <> 'Brand#11' AND nothing IS NULL")
    return session(spark, sf_dir, q.source).collection(q.source).where(q.where).select("_key", *q.columns)


@frame("sql_rewritten", f"SELECT {_OK}, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY orders.o_totalprice DESC LIMIT 5")
def _sql_plus(spark, sf_dir):
    emitted = dialects.sql_to_text("SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_orderstatus = :st ORDER BY o.o_totalprice DESC LIMIT 5")
    return _rounded(session(spark, sf_dir, "orders").run_all(emitted.text, st="O"))


@frame("variant_filter", "SELECT CAST(event_id AS VARCHAR) AS _key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def _variant(spark, sf_dir):
    s = Session(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("_key"), F.col("props").alias("value"))
    s.bind_json("events", events)
    return s.run_all("from events where k >= 50").select("_key", F.expr("try_variant_get(doc, '$.k', 'bigint')").alias("k"))


@frame("variant_group", "SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS k, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS DOUBLE) AS total FROM events GROUP BY 1")
def _variant_group(spark, sf_dir):
    s = Session(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("_key"), F.col("props").alias("value"))
    s.bind_json("events", events)
    return _rounded(s.run_all("from events group by k project k, count() as n, sum(k) as total"))


@frame("algebra_filter", f"SELECT {_CK}, c_custkey FROM customer WHERE c_acctbal > 1000 AND starts_with(c_mktsegment, 'B')")
def _algebra(spark, sf_dir):
    df = session(spark, sf_dir, "customer").collection("customer").df
    return algebra_frames.filter_rows(df, rows(df, False, None), 'input<c_acctbal> > 1000 and startsWith(input<c_mktsegment>, "B")').select("_key", "c_custkey")


@frame("algebra_map", "SELECT n_nationkey, n_nationkey * 2 + 1 AS result FROM nation")
def _algebra_map(spark, sf_dir):
    df = session(spark, sf_dir, "nation").collection("nation").df
    got = algebra_frames.map_rows(df, "let k = input<n_nationkey>; Seq[k, k] |> only(Bag{ { yield x * 2 + 1 | x in _ } }) |> first(_) |> orElseOpt(_, None) |> mapOpt(_, v => v);")
    return got.select(F.get_json_object("doc", "$.n_nationkey").cast("int").alias("n_nationkey"), F.get_json_object("result", "$['$value']").cast("int").alias("result"))


for _op, _word in (("union", "UNION"), ("inter", "INTERSECT"), ("diff", "EXCEPT"), ("bunion", "UNION ALL"), ("bdiff", "EXCEPT ALL")):

    def _set(spark, sf_dir, op=_op):
        c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 120).alias("k"))
        s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * 2 % 150).alias("k"))
        return algebra_frames.set_operation(op, c, s)

    frame(f"set_{_op}", f"SELECT c_custkey % 120 AS k FROM customer {_word} SELECT s_suppkey * 2 % 150 AS k FROM supplier")(_set)


@frame("bag_difference_arrays", "SELECT c_nationkey AS k, greatest(count(*) - coalesce(any_value(n), 0), 0) AS left_over FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey GROUP BY 1")
def _bags(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_list("c_nationkey").alias("a"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_list("s_nationkey").alias("b"))
    both = c.join(s, "k", "left").withColumn("b", F.coalesce("b", F.array().cast("array<int>")))
    return both.select("k", F.size(algebra_frames.bag_difference(F.col("a"), F.col("b"))).cast("bigint").alias("left_over"))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: each user is a document, its clicks of type 'purchase' delete it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_id", F.when(F.col("event_type") == "purchase", "delete").otherwise("put").alias("kind"), F.col("props").alias("body"))


_LOG = "(SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'put' END AS kind, props AS body FROM events)"


@frame("history_of_key", f"SELECT key, seq, kind FROM {_LOG} WHERE key = 1")
def _history(spark, sf_dir):
    return history.history(_event_log(spark, sf_dir), 1).select("key", "seq", "kind")


@frame("live_state", f"SELECT key, body, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {_LOG}) WHERE r = 1 AND kind = 'put'")
def _live(spark, sf_dir):
    return history.live_state(_event_log(spark, sf_dir))


@frame("exact_version", f"SELECT key, seq, CASE WHEN kind = 'put' THEN body END AS body, kind = 'delete' AS tombstone FROM {_LOG} WHERE seq = 17")
def _version(spark, sf_dir):
    return history.version(_event_log(spark, sf_dir), 17)


@frame("last_complete_version", f"SELECT key, body, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r2 FROM (SELECT *, row_number() OVER w AS age, sum(CASE WHEN kind = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq DESC) AS dels FROM {_LOG} WINDOW w AS (PARTITION BY key ORDER BY seq DESC)) WHERE age > 1 AND kind = 'put' AND dels = 0) WHERE r2 = 1")
def _last_complete(spark, sf_dir):
    return history.last_complete(_event_log(spark, sf_dir))


@frame("replica_conflicts", "SELECT o_custkey AS subject, count(DISTINCT o_orderstatus) AS bodies, count(*) AS replicas FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _conflicts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return history.conflicts(o.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("body")))


@frame("examine_by_status", "SELECT CASE WHEN event_id % 5 = 0 THEN 'hole' WHEN event_id % 3 = 0 THEN 'unverified' ELSE 'verified' END AS status, count(*) AS units FROM events GROUP BY 1")
def _examine(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    digest = F.when(F.col("event_id") % 3 == 0, "wrong").otherwise(F.sha2("props", 256))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("key"), F.lit("put").alias("kind"), F.col("props").alias("body"), digest.alias("sha256")))
    return coverage.by_status(coverage.examine(e.select(F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(line).alias("value")))).select("status", "units")


#: Partitions of a key as coverage deals them, and those that the queries below can reach.
_PART, _REACHED = "(('0x' || md5(CAST(o_orderkey AS VARCHAR))[1:8])::BIGINT % 64)", [p for p in range(coverage.PARTITIONS) if p % 7]


@frame("partition_coverage", f"SELECT CAST(p AS INTEGER) AS part, CASE WHEN p % 7 <> 0 THEN 'completed' ELSE 'unavailable' END AS state, CASE WHEN p % 7 <> 0 THEN coalesce(n, 0) END AS n FROM range(64) r(p) LEFT JOIN (SELECT {_PART} AS part, count(*) AS n FROM orders GROUP BY 1) ON p = part")
def _coverage(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return coverage.partition_coverage(o, "o_orderkey", _REACHED)


@frame("scatter_scan_pages", f"SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS place FROM orders WHERE {_PART} % 7 <> 0 AND o_orderstatus = 'P' ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 100")
def _scatter(spark, sf_dir):
    """Two pages of a scan over the partitions that can be reached, the second from where the first ends."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'")
    one = coverage.scatter_scan(o, "o_orderkey", _REACHED, 40)
    two = coverage.scatter_scan(o, "o_orderkey", _REACHED, 60, one.next)
    key = F.col("o_orderkey").cast("string")
    return one.rows.unionByName(two.rows).select("o_orderkey", F.row_number().over(Window.orderBy(key)).cast("bigint").alias("place"))


@frame("filter_order_by", f"SELECT {_CK}, c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY customer.c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 15")
def _filter_order(spark, sf_dir):
    c = session(spark, sf_dir, "customer").collection("customer")
    return _rounded(c.select(dialects.object_filter({"c_mktsegment": "BUILDING"})).order_by("c_acctbal", desc=True).limit(15).project("c_custkey", "c_acctbal").frame())


@frame("built_plan", f"SELECT {_OK}, o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus = 'F' AND c_acctbal >= 0")
def _built(spark, sf_dir):
    s = session(spark, sf_dir, "orders", "customer")
    test = field("o_totalprice").gt(50000) & field("o_orderpriority").is_in("1-URGENT", "2-HIGH") & ~field("o_orderstatus").eq("F")
    return s.collection("orders").query().where(test).enrich("c", "customer", "o_custkey", "c_custkey", "exactly_one").keep(field("c.c_acctbal").ge(0)).block(o_orderkey="o_orderkey", segment="c.c_mktsegment").run_all()


@frame("covered_keys", "SELECT k AS _key, CASE WHEN CAST(k AS BIGINT) % 10 = 0 THEN 'hole' WHEN event_id IS NULL THEN 'absent' ELSE 'present' END AS status FROM (VALUES ('1'), ('10'), ('25'), ('30'), ('99999999')) v(k) LEFT JOIN events ON CAST(event_id AS VARCHAR) = k")
def _covered(spark, sf_dir):
    return _holey(spark, sf_dir).covered(["1", "10", "25", "30", "99999999"]).select("_key", "status")


@frame("covered_page", "SELECT CAST(event_id AS VARCHAR) AS _key, CASE WHEN event_id % 10 = 0 THEN 'hole' ELSE 'present' END AS status FROM events ORDER BY 1 LIMIT 50")
def _covered_page(spark, sf_dir):
    c = _holey(spark, sf_dir)
    one, token = c.scan_covered_page(20)
    return one.unionByName(c.scan_covered_page(30, token)[0]).select("_key", "status")


def _holey(spark: SparkSession, sf_dir: str):
    """events as documents; every tenth can't be read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = Session(spark)
    return s.bind_json("events", e.select(F.col("event_id").alias("_key"), F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props")).alias("value")))


@frame("budget_soft_stop", f"SELECT {_CK}, c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer ORDER BY 1 LIMIT 100) AND c_acctbal > 0")
def _budget(spark, sf_dir):
    """The first hundred documents by key are all that the query may read."""
    return session(spark, sf_dir, "customer").run_all("from customer where c_acctbal > 0 project c_custkey budget { documents: 100 } coverage incomplete")


@frame("group_pages", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _group_pages(spark, sf_dir):
    return session(spark, sf_dir, "lineitem").pages_together("from lineitem group by l_suppkey project l_suppkey, count() as n order by n desc, l_suppkey asc page size 40")


@frame("algebra_match", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def _match(spark, sf_dir):
    got = session(spark, sf_dir, "customer", "orders").match("customer", "orders", "Match(l, r, x => x<c_custkey>, y => y<o_custkey>);")
    return got.select("left.c_custkey", "right.o_orderkey")


@frame("algebra_bound", "SELECT CAST(p_partkey AS VARCHAR) AS _key, p_partkey FROM part WHERE p_size * 2 + 1 > 60 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
def _algebra_bound(spark, sf_dir):
    got = session(spark, sf_dir, "part").collection("part").where_sda("input<p_size> * 2 + 1 > least and (input<p_brand> in brands);", least=60, brands=["Brand#11", "Brand#12", "Brand#23"])
    return got.select("_key", "p_partkey")


@frame("algebra_over_collections", "SELECT n_name AS result FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def _algebra_over(spark, sf_dir):
    s = session(spark, sf_dir, "nation", "region")
    got = s.algebra('let keys = { yield r<r_regionkey> | r in region | r<r_name> = which }; { yield n<n_name> | n in nation | n<n_regionkey> in keys };', "nation", "region", which="ASIA")
    return spark.createDataFrame([(x,) for x in got], "result string")


@frame("put_newest", "SELECT CAST(user_id AS VARCHAR) AS _key, max(event_id) AS event_id FROM events GROUP BY user_id")
def _put_newest(spark, sf_dir):
    """Of repeated keys the document of the greatest version is put."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("_key"), "event_id")
    c = Session(spark).bind("latest", e.limit(0), "_key")
    c.put(e.withColumn("version", F.col("event_id")), version="version")
    return c.df


@frame("filter_as_algebra", f"SELECT {_OK}, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_totalprice < 20000 OR starts_with(o_orderpriority, '1')) AND o_custkey NOT IN (1, 2, 3)")
def _filter_as_algebra(spark, sf_dir):
    """An object filter, run by the algebra."""
    test = dialects.json_filter('{"o_orderstatus": {"$ne": "F"}, "$or": [{"o_totalprice": {"$lt": 20000}}, {"o_orderpriority": {"$prefix": "1"}}], "$not": {"o_custkey": {"$in": [1, 2, 3]}}}')
    return session(spark, sf_dir, "orders").collection("orders").where_sda(dialects.to_algebra(test) + ";").select("_key", "o_orderkey")


@frame("result_bytes", f"SELECT _key, r_regionkey FROM (SELECT CAST(r_regionkey AS VARCHAR) AS _key, r_regionkey, sum(strlen('{{\"_key\":\"' || r_regionkey || '\",\"r_regionkey\":' || r_regionkey || '}}')) OVER (ORDER BY r_regionkey) AS total FROM region) WHERE total <= 80")
def _result_bytes(spark, sf_dir):
    """As many rows in order as fit into the bytes of the result."""
    return session(spark, sf_dir, "region").run_all("from region project r_regionkey order by _key budget { result_bytes: 80 } coverage incomplete")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
