"""Relational queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import order as o
from tessera.operators import relational as r
from tessera.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
def tpch_q1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp'1998-09-02 00:00:00'")
    return r.groupby(
        li,
        ["l_returnflag", "l_linestatus"],
        sum_qty=F.round(F.sum("l_quantity"), 2),
        sum_base_price=F.round(F.sum("l_extendedprice"), 2),
        sum_disc_price=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2),
        avg_qty=F.round(F.avg("l_quantity"), 4),
        count_order=F.count("*"),
    )


@R.add(
    "tpch_q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1996-03-15'
    AND l_shipdate > TIMESTAMP '1996-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def tpch_q3(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    od = table(spark, sf_dir, "orders").filter("o_orderdate < timestamp'1996-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate > timestamp'1996-03-15'")
    joined = r.equijoin(r.equijoin(c, od, "c_custkey", "o_custkey"), li, "o_orderkey", "l_orderkey")
    g = r.groupby(joined, ["l_orderkey", "o_orderdate"], revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2))
    return r.ksmallest(g, 10, "revenue desc", "l_orderkey").select("l_orderkey", "revenue", "o_orderdate")


@R.add(
    "tpch_q5",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
    AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""",
)
def tpch_q5(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nations = r.equijoin(t("region").filter("r_name = 'ASIA'"), t("nation"), "r_regionkey", "n_regionkey").select("n_nationkey", "n_name")
    suppliers = r.equijoin(nations, t("supplier"), "n_nationkey", "s_nationkey").select("s_suppkey", "s_nationkey", "n_name")
    sold = r.equijoin(t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), suppliers, "l_suppkey", "s_suppkey")
    bought = r.equijoin(t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey")
    joined = sold.join(bought, (sold.l_orderkey == bought.o_orderkey) & (sold.s_nationkey == bought.c_nationkey))
    return r.groupby(joined, ["n_name"], revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2))


@R.add(
    "tpch_q10",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer, orders, lineitem, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
    GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
def tpch_q10(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    li = r.equijoin(t("lineitem").filter("l_returnflag = 'R'"), t("orders"), "l_orderkey", "o_orderkey")
    c = r.equijoin(t("customer"), t("nation"), "c_nationkey", "n_nationkey")
    g = r.groupby(r.equijoin(li, c, "o_custkey", "c_custkey"), ["c_custkey", "c_name", "n_name"],
        revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2))
    return r.ksmallest(g, 20, "revenue desc", "c_custkey")


@R.add("feedproject", "SELECT c_custkey, c_mktsegment FROM customer")
def feedproject(spark, sf_dir):
    return r.feedproject(spark, f"{sf_dir}/customer.parquet", "c_custkey", "c_mktsegment")


@R.add("project_remove_rename", "SELECT n_nationkey AS n_nationkey_x, n_name AS n_name_x FROM nation")
def project_remove_rename(spark, sf_dir):
    return r.rename(r.remove(table(spark, sf_dir, "nation"), "n_regionkey"), "x")


@R.add("rename_attr_swap", "SELECT n_name AS label, n_nationkey AS id FROM nation")
def rename_attr_swap(spark, sf_dir):
    return r.swap(r.rename_attr(r.project(table(spark, sf_dir, "nation"), "n_nationkey", "n_name"), id="n_nationkey", label="n_name"), "id", "label")


@R.add("filter_pushdown", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N'")
def filter_pushdown(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 45 and l_returnflag <> 'N'").select("l_orderkey", "l_linenumber")


@R.add("extend", "SELECT *, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 48")
def extend(spark, sf_dir):
    return r.extend(table(spark, sf_dir, "lineitem").filter("l_quantity > 48"), net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))


@R.add("project_extend", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders")
def project_extend(spark, sf_dir):
    return r.project_extend(table(spark, sf_dir, "orders"), ["o_orderkey"], y=F.year("o_orderdate"))


@R.add("extend_stream", "SELECT n_nationkey, unnest(range(n_regionkey)) AS k FROM nation")
def extend_stream(spark, sf_dir):
    n, to = table(spark, sf_dir, "nation"), F.col("n_regionkey").cast("long")
    return r.project_extend_stream(n, ["n_nationkey"], k=F.when(to > 0, F.sequence(F.lit(0).cast("long"), to - 1)))


@R.add("extend_x", "SELECT r_regionkey, r_name, upper(r_name) AS r_name_up FROM region")
def extend_x(spark, sf_dir):
    return r.extend_x(table(spark, sf_dir, "region"), ["r_name"], F.upper, "up")


@R.add("apply_to_all", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def apply_to_all(spark, sf_dir):
    return r.apply_to_all(table(spark, sf_dir, "region"), lambda c: c.cast("string"))


@R.add("replace_attr", "SELECT r_regionkey + 10 AS r_regionkey, r_name FROM region")
def replace_attr(spark, sf_dir):
    return r.replace_attr(table(spark, sf_dir, "region"), r_regionkey=F.col("r_regionkey") + 10)


@R.add("to_fields", "SELECT n_nationkey, unnest(['n_name', 'n_regionkey']) AS Field, unnest(['string', 'int']) AS Type, unnest([n_name, n_regionkey::VARCHAR]) AS Value FROM nation")
def to_fields(spark, sf_dir):
    return r.to_fields(table(spark, sf_dir, "nation"), "n_nationkey")


@R.add("from_fields", "SELECT n_nationkey, n_name, n_regionkey, NULL::DOUBLE AS missing FROM nation")
def from_fields(spark, sf_dir):
    return r.from_fields(r.to_fields(table(spark, sf_dir, "nation"), "n_nationkey"), ["n_nationkey"],
        {"n_name": "string", "n_regionkey": "int", "missing": "double"})


@R.add("addcounter", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 99 AS n FROM events")
def addcounter(spark, sf_dir):
    return o.addcounter(table(spark, sf_dir, "events").select("event_id", "ts"), "n", 100, ["ts", "event_id"]).select("event_id", "n")


@R.add("add_mod_counter", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) % 7 AS n FROM events")
def add_mod_counter(spark, sf_dir):
    return o.add_mod_counter(table(spark, sf_dir, "events").select("event_id", "ts"), "n", 7, ["ts", "event_id"]).select("event_id", "n")


@R.add("extend_last", "SELECT event_id, coalesce(round(value - lag(value) OVER (ORDER BY ts, event_id), 6), 0) AS change FROM events")
def extend_last(spark, sf_dir):
    return o.extend_last(table(spark, sf_dir, "events"), ["ts", "event_id"],
        change=(lambda last: F.round(F.col("value") - last("value"), 6), 0.0)).select("event_id", "change")


@R.add("extend_next", "SELECT event_id, lead(event_type) OVER (ORDER BY ts, event_id) AS following FROM events")
def extend_next(spark, sf_dir):
    return o.extend_next(table(spark, sf_dir, "events"), ["ts", "event_id"], following=lambda after: after("event_type")).select("event_id", "following")


@R.add("extend_aggr", "SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def extend_aggr(spark, sf_dir):
    return o.extend_aggr(table(spark, sf_dir, "events"), ["ts", "event_id"], n=("count", "event_id"), top=("max", "value")).select("event_id", "n", "top")


@R.add(
    "sliding_window",
    """WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS total FROM events)
    SELECT w AS "window", count(*) AS n, round(avg(value), 6) AS mean FROM e, range(0, (SELECT (max(total) - 100) // 50 + 1 FROM e)) t(w)
    WHERE i >= w * 50 AND i < w * 50 + 100 GROUP BY w""",
)
def sliding_window(spark, sf_dir):
    return o.sliding_window(table(spark, sf_dir, "events"), 100, 50, ["ts", "event_id"], n=F.count("*"), mean=F.round(F.avg("value"), 6))


@R.add("obojoin", "SELECT a.n_name, b.s_suppkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) b USING (i)")
def obojoin(spark, sf_dir):
    return o.obojoin(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier").select("s_suppkey"), ["n_nationkey"],
        ["s_suppkey"]).select("n_name", "s_suppkey")


@R.add("nth", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 10 = 3")
def nth(spark, sf_dir):
    return o.nth(table(spark, sf_dir, "events").select("event_id", "ts"), 10, ["ts", "event_id"], 3).select("event_id")


@R.add("head", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def head(spark, sf_dir):
    return o.head(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 25, ["o_orderdate", "o_orderkey"])


@R.add("tail", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def tail(spark, sf_dir):
    return o.tail(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 25, ["o_orderdate", "o_orderkey"])


@R.add("cancel", "SELECT event_id FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE value > 95)")
def cancel(spark, sf_dir):
    return o.cancel(table(spark, sf_dir, "events").select("event_id", "value"), F.col("value") > 95, ["event_id"]).select("event_id")


@R.add(
    "reduce_runs",
    """WITH e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM e)
    SELECT run, event_type, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY run, event_type""",
)
def reduce_runs(spark, sf_dir):
    return o.reduce_runs(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], n=F.count("*"), first_id=F.min("event_id"))


@R.add("product", "SELECT n_name, r_name FROM nation, region")
def product(spark, sf_dir):
    return r.product(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"))


@R.add("symmjoin", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice > s_acctbal AND p_size = s_nationkey")
def symmjoin(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return r.symmjoin(p, s, (p.p_retailprice > s.s_acctbal) & (p.p_size == s.s_nationkey),
        4 * spark.sparkContext.defaultParallelism).select("p_partkey", "s_suppkey")


@R.add("symmouterjoin", "SELECT r_name, n_name FROM region FULL JOIN nation ON r_regionkey = n_regionkey AND n_name > 'G'")
def symmouterjoin(spark, sf_dir):
    a, b = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.symmouterjoin(a, b, (a.r_regionkey == b.n_regionkey) & (b.n_name > "G")).select("r_name", "n_name")


JOIN_SQL = "SELECT o_orderkey, l_linenumber, c_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey"


def _join(spark, sf_dir, join):
    od, li, c = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    both = join(od.select("o_orderkey", "o_custkey"), li.select("l_orderkey", "l_linenumber"), "o_orderkey", "l_orderkey")
    return join(both, c.select("c_custkey", "c_name"), "o_custkey", "c_custkey").select("o_orderkey", "l_linenumber", "c_name")


@R.add("hashjoin", JOIN_SQL)
def hashjoin(spark, sf_dir):
    return _join(spark, sf_dir, r.hashjoin)


@R.add("mergejoin", JOIN_SQL)
def mergejoin(spark, sf_dir):
    return _join(spark, sf_dir, r.mergejoin)


@R.add("equijoin", JOIN_SQL)
def equijoin(spark, sf_dir):
    return _join(spark, sf_dir, r.equijoin)


@R.add("smouterjoin", "SELECT c_custkey, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def smouterjoin(spark, sf_dir):
    od = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    return r.smouterjoin(table(spark, sf_dir, "customer").select("c_custkey"), od, "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@R.add("loopjoin", "SELECT n_name, s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > n_regionkey * 1000)")
def loopjoin(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    inner = lambda outer: s.where((F.col("s_nationkey") == outer("n_nationkey")) & (F.col("s_acctbal") > outer("n_regionkey") * 1000)).select("s_suppkey")
    return r.loopjoin(n, inner).select("n_name", "s_suppkey")


@R.add("loopsel", "SELECT s_suppkey, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def loopsel(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return r.loopsel(table(spark, sf_dir, "nation"), lambda outer: s.where(F.col("s_nationkey") == outer("n_nationkey")).select("s_suppkey", "s_name"))


@R.add(
    "matchbelow",
    """SELECT e.event_id, o.o_orderdate, o.o_orderkey FROM (SELECT event_id, value * 1000 AS v FROM events) e
    ASOF LEFT JOIN (SELECT o_totalprice, max(o_orderkey) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders
    GROUP BY o_totalprice) o ON e.v >= o.o_totalprice""",
)
def matchbelow(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 1000).alias("v"))
    od = table(spark, sf_dir, "orders").groupBy("o_totalprice").agg(F.max("o_orderkey").alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))
    return r.matchbelow(e, od, "v", "o_totalprice").select("event_id", "o_orderdate", "o_orderkey")


@R.add(
    "matchbelow_by_key",
    """WITH b AS (SELECT user_id, ts, max(event_id) AS last_buy FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
    SELECT e.event_id, b.last_buy FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts""",
)
def matchbelow_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("bought")).agg(F.max("event_id").alias("last_buy"))
    return r.matchbelow(e.select("event_id", "user_id", "ts"), b, "ts", "bought", ("user_id", "user_id"), ["last_buy"]).select("event_id", "last_buy")


@R.add("aggregates", "SELECT count(*) AS n, round(sum(l_tax), 4) AS s, round(avg(l_quantity), 6) AS m, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(var_samp(l_quantity), 4) AS v FROM lineitem")
def aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("s"), F.round(F.avg("l_quantity"), 6).alias("m"), F.min("l_shipdate").alias("lo"),
            F.max("l_shipdate").alias("hi"), F.round(F.var_samp("l_quantity"), 4).alias("v")
    )


@R.add("stats", "SELECT count(*) AS \"Count\", count(l_quantity) AS CountX, count(l_tax) AS CountY, round(avg(l_quantity), 6) AS AvgX, round(corr(l_quantity, l_tax), 6) AS CorrXY, round(covar_samp(l_quantity, l_tax), 6) AS CovXY FROM lineitem")
def stats(spark, sf_dir):
    s = r.stats(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax")
    return s.select("Count", "CountX", "CountY", *(F.round(c, 6).alias(c) for c in ("AvgX", "CorrXY", "CovXY")))


@R.add("groupby", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY ALL")
def groupby(spark, sf_dir):
    return r.groupby(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], n=F.count("*"), top=F.round(F.max("o_totalprice"), 2))


@R.add("groupby2", "SELECT l_orderkey, sum(l_linenumber * l_linenumber)::BIGINT AS s FROM lineitem GROUP BY l_orderkey")
def groupby2(spark, sf_dir):
    return r.groupby2(table(spark, sf_dir, "lineitem"), ["l_orderkey"], s=("l_linenumber", lambda acc, x: acc + x * x, F.lit(0).cast("long")))


@R.add("aggregate_b", "SELECT max(p_size) AS p_size FROM part")
def aggregate_b(spark, sf_dir):
    return r.fold(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", lambda acc, x: F.greatest(acc, x), 0)


@R.add("nest", "SELECT n_regionkey, list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey)::VARCHAR AS nations FROM nation GROUP BY n_regionkey")
def nest(spark, sf_dir):
    text = F.concat(F.lit("["), F.array_join(F.transform("nations",
        lambda s: F.concat(F.lit("{'n_nationkey': "), s["n_nationkey"].cast("string"), F.lit(", 'n_name': "), s["n_name"], F.lit("}"))), ", "), F.lit("]"))
    return r.nest(table(spark, sf_dir, "nation"), ["n_regionkey"], "nations").select("n_regionkey", text.alias("nations"))


@R.add("unnest", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def unnest(spark, sf_dir):
    return r.unnest(r.nest(table(spark, sf_dir, "nation"), ["n_regionkey"], "nations"), "nations")


@R.add("histogram_equiwidth", "SELECT floor(l_quantity / 5.0)::BIGINT + 1 AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_equiwidth(spark, sf_dir):
    return r.histogram_equiwidth(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 100.0, 20)


@R.add("predcounts", "SELECT (CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END) AS Atom, count(*) AS \"Count\" FROM lineitem GROUP BY 1")
def predcounts(spark, sf_dir):
    return r.predcounts(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_returnflag") == "R")


@R.add("ksmallest", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 12")
def ksmallest(spark, sf_dir):
    return r.ksmallest(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 12, "p_retailprice", "p_partkey")


@R.add("kbiggest", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 12")
def kbiggest(spark, sf_dir):
    return r.kbiggest(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 12, "p_retailprice", "p_partkey")


@R.add("rdup", "SELECT DISTINCT p_brand, p_size FROM part")
def rdup(spark, sf_dir):
    return r.rdup(table(spark, sf_dir, "part").select("p_brand", "p_size"))


@R.add("krdup", "SELECT p_brand, arg_min(p_partkey, p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def krdup(spark, sf_dir):
    return r.krdup(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"])


@R.add("sortby", "SELECT s_suppkey, s_nationkey FROM supplier")
def sortby(spark, sf_dir):
    return r.sortby(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey desc", "s_suppkey")


@R.add("concat", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def concat(spark, sf_dir):
    return r.concat(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select("s_nationkey"))


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


@R.add("mergesec", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def mergesec(spark, sf_dir):
    return r.mergesec(*_keys(spark, sf_dir))


@R.add("mergediff", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def mergediff(spark, sf_dir):
    a, _ = _keys(spark, sf_dir)
    return r.mergediff(a, table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_nationkey"))


@R.add("mergeunion", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def mergeunion(spark, sf_dir):
    return r.mergeunion(*_keys(spark, sf_dir))


@R.add("kmergediff", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def kmergediff(spark, sf_dir):
    return r.kmergediff(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@R.add("exactmatch", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def exactmatch(spark, sf_dir):
    return r.exactmatch(table(spark, sf_dir, "orders"), "o_custkey", 7).select("o_orderkey")


@R.add("range", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 5000")
def range_(spark, sf_dir):
    return r.range_(table(spark, sf_dir, "orders"), "o_totalprice", 1000.0, 5000.0).select("o_orderkey")


@R.add("keyrange", "SELECT round(avg((l_quantity < 10)::INT), 6) AS \"Less\", round(avg((l_quantity = 10)::INT), 6) AS Equal, round(avg((l_quantity > 10)::INT), 6) AS Greater, count(*) AS NumOfKeys FROM lineitem")
def keyrange(spark, sf_dir):
    k = r.keyrange(table(spark, sf_dir, "lineitem"), "l_quantity", 10.0)
    return k.select(*(F.round(c, 6).alias(c) for c in ("Less", "Equal", "Greater")), "NumOfKeys")


@R.add("search_prefix", "SELECT p_partkey FROM part WHERE starts_with(p_name, 's')")
def search_prefix(spark, sf_dir):
    return r.search_prefix(table(spark, sf_dir, "part"), "p_name", "s").select("p_partkey")


@R.add("insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'")
def insert(spark, sf_dir):
    return r.insert(table(spark, sf_dir, "region"), spark.createDataFrame([(99, "NEW")], "r_regionkey int, r_name string"))


@R.add("delete", "SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def delete(spark, sf_dir):
    gone = table(spark, sf_dir, "region").filter("r_name like 'A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    return r.delete(table(spark, sf_dir, "nation"), gone, ["n_regionkey"])


@R.add("update", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update(spark, sf_dir):
    return r.update(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0, s_acctbal=F.lit(0.0))


@R.add("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_average(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))
