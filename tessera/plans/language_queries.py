"""Queries in the operator language and in the SQL dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.plans.dialect import Dialect
from tessera.plans.oplang import Session
from tessera.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

OPLANG = {
    "oplang_filter_project": (
        "query lineitem feed filter[(.l_quantity > 45) and (.l_returnflag # \"N\")] project[l_orderkey, l_linenumber] consume",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N'",
    ),
    "oplang_join_group": (
        "query orders feed project[o_orderkey, o_custkey] customer feed project[c_custkey, c_mktsegment] hashjoin[o_custkey, c_custkey, 99997] sortby[c_mktsegment] groupby[c_mktsegment; n: group feed count, top: group feed max[o_orderkey]] consume",
        "SELECT c_mktsegment, count(*) AS n, max(o_orderkey) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    ),
    "oplang_extend_head": (
        "query part feed extend[dear: .p_retailprice * 2, short: substr(.p_name, 1, 3)] sortby[p_retailprice desc, p_partkey asc] head[7] project[p_partkey, dear, short] consume",
        "SELECT p_partkey, p_retailprice * 2 AS dear, substr(p_name, 1, 3) AS short FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7",
    ),
    "oplang_symmjoin": (
        "query nation feed region feed symmjoin[(.n_regionkey = ..r_regionkey) and (.n_name > \"G\")] project[n_name, r_name]",
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name > 'G'",
    ),
    "oplang_rename_counter": (
        "query nation feed {n} sortby[n_name_n] addcounter[No, 1] project[n_name_n, No]",
        "SELECT n_name AS n_name_n, row_number() OVER (ORDER BY n_name) AS No FROM nation",
    ),
    "oplang_sets": (
        "query customer feed projectextend[; k: .c_nationkey] supplier feed projectextend[; k: .s_nationkey] mergesec rdup",
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    ),
    "oplang_ksmallest": ("query part feed ksmallest[5; p_retailprice, p_partkey] project[p_partkey]",
        "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 5"),
    "oplang_loopjoin": (
        "query nation feed filter[.n_regionkey = 1] loopjoin[supplier feed filter[.s_nationkey = ..n_nationkey]] project[n_name, s_name]",
        "SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1",
    ),
    "oplang_loopsel": (
        "query region feed filter[.r_name = \"ASIA\"] loopsel[nation feed filter[.n_regionkey = ..r_regionkey]] project[n_name]",
        "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "oplang_running": (
        "query orders feed project[o_orderkey, o_custkey] sortby[o_orderkey] extend_aggr[total: sum[o_custkey], n: count[o_custkey]] filter[.o_orderkey mod 5 = 0]",
        "SELECT * FROM (SELECT o_orderkey, o_custkey, sum(o_custkey) OVER w::BIGINT AS total, count(o_custkey) OVER w AS n FROM orders WINDOW w AS (ORDER BY o_orderkey)) WHERE o_orderkey % 5 = 0",
    ),
    "oplang_reduce": (
        "query orders feed sortby[o_orderkey] reduce[o_orderstatus; n: group feed count, lo: group feed min[o_orderkey]]",
        "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS lo FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS run FROM orders) GROUP BY o_orderstatus, run",
    ),
    "oplang_functions_of_values": (
        "query part feed project[p_partkey, p_size] extendX[p_size, p_partkey; . * . + 1; sq] applyToAll[. ++] project[p_size, p_size_sq, p_partkey]",
        "SELECT p_size + 1 AS p_size, p_size * p_size + 2 AS p_size_sq, p_partkey + 1 AS p_partkey FROM part",
    ),
    "oplang_keys": (
        "query part feed range[p_size, 10, 20] krduph[p_size] exactmatch[p_size, 12] project[p_size] part feed leftrange[p_size, 3] part feed rightrange[p_size, 49] concat project[p_size] concat",
        "SELECT DISTINCT p_size FROM part WHERE p_size = 12 UNION ALL SELECT p_size FROM part WHERE p_size <= 3 OR p_size >= 49",
    ),
    "oplang_predcounts": (
        "query lineitem feed predcounts[.l_quantity > 25, .l_tax > 0.04, .l_returnflag = \"R\"]",
        "SELECT (l_quantity > 25)::INT + 2 * (l_tax > 0.04)::INT + 4 * (l_returnflag = 'R')::INT AS Atom, count(*) AS Count FROM lineitem GROUP BY 1",
    ),
    "oplang_counters": (
        "query nation feed sortby[n_name] addModCounter[k, 3] filter[.k = 1] project[n_name, k] sortby[n_name] xth[4]",
        "SELECT n_name, k FROM (SELECT n_name, (row_number() OVER (ORDER BY n_name) - 1) % 3 AS k FROM nation) WHERE k = 1 ORDER BY n_name LIMIT 1 OFFSET 3",
    ),
    "oplang_symmproductextend": (
        "query region feed nation feed symmproductextend[far: abs(.n_regionkey - .r_regionkey)] filter[.far = 2] project[r_name, n_name, far]",
        "SELECT r_name, n_name, abs(n_regionkey - r_regionkey) AS far FROM region, nation WHERE abs(n_regionkey - r_regionkey) = 2",
    ),
    "oplang_fields": (
        "query nation feed project[n_nationkey, n_name, n_regionkey] toFields[n_nationkey] fromFields[n_nationkey; n_name: string, n_regionkey: int]",
        "SELECT n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation",
    ),
    "oplang_obojoin_defaults": (
        "query region feed sortby[r_regionkey] project[r_name] nation feed sortby[n_nationkey] project[n_name] head[7] obojoinD[r_name: \"none\", n_name: \"none\"]",
        "SELECT coalesce(r_name, 'none') AS r_name, coalesce(n_name, 'none') AS n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) FULL JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 7)) USING (i)",
    ),
    "oplang_matchbelow": (
        "query events feed extend[v: .value * 1000] project[event_id, v] orders feed groupby[o_totalprice; k: group feed max[o_orderkey]] matchbelow[v, o_totalprice] project[event_id, k]",
        "SELECT event_id, k FROM events ASOF LEFT JOIN (SELECT o_totalprice, max(o_orderkey) AS k FROM orders GROUP BY o_totalprice) o ON value * 1000 >= o_totalprice",
    ),
    "oplang_merge_insert": (
        "query region feed project[r_name] nation feed project[n_name] renameAttr[r_name: n_name] pMerge[r_name] region feed project[r_name] insert rdup",
        "SELECT r_name FROM region UNION SELECT n_name FROM nation",
    ),
    "oplang_spatialjoin": (
        "query part feed projectextend[p_partkey; a: rectangle2(.p_size, .p_size + 1, 0, 1)] filter[.p_partkey < 200] part feed projectextend[p_partkey; b: rectangle2(.p_size + 1, .p_size + 2, 1, 2)] {q} filter[.p_partkey_q < 200] spatialjoin[a, b_q] project[p_partkey, p_partkey_q]",
        "SELECT a.p_partkey, b.p_partkey AS p_partkey_q FROM part a JOIN part b ON a.p_size <= b.p_size + 2 AND b.p_size + 1 <= a.p_size + 1 WHERE a.p_partkey < 200 AND b.p_partkey < 200",
    ),
    "oplang_overloaded": (
        "query part feed filter[intersects(rectangle2(.p_size, .p_size + 2, 0, 1), rectangle2(10, 12, 1, 3)) or inside(.p_size, create_set(1, 2, 3))] projectextend[p_partkey; d: distance(rectangle2(.p_size, .p_size, 0, 0), rectangle2(20, 20, 0, 0)), n: size(union(create_set(1, 2), create_set(.p_size, 2))), q: .p_size div 7]",
        "SELECT p_partkey, abs(20 - p_size)::DOUBLE AS d, CASE WHEN p_size IN (1, 2) THEN 2 ELSE 3 END AS n, p_size // 7 AS q FROM part WHERE p_size BETWEEN 8 AND 12 OR p_size IN (1, 2, 3)",
    ),
    "oplang_variants": (
        "query nation feed project[n_nationkey, n_regionkey] region feed project[r_regionkey] sortmergejoin_r[n_regionkey, r_regionkey] nation feed project[n_nationkey, n_regionkey] "
        "projectextend[n_nationkey, n_regionkey; r_regionkey: .n_regionkey] punion sorth[n_nationkey] summarize",
        "SELECT n_nationkey, n_regionkey, n_regionkey AS r_regionkey FROM nation, (SELECT unnest([1, 2]))",
    ),
    "oplang_deletedirect": (
        "query nation feed filter[.n_regionkey = 2] project[n_nationkey, n_name] nation feed project[n_nationkey, n_name] deletedirect[n_nationkey]",
        "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2",
    ),
    "oplang_outerjoin": (
        "query customer feed filter[.c_custkey < 50] project[c_custkey] orders feed filter[.o_custkey < 70] project[o_orderkey, o_custkey] outerjoin[c_custkey, o_custkey]",
        "SELECT c_custkey, o_orderkey, o_custkey FROM (SELECT c_custkey FROM customer WHERE c_custkey < 50) FULL JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 70) ON c_custkey = o_custkey",
    ),
    "oplang_groups": (
        "query orders feed groupby[o_custkey; kinds: group feed collect_set[o_orderstatus], all: group feed collect_multiset[o_orderpriority], bits: group feed binands[o_orderkey]]",
        "SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS kinds, list_sort(list(o_orderpriority)) AS \"all\", bit_and(o_orderkey) AS bits FROM orders GROUP BY o_custkey",
    ),
}
#: Queries in the operator language that give a value: name -> (text, SQL for the row that holds it).
VALUES = {
    "oplang_value_fold": ("query part feed aggregateB[p_size; . + ..; 0]", "SELECT sum(p_size)::BIGINT AS value FROM part"),
    "oplang_value_extract": ("query part feed sortby[p_partkey] extractDef[p_name, \"none\"]", "SELECT p_name AS value FROM part ORDER BY p_partkey LIMIT 1"),
    "oplang_value_extract_default": ("query part feed filter[.p_size < 0] extractDef[p_size, 77]", "SELECT 77 AS value"),
    "oplang_value_ensure": ("query supplier feed filter[.s_nationkey = 3] ensure[2]", "SELECT count(*) >= 2 AS value FROM supplier WHERE s_nationkey = 3"),
    "oplang_value_exist": ("query orders feed filter[.o_totalprice < 0] exist", "SELECT count(*) > 0 AS value FROM orders WHERE o_totalprice < 0"),
    "oplang_value_some": ("query orders feed some[.o_totalprice > 400000]", "SELECT max(o_totalprice) > 400000 AS value FROM orders"),
    "oplang_value_ordered": ("query orders feed sortby[o_orderkey] isOrderedBy[o_orderkey]",
        "SELECT count(*) = 0 AS value FROM (SELECT o_orderkey < lag(o_orderkey) OVER (ORDER BY o_orderkey) AS bad FROM orders) WHERE bad"),
    "oplang_value_not_ordered": ("query orders feed sortby[o_orderkey] isOrderedBy[o_custkey]",
        "SELECT count(*) = 0 AS value FROM (SELECT o_custkey < lag(o_custkey) OVER (ORDER BY o_orderkey) AS bad FROM orders) WHERE bad"),
    "oplang_value_object": ("query isDBObject(orders)", "SELECT true AS value FROM orders LIMIT 1"),
    "oplang_value_type": ("query region feed project[r_name] getTypeNL", "SELECT '(rel (tuple ((r_name string))))' AS value FROM region LIMIT 1"),
    "oplang_value_list": ("query query2list(\"orders feed filter[.a > 5] count\")",
        "SELECT '(orders feed filter (.a > 5) count)' AS value FROM orders LIMIT 1"),
    "oplang_value_evaluate": ("query evaluate(\"nation feed filter[.n_regionkey = 2] count\")",
        "SELECT count(*)::INT AS value FROM nation WHERE n_regionkey = 2"),
    "oplang_value_check": ("query checkOperatorTypeMap(ldistance, \"string\", \"string\")", "SELECT 'int' AS value FROM orders LIMIT 1"),
}
DIALECT = {
    "dialect_join": (
        "select [o:o_orderkey as k, c_name] from [orders as o, customer] where [o:o_custkey = c_custkey, o_totalprice > 300000, c_mktsegment # \"BUILDING\"]",
        "SELECT o_orderkey AS k, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 AND c_mktsegment <> 'BUILDING'",
    ),
    "dialect_group_order_first": (
        "select [o_custkey, count(*) as n] from orders where o_orderstatus = \"F\" groupby [o_custkey] orderby [n desc, o_custkey asc] first 9",
        "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 9",
    ),
    "dialect_last": ("select [o_orderkey, o_totalprice] from orders orderby [o_totalprice, o_orderkey] last 6",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 6"),
    "dialect_union": (
        "union [select c_nationkey as k from customer where c_acctbal > 5000, select s_nationkey as k from supplier]",
        "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier",
    ),
    "dialect_subquery": (
        "select distinct [c_mktsegment] from customer where [c_custkey in (select o_custkey from orders where o_totalprice > 250000)]",
        "SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    ),
    "dialect_any": (
        "select [p_partkey] from part where [p_retailprice > any (select l_extendedprice from lineitem where l_quantity = 1), p_size < some (select r_regionkey from region)]",
        "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT min(l_extendedprice) FROM lineitem WHERE l_quantity = 1) AND p_size < (SELECT max(r_regionkey) FROM region)",
    ),
    "dialect_all": (
        "select [o_orderkey] from orders where [o_totalprice >= all (select o_totalprice from orders as p where p:o_orderstatus = \"F\"), o_custkey # all (select c_custkey from customer where c_acctbal < 0), o_orderkey < all (select o_custkey from orders as p where o_custkey < 0)]",
        "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = 'F') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    ),
    "dialect_rowid": (
        "select [count(distinct rowid) as n, min(rowid) as lo, max(rowid) as hi] from nation where n_regionkey >= 0",
        "SELECT count(*) AS n, 1::BIGINT AS lo, count(*) AS hi FROM nation",
    ),
    "dialect_distributed": ("select [n_name, r_name] from [nation_d, region_d] where [n_regionkey = r_regionkey, r_name = \"ASIA\"]",
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "dialect_nonempty": (
        "select nonempty [p_partkey, nullif(p_size, 7) as size] from part where p_partkey < 300",
        "SELECT p_partkey, p_size AS size FROM part WHERE p_partkey < 300 AND p_size <> 7",
    ),
    "dialect_intersection": (
        "intersection [select c_nationkey as k from customer where c_acctbal > 9000, select s_nationkey as k from supplier]",
        "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier",
    ),
    "dialect_aggregates": (
        "select [o_orderstatus, round(var(o_totalprice), 2) as v, extract(o_orderstatus) as one, max(o_orderkey) as top] from orders groupby [o_orderstatus]",
        "SELECT o_orderstatus, round(var_samp(o_totalprice), 2) AS v, o_orderstatus AS one, max(o_orderkey) AS top FROM orders GROUP BY o_orderstatus",
    ),
    "dialect_spatial": (
        "select [a:k as x, b:k as y] from [boxes as a, boxes as b] where [a:box intersects b:box, a:k < b:k, not (a:box inside b:box)]",
        "WITH b AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_partkey % 20 + 0.0 AS y FROM part WHERE p_partkey < 150) SELECT a.k AS x, b.k AS y FROM b a JOIN b ON a.x <= b.x + 1 AND b.x <= a.x + 1 AND a.y <= b.y + 1 AND b.y <= a.y + 1 WHERE a.k < b.k AND NOT (a.x = b.x AND a.y = b.y)",
    ),
    "dialect_exists": (
        "select [p_partkey] from part where [not exists (select l_orderkey from lineitem where [l_partkey = p_partkey, l_quantity > 49])]",
        "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    ),
}


def _tables(spark, sf_dir) -> dict:
    return {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}


for _name, (_text, _sql) in OPLANG.items():
    R.add(_name, _sql)(lambda spark, sf_dir, text=_text: Session(spark, _tables(spark, sf_dir)).run(text))


def _dialect(spark, sf_dir, text):
    for n, df in _tables(spark, sf_dir).items():
        df.createOrReplaceTempView(n)
    size, y = F.col("p_size").cast("double"), F.col("p_partkey") % 20 + 0.0
    table(spark, sf_dir, "part").filter("p_partkey < 150").select(F.col("p_partkey").alias("k"),
        scalars.rectangle(size, size + 1, y, y + 1).alias("box")).createOrReplaceTempView("boxes")
    return Dialect(spark).run(text)


for _name, (_text, _sql) in VALUES.items():
    R.add(_name, _sql)(lambda spark, sf_dir, text=_text: _one(spark, Session(spark, _tables(spark, sf_dir)).run(text)))


def _one(spark, value):
    """A value as a table of one row."""
    return spark.createDataFrame([(value,)], f"value { {bool: 'boolean', int: 'long', str: 'string'}[type(value)] }")


for _name, (_text, _sql) in DIALECT.items():
    R.add(_name, _sql)(lambda spark, sf_dir, text=_text: _dialect(spark, sf_dir, text))


@R.add("dialect_changes",
    "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'TWO' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 7, 'SEVEN'")
def dialect_changes(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    d = Dialect(spark)
    d.run("let land = select * from region")
    d.run('insert into land values [7, "SEVEN"]')
    d.run("delete from land where r_regionkey = 3")
    d.run('update land set [r_name = "TWO"] where r_regionkey = 2')
    return d.run("select [r_regionkey, r_name] from land")


@R.add("dialect_tables", "SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'NOWHERE', 9")
def dialect_tables(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    d = Dialect(spark)
    d.run("create table places columns [name: string, region: int]")
    d.run("create index on places columns [name] indextype btree")
    d.run('insert into places values ["NOWHERE", 9]')
    d.run("insert into places select [n_name, n_regionkey] from nation where n_regionkey = 3")
    out = d.run("select [name, region] from places")
    d.run("drop index places_name")
    d.run("drop table places")
    return out
