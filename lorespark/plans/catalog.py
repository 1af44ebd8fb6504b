"""Queries over the relational catalogue; the driver's star schema stands in for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.operators import etl, integrity, joins
from lorespark.plans import Tables, all_of, query


@query("SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_join(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))


@query("""SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def two_hop_join(t: Tables) -> DataFrame:
    near = t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(near, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name", "r_name")


@query("""SELECT p_partkey, list_sort(list(DISTINCT s_name)) AS suppliers, count(DISTINCT s_name) AS n FROM part
          JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_partkey""")
def junction_lists(t: Tables) -> DataFrame:
    links = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    named = links.join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    lists = named.groupBy("l_partkey").agg(F.array_sort(F.collect_set("s_name")).alias("suppliers"))
    return t.part.join(lists, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "suppliers", F.size("suppliers").cast("bigint").alias("n"))


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY ALL""")
def left_join_counts(t: Tables) -> DataFrame:
    counts = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000 WHERE o_orderkey IS NULL")
def childless_parents(t: Tables) -> DataFrame:
    return integrity.childless(t.customer, t.orders.filter("o_totalprice > 450000"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40)")
def orphans_not_exists(t: Tables) -> DataFrame:
    return integrity.orphans(t.lineitem, t.part.filter("p_size < 40"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.095)")
def not_in_subquery(t: Tables) -> DataFrame:
    return joins.not_in(t.supplier.select("s_suppkey"), "s_suppkey", t.lineitem.filter("l_quantity > 49 and l_discount > 0.095"), "l_suppkey")


@query("SELECT c_custkey FROM customer WHERE nullif(c_custkey % 3, 0) NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 2 AND 5)")
def not_in_null_keys(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.nullif(F.col("c_custkey") % 3, F.lit(0)).alias("k"))
    return joins.not_in(rows, "k", t.nation.filter("n_nationkey between 2 and 5").select(F.col("n_nationkey").alias("l")), "l").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)")
def not_in_null_list(t: Tables) -> DataFrame:
    return joins.not_in(t.customer.select("c_custkey"), "c_custkey", t.nation.select(F.nullif("n_nationkey", F.lit(3)).alias("l")), "l")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_in(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("""SELECT s_suppkey FROM supplier LEFT JOIN (
            SELECT l_suppkey, bool_or(l_returnflag = 'A') AS inc, bool_or(l_returnflag IN ('A', 'R')) AS any_ex FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) ON s_suppkey = l_suppkey
          WHERE coalesce(inc, false) OR NOT coalesce(any_ex, false)""")
def include_or_not_exclusive(t: Tables) -> DataFrame:
    tags = t.lineitem.filter("l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
    exclusive = t.lineitem.select("l_returnflag").filter("l_returnflag in ('A', 'R')")
    return joins.include_or_not_exclusive(t.supplier, tags, "s_suppkey", "l_returnflag", "A", exclusive).select("s_suppkey")


@query("""SELECT a.p_name AS name, b.p_name AS longer FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b
          ON starts_with(b.p_name, split_part(a.p_name, ' ', 1)) AND a.p_name <> b.p_name""")
def prefix_join(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    pairs = joins.starting_with(names, "name", F.split_part("name", F.lit(" "), F.lit(1)), names.withColumnRenamed("name", "longer"), "longer")
    return pairs.filter("name <> longer")


@query("""SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_nations,
                 (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n_suppliers,
                 (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n_customers FROM region""")
def fan_out_counts(t: Tables) -> DataFrame:
    """Each side is counted before it is joined, so that nothing fans out."""
    per = lambda rows, key, name: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)).withColumnRenamed(key, "n_nationkey")
    n = t.nation.join(per(t.supplier, "s_nationkey", "s"), "n_nationkey", "left").join(per(t.customer, "c_nationkey", "c"), "n_nationkey", "left")
    sums = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n_nations"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    return t.region.join(sums, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", F.coalesce("n_nations", F.lit(0)).alias("n_nations"), F.coalesce("s", F.lit(0)).alias("n_suppliers"), F.coalesce("c", F.lit(0)).alias("n_customers"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') AND p_type LIKE '%Y' AND (p_size > 20 OR p_brand IN ('Brand#11', 'Brand#12'))")
def dynamic_predicates(t: Tables) -> DataFrame:
    conditions = [text.contains_ci(F.col("p_name"), "RE"), F.col("p_type").like("%Y"), (F.col("p_size") > 20) | F.col("p_brand").isin("Brand#11", "Brand#12")]
    return t.part.filter(all_of(conditions)).select("p_partkey", "p_name")


@query("SELECT n_name FROM nation WHERE lower(n_name) = lower('NaTiOn_7')")
def case_insensitive_exact(t: Tables) -> DataFrame:
    return t.nation.filter(F.lower("n_name") == F.lower(F.lit("NaTiOn_7"))).select("n_name")


@query("""WITH q(q) AS (VALUES ('nation-3'), ('tion_2'), ('region-1'), ('NATION_11'), ('9')),
          m AS (SELECT q, n_nationkey, n_name, CASE WHEN regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') = q THEN 0 WHEN lower(n_name) = lower(q) THEN 1 WHEN contains(lower(n_name), lower(q)) THEN 2 END AS tier FROM nation, q)
          SELECT q, n_name, tier FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, n_nationkey) AS n FROM m WHERE tier IS NOT NULL) WHERE n = 1""")
def tiered_lookup(t: Tables) -> DataFrame:
    q = t.spark.createDataFrame([("nation-3",), ("tion_2",), ("region-1",), ("NATION_11",), ("9",)], "q string")
    tiers = [text.slugify(F.col("n_name")) == F.col("q"), F.lower("n_name") == F.lower("q"), text.contains_ci(F.col("n_name"), F.col("q"))]
    return joins.tiered(q, t.nation, tiers, ["q"], [F.col("n_nationkey")]).select("q", "n_name", "tier")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 45 THEN p_brand END, CASE WHEN p_retailprice > 1500 THEN p_type END, 'none') AS told FROM part""")
def waterfall_lookup(t: Tables) -> DataFrame:
    p = t.part
    sources = [("brand", p.filter("p_size > 45"), "p_brand"), ("type", p.filter("p_retailprice > 1500"), "p_type")]
    return joins.waterfall(p.select("p_partkey"), "p_partkey", sources).select("p_partkey", F.coalesce("value", F.lit("none")).alias("told"))


@query("SELECT n_name, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10")
def conditional_counts_top(t: Tables) -> DataFrame:
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))
    return per.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n"), F.sum("negative").alias("negative")).orderBy(F.col("n").desc(), "n_name").limit(10)


@query("SELECT p_name, p_brand, count(*) AS n, list_sort(list(DISTINCT p_partkey)) AS ids, min(p_partkey) AS survivor FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return integrity.duplicates(t.part, ["p_name", "p_brand"], "p_partkey")


@query("SELECT p_name, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1")
def survivors_last(t: Tables) -> DataFrame:
    return etl.latest(t.part, ["p_name", "p_brand"], [F.col("p_partkey").desc()]).select("p_name", "p_brand", "p_partkey")


@query("""SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part""")
def table_counts(t: Tables) -> DataFrame:
    return integrity.counts_of({n: getattr(t, n) for n in ("nation", "supplier", "customer", "part")})


@query("""SELECT 'supplier' AS kind, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_name FROM customer UNION ALL SELECT 'part', p_name FROM (SELECT DISTINCT p_name FROM part)""")
def candidate_union(t: Tables) -> DataFrame:
    tag = lambda df, c, k: df.select(F.lit(k).alias("kind"), F.col(c).alias("name"))
    return tag(t.supplier, "s_name", "supplier").unionAll(tag(t.customer, "c_name", "customer")).unionAll(tag(t.part.select("p_name").distinct(), "p_name", "part"))


@query("""WITH b AS (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderdate < timestamp '1998-01-01' GROUP BY 1), a AS (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderdate >= timestamp '1998-01-01' GROUP BY 1)
          SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.v AS before, a.v AS after,
                 CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' WHEN b.v <> a.v THEN 'changed' ELSE 'same' END AS change, coalesce(a.v, 0) - coalesce(b.v, 0) AS delta
          FROM b FULL JOIN a ON b.o_custkey = a.o_custkey""")
def snapshot_diff(t: Tables) -> DataFrame:
    per = lambda rows: rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return etl.diff(per(t.orders.filter(day < cut)), per(t.orders.filter(day >= cut)), "o_custkey", "v")


@query("""SELECT coalesce(p.p_partkey, s.k) AS p_partkey, coalesce(s.brand, p.p_brand) AS p_brand, coalesce(p.p_size, s.size) AS p_size
          FROM part p FULL JOIN (SELECT p_partkey + 500 AS k, 'NEW' || p_brand AS brand, p_size AS size FROM part WHERE p_size > 30) s ON p.p_partkey = s.k""")
def upsert(t: Tables) -> DataFrame:
    source = t.part.filter("p_size > 30").select((F.col("p_partkey") + 500).alias("p_partkey"), F.concat(F.lit("NEW"), "p_brand").alias("p_brand"), "p_size")
    return etl.upsert(t.part.select("p_partkey", "p_brand", "p_size"), source, ["p_partkey"], ["p_brand"])


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size <= 30 UNION ALL SELECT p_partkey, 'X' FROM part WHERE p_size > 30""")
def insert_ignore(t: Tables) -> DataFrame:
    target = t.part.filter("p_size <= 30").select("p_partkey", "p_brand")
    return etl.insert_ignore(target, t.part.filter("p_size > 20").select("p_partkey", F.lit("X").alias("p_brand")), ["p_partkey"])


@query("""SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
          UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P'""")
def replace_children(t: Tables) -> DataFrame:
    fresh = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).cast("bigint").alias("l_partkey"))
    return etl.replace_children(t.lineitem.select("l_orderkey", "l_partkey"), fresh, "l_orderkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def cascade_delete(t: Tables) -> DataFrame:
    doomed = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return etl.delete_where(t.lineitem, doomed, "l_suppkey").select("l_orderkey", "l_linenumber")


@query("""SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' AS statement FROM nation""")
def sql_dump(t: Tables) -> DataFrame:
    return etl.insert_statements(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "nation")


@query("""SELECT o_orderkey, floor((epoch_ms(timestamp '1998-08-02') - epoch_ms(o_orderdate)) / 86400000)::BIGINT AS age_days, (epoch_ms(timestamp '1998-08-02') - epoch_ms(o_orderdate)) // 86400000 > 30 AS stale FROM orders""")
def staleness(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("at", F.col("o_orderdate").cast("timestamp"))
    return integrity.staleness(rows, "at", F.lit("1998-08-02 00:00:00").cast("timestamp")).select("o_orderkey", "age_days", "stale")


@query("""SELECT r_name, list_sort(list(n_name)) AS nations, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def nested_children(t: Tables) -> DataFrame:
    lists = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    return t.region.join(lists, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "nations", F.size("nations").cast("bigint").alias("n"))


@query("""SELECT n_name, p_partkey, p_retailprice FROM (
            SELECT n_name, p_partkey, p_retailprice, row_number() OVER (PARTITION BY n_name ORDER BY p_retailprice DESC, p_partkey) AS k
            FROM (SELECT DISTINCT n_name, p_partkey, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)) WHERE k <= 3""")
def top_k_per_group(t: Tables) -> DataFrame:
    links = t.lineitem.select("l_partkey", "l_suppkey").distinct().join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = links.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "l_partkey").distinct().join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("n_name").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return rows.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("n_name", "p_partkey", "p_retailprice")


@query("""SELECT p_name, p_brand, row_number() OVER (ORDER BY length(p_name) DESC, p_name, p_partkey) AS k FROM part ORDER BY k LIMIT 20""")
def longest_first(t: Tables) -> DataFrame:
    top = t.part.orderBy(F.length("p_name").desc(), "p_name", "p_partkey").limit(20)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.length("p_name").desc(), "p_name", "p_partkey"))).select("p_name", "p_brand", "k")


@query("""SELECT c_mktsegment, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1""")
def distinct_on(t: Tables) -> DataFrame:
    return etl.latest(t.customer, ["c_mktsegment", "c_nationkey"], [F.col("c_acctbal").desc(), "c_custkey"]).select("c_mktsegment", "c_custkey", "c_name")


@query("""SELECT n_name FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9990) ON n_nationkey = c_nationkey
          ORDER BY coalesce(c_nationkey::VARCHAR, 'ZZZZZ'), n_name""")
def nulls_last_order(t: Tables) -> DataFrame:
    rich = t.customer.filter("c_acctbal > 9990").select("c_nationkey").distinct()
    return t.nation.join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").orderBy(F.coalesce(F.col("c_nationkey").cast("string"), F.lit("ZZZZZ")), "n_name").select("n_name")


@query("""SELECT s_suppkey, list_filter(['numbered', 'too_long', 'padded'], lambda x: (x = 'numbered' AND regexp_matches(s_name, '\\d+$')) OR (x = 'too_long' AND length(s_name) > 100) OR (x = 'padded' AND contains(s_name, '#0'))) AS faults FROM supplier""".replace("\\\\", "\\"))
def name_checks(t: Tables) -> DataFrame:
    c = F.col("s_name")
    rules = {"numbered": c.rlike(r"\d+$"), "too_long": F.length(c) > 100, "padded": c.contains("#0")}
    return t.supplier.select("s_suppkey", F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull()).alias("faults"))


@query("""SELECT regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-\\d+$', '') AS base, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1""".replace("\\\\", "\\"))
def near_duplicate_slugs(t: Tables) -> DataFrame:
    rows = t.supplier.withColumn("slug", text.slugify(F.col("s_name")))
    return integrity.near_duplicate_slugs(rows, "slug", []).select("base", "n")
