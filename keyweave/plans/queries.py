"""The queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.equality import canonical, fingerprint
from ..functions.predicates import compare
from ..operators import querystring, recency, stats
from ..operators.query import Query, index_extreme, prefix_page, strict_unique
from ..sources import changelog, dump
from ..spec import EntitySpec, ForeignKey, Index, Registry, session
from . import catalog as c

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[c.Catalog], DataFrame]], Run]:
    """Register a query on the catalog under its function's name, with its SQL if it has one."""
    def register(f: Callable[[c.Catalog], DataFrame]) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = c.Catalog(session(spark), sf_dir)
            found.spark, found.sf_dir = spark, sf_dir
            return f(found)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


def day(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text} 00:00:00'")


def money(column: Column) -> Column:
    return column.cast("decimal(18,2)")


def total(items: str, field: str) -> Column:
    """The sum of a money field over an array of structs."""
    zero = F.lit(0).cast("decimal(28,2)")
    return F.aggregate(items, zero, lambda n, x: (n + money(x[field])).cast("decimal(28,2)")).cast("double")


def size(items: str) -> Column:
    return F.size(items).cast("long")


def figure(name: str) -> Column:
    """A count of children, 0 without any."""
    return F.coalesce(name, F.lit(0)).cast("long")


# ---- sources and lookups ----


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def full_scan(r):
    return r.query("orders").map(F.col("o_orderkey"), F.col("o_orderstatus"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4711")
def pk_lookup(r):
    return r.query("orders").with_("o_orderkey", 4711).map(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 5, 9, 13, 999999999)")
def pk_in(r):
    return r.query("orders").with_("o_orderkey", [1, 5, 9, 13, 999999999]).map(F.col("o_orderkey"), F.col("o_custkey"))


@query("WITH k AS (SELECT DISTINCT user_id * 7 AS k FROM events) SELECT k, o_orderkey IS NOT NULL AS found, o_custkey FROM k LEFT JOIN orders ON o_orderkey = k")
def batch_lookup_mask(r):
    keys = c.load(r.spark, r.sf_dir, "events").select((F.col("user_id") * 7).alias("k"))
    return r.query("orders").with_keys(keys, found="found").select("k", "found", F.col("row.o_custkey").alias("o_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT user_id * 7 FROM events) AND o_orderstatus = 'F'")
def batch_lookup_semi(r):
    keys = c.load(r.spark, r.sf_dir, "events").select((F.col("user_id") * 7).alias("k"))
    return r.query("orders").with_("o_orderstatus", "F").with_keys(keys).map(F.col("o_orderkey"), F.col("o_totalprice"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042'")
def unique_eq(r):
    return r.query("customer").with_("c_name", "Customer#000000042").map(F.col("c_custkey"), F.col("c_name"))


@query("SELECT arg_max(c_custkey, c_custkey) AS c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (3, 4) GROUP BY c_nationkey")
def unique_owner(r):
    owners = strict_unique(r.df("customer"), F.col("c_nationkey"), F.col("c_custkey"))
    return Query(owners, c.CUSTOMER).with_("c_nationkey", [3, 4]).map(F.col("c_custkey"), F.col("c_nationkey"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def many_eq(r):
    return r.query("customer").with_("c_mktsegment", "MACHINERY").map(F.col("c_custkey"), F.col("c_mktsegment"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_nationkey IN (1, 2, 3)")
def many_in(r):
    return r.query("customer").with_("c_mktsegment", ["MACHINERY", "FURNITURE"]).with_("c_nationkey", [1, 2, 3]).map(F.col("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (2, 4, 6)")
def many_in_transformed(r):
    return r.query("customer").use_index("c_nationkey", [1, 2, 3], transform=lambda v: 2 * v).map(F.col("c_custkey"))


# ---- ranges ----


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def range_gt(r):
    return r.query("orders").with_range("o_totalprice", gt=400000.0).map(F.col("o_orderkey"), F.col("o_totalprice"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'")
def range_gte_lt(r):
    return r.query("orders").with_range("o_orderdate", gte=day("1997-01-01"), lt=day("1997-07-01")).map(F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 150000")
def range_gt_lte(r):
    return r.query("orders").with_range("o_totalprice", gt=100000.0, lte=150000.0).map(F.col("o_orderkey"))


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 12")
def range_between(r):
    return r.query("part").with_range("p_size", gte=10, lte=12).map(F.col("p_partkey"))


@query("SELECT p_partkey FROM part WHERE p_size <= 5")
def range_lte(r):
    return r.query("part").with_range("p_size", lte=5).map(F.col("p_partkey"))


@query(
    "(SELECT 'min' AS side, o_totalprice AS index_value, o_orderkey AS key FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) UNION ALL "
    "(SELECT 'max', o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)"
)
def index_min_max(r):
    least = index_extreme(r.df("orders"), F.col("o_totalprice"), F.col("o_orderkey"))
    most = index_extreme(r.df("orders"), F.col("o_totalprice"), F.col("o_orderkey"), least=False)
    return least.select(F.lit("min").alias("side"), "*").unionByName(most.select(F.lit("max").alias("side"), "*"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank FROM orders WHERE CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END >= 1")
def range_custom_order(r):
    rank = lambda: F.array_position(F.lit(["O", "P", "F"]), F.col("o_orderstatus")) - 1
    spec = EntitySpec("orders", key="o_orderkey", indexes=(Index("o_orderstatus", "range", name="state", expr=rank),))
    return Query(r.df("orders"), spec).with_range("state", gte=1).map(F.col("o_orderkey"), rank().cast("int").alias("rank"))


# ---- lanes, residual predicates, Or ----


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice < 50000")
def lanes_and(r):
    return r.query("orders").with_("o_orderstatus", "F").with_("o_orderpriority", ["1-URGENT", "2-HIGH"]).with_range("o_totalprice", lt=50000.0).map(F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 10 = 3 AND o_custkey > 500")
def where_residual(r):
    return r.query("orders").with_("o_orderstatus", "O").where(F.col("o_orderkey") % 10 == 3).where(lambda df: df["o_custkey"] > 500).map(F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 450000")
def or_two(r):
    return r.query("orders").or_(lambda b: b.with_("o_orderstatus", "P"), lambda b: b.with_range("o_totalprice", gt=450000.0)).map(F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey < 30 OR o_custkey > 1400")
def or_with_argument(r):
    return r.query("orders").or_(lambda b, low, _: b.where(F.col("o_custkey") < low), lambda b, _, high: b.where(F.col("o_custkey") > high), 30, 1400).map(F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR (o_orderpriority = '5-LOW' OR o_totalprice < 2000)) AND (o_custkey < 400 OR o_custkey > 900)")
def or_nested(r):
    inner = lambda b: b.or_(lambda x: x.with_("o_orderpriority", "5-LOW"), lambda x: x.with_range("o_totalprice", lt=2000.0))
    found = r.query("orders").or_(lambda b: b.with_("o_orderstatus", "P"), inner)
    return found.or_(lambda b: b.where(F.col("o_custkey") < 400), lambda b: b.where(F.col("o_custkey") > 900)).map(F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' AND o_totalprice > 300000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 20000)")
def or_and_inside(r):
    dear = lambda b: b.with_("o_orderstatus", "P").with_range("o_totalprice", gt=300000.0)
    return r.query("orders").or_(dear, lambda b: b.with_("o_orderpriority", "1-URGENT").with_range("o_totalprice", lt=20000.0)).map(F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def or_noop_branch(r):
    return r.query("orders").or_(lambda b: b.with_("o_orderpriority", None), lambda b: b.with_("o_orderstatus", "P")).or_(lambda b: b, lambda b: b).map(F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def or_cleared_branch(r):
    return r.query("orders").or_(lambda b: b.use_index("o_orderpriority", []), lambda b: b.with_("o_orderstatus", "P")).map(F.col("o_orderkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def empty_list_noop(r):
    return r.query("customer").with_("c_mktsegment", []).with_("c_nationkey", 7).use_index("c_mktsegment", []).map(F.col("c_custkey"))


@query("SELECT o_orderkey FROM orders WHERE false")
def empty_unique_list(r):
    return r.query("orders").use_index("o_orderkey", []).map(F.col("o_orderkey"))


# ---- named predicates ----

_ACCOUNTS = "(SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer)"


def _accounts(r) -> Query:
    return Query(c.accounts(r.spark, r.sf_dir), c.NULLABLE.validate(c.accounts(r.spark, r.sf_dir).schema))


@query(f"SELECT c_custkey FROM {_ACCOUNTS} WHERE balance IS NOT NULL")
def has_value(r):
    return _accounts(r).with_predicate("with_balance").map(F.col("c_custkey"))


@query(f"SELECT c_custkey FROM {_ACCOUNTS} WHERE balance IS NULL")
def has_not_value(r):
    return _accounts(r).with_predicate("without_balance").map(F.col("c_custkey"))


def _counts(prefix: str, inverse: bool) -> str:
    turned = {"==": "<>", "!=": "=", ">": "<=", ">=": "<", "<": ">=", "<=": ">"} if inverse else {"==": "=", "!=": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<="}
    null = {"=": "IS NOT DISTINCT FROM", "<>": "IS DISTINCT FROM"}
    return " UNION ALL ".join(f"SELECT '{prefix} {op}' AS index_name, count(*)::BIGINT AS n FROM {_ACCOUNTS} WHERE balance {null.get(sql, sql)} 5000" for op, sql in turned.items())


def _by_name(r, prefix: str) -> DataFrame:
    # one pass over the table for all of them
    df = c.accounts(r.spark, r.sf_dir)
    hits = [F.sum(F.when(Query(df, c.NULLABLE).with_predicate(f"{prefix} {op}").predicate(), 1).otherwise(0)).alias(op) for op in ("==", "!=", ">", ">=", "<", "<=")]
    return df.agg(*hits).unpivot([], ["==", "!=", ">", ">=", "<", "<="], "op", "n").select(F.concat_ws(" ", F.lit(prefix), "op").alias("index_name"), F.col("n").cast("long"))


@query(_counts("value", False))
def value_index_ops(r):
    return _by_name(r, "value")


@query(_counts("no value", True))
def no_value_index_ops(r):
    return _by_name(r, "no value")


# ---- collections ----

_BASKETS = "(SELECT l_orderkey AS o_orderkey, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_orderkey)"


@query(f"SELECT o_orderkey FROM {_BASKETS} WHERE list_has_any(parts, [5, 17, 123])")
def collection_contains_any(r):
    return Query(c.baskets(r.spark, r.sf_dir), c.BASKET).with_("parts", [5, 17, 123]).map(F.col("o_orderkey"))


@query(f"SELECT o_orderkey FROM {_BASKETS} WHERE list_contains(parts, 77)")
def collection_contains(r):
    return Query(c.baskets(r.spark, r.sf_dir), c.BASKET).with_("parts", 77).map(F.col("o_orderkey"))


# ---- joins, one to one ----


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_one_fk(r):
    return r.query("orders").join_with("customer").map(F.col("o_orderkey"), F.col("customer.c_name").alias("c_name"), F.col("customer.c_mktsegment").alias("c_mktsegment"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_one_pk(r):
    return r.query("documents").join_one("labels").map(F.col("doc_id"), F.col("right1.quality").alias("quality"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_one_right_unique(r):
    return r.query("documents").inner_join_with("labels", alias="label").map(F.col("doc_id"), F.col("label.quality").alias("quality"), F.col("label.toxic").alias("toxic"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def join_one_filter(r):
    return r.query("orders").join_with("customer", narrow=lambda b: b.with_("c_mktsegment", "BUILDING")).map(F.col("o_orderkey"), F.col("customer.c_name").alias("c_name"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000")
def join_one_inner_filter(r):
    rich = lambda b, least: b.or_(lambda x: x.with_("c_mktsegment", "BUILDING"), lambda x: x.with_range("c_acctbal", gt=least))
    return r.query("orders").inner_join_with("customer", narrow=rich, args=(9000.0,)).map(F.col("o_orderkey"), F.col("customer.c_name").alias("c_name"))


@query("SELECT o_orderkey, n_name FROM orders LEFT JOIN nation ON o_custkey % 25 = n_nationkey")
def join_one_selector(r):
    joined = r.query("orders").join_one("nation", "o_custkey", selector=lambda k, n: (k % n).cast("int"), selector_args=(25,))
    return joined.map(F.col("o_orderkey"), F.col("right1.n_name").alias("n_name"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN (SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey) c ON s_nationkey = c_nationkey")
def join_one_non_pk(r):
    joined = r.query("supplier").inner_join_one("customer", "s_nationkey", "c_nationkey", latest=F.col("c_custkey"))
    return joined.map(F.col("s_suppkey"), F.col("right1.c_custkey").alias("c_custkey"))


@query("SELECT s_suppkey, c.c_custkey FROM supplier LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey) c ON s_nationkey = c.c_nationkey")
def join_one_repeats(r):
    """Right rows share a value: the last writer holds it, here the greatest key, and no left row is multiplied."""
    return r.query("supplier").join_one("customer", "s_nationkey", "c_nationkey").map(F.col("s_suppkey"), F.col("right1.c_custkey").alias("c_custkey"))


@query("SELECT s_suppkey, c.c_custkey FROM supplier LEFT JOIN (SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS c_custkey, arg_max(c_mktsegment, c_acctbal) AS seg FROM customer GROUP BY c_nationkey) c ON s_nationkey = c.c_nationkey AND seg = 'BUILDING'")
def join_one_repeats_filter(r):
    """A filter sees the holder of a value only: another row that shares it doesn't come forward."""
    joined = r.query("supplier").join_one("customer", "s_nationkey", "c_nationkey", latest=F.col("c_acctbal"), narrow=lambda b: b.with_("c_mktsegment", "BUILDING"))
    return joined.map(F.col("s_suppkey"), F.col("right1.c_custkey").alias("c_custkey"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN (SELECT s_nationkey, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def join_one_left_unique(r):
    joined = r.query("customer").inner_join_one("supplier", F.col("c_nationkey"), F.col("s_nationkey"))
    return joined.map(F.col("c_custkey"), F.col("right1.s_suppkey").alias("s_suppkey"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1")
def compound_key(r):
    return r.query("conversations").with_("key", (3, 1)).map(F.col("conv_id"), F.col("turn"), F.col("role"))


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id = 3 AND turn = 1) OR (conv_id = 5 AND turn = 0) OR (conv_id = 1 AND turn = 99)")
def compound_key_in(r):
    return r.query("conversations").with_("key", [(3, 1), (5, 0), (1, 99)]).map(F.col("conv_id"), F.col("turn"), F.col("role"))


# ---- joins, one to many and many to many ----


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_items, coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE AS amount FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def join_many(r):
    figures = {"n": F.count("*"), "amount": F.sum(money(F.col("l_extendedprice")))}
    joined = r.query("orders").join_with("lineitem", alias="items", aggregates=figures)
    return joined.map(F.col("o_orderkey"), figure("items.n").alias("n_items"), F.coalesce("items.amount", F.lit(0)).cast("double").alias("amount"))


@query("SELECT o_orderkey, count(*)::BIGINT AS n_items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def join_many_inner(r):
    return r.query("orders").inner_join_with("lineitem", alias="items", columns=["l_linenumber"]).map(F.col("o_orderkey"), size("items").alias("n_items"))


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_items FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey")
def join_many_filter(r):
    joined = r.query("orders").with_("o_orderstatus", "F").join_with("lineitem", narrow=lambda b: b.with_("l_returnflag", "R"), alias="items", columns=["l_linenumber"])
    return joined.map(F.col("o_orderkey"), size("items").alias("n_items"))


@query("SELECT c_custkey, count(s_suppkey)::BIGINT AS n_suppliers FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey")
def join_many_shared_value(r):
    # a value's suppliers are counted once, not carried by each of its customers
    joined = r.query("customer").join_many("supplier", "s_nationkey", "c_nationkey", alias="suppliers", aggregates={"n": F.count("*")})
    return joined.map(F.col("c_custkey"), figure("suppliers.n").alias("n_suppliers"))


@query("SELECT c_custkey, count(*)::BIGINT AS n_suppliers FROM customer JOIN supplier ON s_nationkey = (c_nationkey + 1) % 25 GROUP BY c_custkey")
def join_many_selector_inner(r):
    joined = r.query("customer").inner_join_many("supplier", "s_nationkey", "c_nationkey", selector=lambda k: (k + 1) % 25, alias="suppliers", aggregates={"n": F.count("*")})
    return joined.map(F.col("c_custkey"), figure("suppliers.n").alias("n_suppliers"))


@query(f"SELECT b.o_orderkey, count(p_partkey)::BIGINT AS n_parts, coalesce(sum(p_retailprice::DECIMAL(18,2)), 0)::DOUBLE AS worth FROM {_BASKETS} b LEFT JOIN (SELECT o_orderkey, unnest(parts) AS part FROM {_BASKETS}) u ON u.o_orderkey = b.o_orderkey LEFT JOIN part ON p_partkey = part GROUP BY b.o_orderkey")
def join_m2m_forward(r):
    joined = Query(c.baskets(r.spark, r.sf_dir), c.BASKET, r).join_many_collection_forward("part", "parts", alias="found", columns=["p_retailprice"])
    return joined.map(F.col("o_orderkey"), size("found").alias("n_parts"), total("found", "p_retailprice").alias("worth"))


@query(f"SELECT p_partkey, count(o_orderkey)::BIGINT AS n_orders FROM part LEFT JOIN (SELECT o_orderkey, unnest(parts) AS part FROM {_BASKETS}) ON part = p_partkey GROUP BY p_partkey")
def join_m2m_reverse(r):
    baskets = Query(c.baskets(r.spark, r.sf_dir), c.BASKET)
    return r.query("part").join_many_collection(baskets, "parts", alias="orders", columns=["o_orderkey"]).map(F.col("p_partkey"), size("orders").alias("n_orders"))


@query("SELECT c_custkey, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(l_orderkey)::BIGINT AS n_items, coalesce(sum(l_quantity::DECIMAL(18,2)), 0)::DOUBLE AS quantity FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'MACHINERY' GROUP BY c_custkey")
def join_nested(r):
    lines = lambda q: q.join_with("lineitem", alias="items", columns=["l_quantity"])
    joined = r.query("customer").with_("c_mktsegment", "MACHINERY").join_with("orders", lines, columns=["o_orderkey", "items"])
    items = F.flatten(F.transform("orders", lambda o: o["items"]))
    rows = joined.to_df().withColumn("all_items", items)
    return rows.select("c_custkey", size("orders").alias("n_orders"), size("all_items").alias("n_items"), total("all_items", "l_quantity").alias("quantity"))


@query("SELECT o_orderkey, c_name, n_name, r_name, n_items, n_peers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*)::BIGINT AS n_items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN (SELECT s_nationkey, count(*)::BIGINT AS n_peers FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey WHERE n_items IS NOT NULL")
def join_chain5(r):
    q = r.query("orders").inner_join_with("customer", columns=["c_name", "c_nationkey"]).inner_join_one("nation", F.col("customer.c_nationkey"), alias="nation")
    q = q.join_one("region", F.col("nation.n_regionkey"), alias="region").inner_join_with("lineitem", alias="items", aggregates={"n": F.count("*")})
    q = q.join_many("supplier", "s_nationkey", F.col("customer.c_nationkey"), alias="peers", aggregates={"n": F.count("*")})
    return q.map(F.col("o_orderkey"), F.col("customer.c_name").alias("c_name"), F.col("nation.n_name").alias("n_name"), F.col("region.r_name").alias("r_name"), F.col("items.n").alias("n_items"), F.col("peers.n").alias("n_peers"))


# ---- order, pages, counts ----


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def sort_page(r):
    return r.query("customer").sort("richest").page(10, 20).map(F.col("c_custkey"), F.col("c_acctbal"))


@query("SELECT o_orderkey, n_items FROM (SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1) ORDER BY n_items DESC, o_orderkey LIMIT 25 OFFSET 5")
def sort_join_page(r):
    q = r.query("orders").with_("o_orderstatus", "P").join_with("lineitem", alias="items", columns=["l_linenumber"]).sort([F.size("items").desc(), F.col("o_orderkey")])
    return q.page(5, 25).map(F.col("o_orderkey"), size("items").alias("n_items"))


@query("SELECT o_orderkey, total_count FROM (SELECT o_orderkey, o_totalprice, count(*) OVER ()::BIGINT AS total_count FROM orders WHERE o_orderstatus = 'F') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def total_count_page(r):
    return r.query("orders").with_("o_orderstatus", "F").sort("dearest").page(30, 10).with_total().select("o_orderkey", "total_count")


@query("SELECT count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def count_inner(r):
    narrow = lambda b: b.with_("c_mktsegment", "BUILDING")
    return r.query("orders").inner_join_with("customer", narrow=narrow).join_with("lineitem").counted()


@query("SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def count_filtered(r):
    return r.query("orders").with_("o_orderstatus", "F").where(F.col("o_totalprice") > 200000).counted()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5")
def topk_prefix(r):
    return prefix_page(r.df("orders"), F.col("o_orderstatus") == "O", [F.col("o_totalprice").desc()], F.col("o_orderkey"), 5, 15).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, c_name, n_items, sum_price FROM (SELECT o_orderkey, o_totalprice, c_name, count(l_orderkey)::BIGINT AS n_items, coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE AS sum_price FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def flagship(r):
    q = r.query("orders").with_("o_orderstatus", "F").with_range("o_orderdate", gte=day("1996-01-01"), lt=day("1998-01-01"))
    # sorted and cut before it is joined: joins never multiply or drop these rows
    page = Query(q.sort("dearest").page(0, 20).to_df(), c.ORDERS, r).join_with("customer").join_many("lineitem", "l_orderkey", alias="items", columns=["l_extendedprice"])
    return page.map(F.col("o_orderkey"), F.col("customer.c_name").alias("c_name"), size("items").alias("n_items"), total("items", "l_extendedprice").alias("sum_price"))


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority FROM orders WHERE o_totalprice > 300000")
def result_map(r):
    return r.query("orders").with_range("o_totalprice", gt=300000.0).map(F.col("o_orderkey"), F.upper("o_orderpriority").alias("priority"))


@query("SELECT o_orderkey * 2 AS twice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000")
def map_or_filter(r):
    return r.query("orders").with_("o_orderstatus", "P").map_or_filter(F.when(F.col("o_totalprice") > 250000, F.col("o_orderkey") * 2), "twice")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def property_copy(r):
    from ..spec import projected

    return projected(r.df("customer"), exclude=["c_acctbal", "c_nationkey"])


# ---- query strings ----


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 101000 ORDER BY o_orderkey LIMIT 100)")
def qs_range(r):
    return querystring.run(c.ORDERS, r.df("orders"), "?O_TotalPrice=[100000..101000)&unknown=1&sort=o_orderkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_nationkey = 3 ORDER BY c_custkey LIMIT 40 OFFSET 5")
def qs_in(r):
    return querystring.run(c.CUSTOMER, r.df("customer"), "c_mktsegment=[MACHINERY, FURNITURE]&c_nationkey=3&sort=c_custkey&from=5&size=40").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1999-01-01' AND o_custkey < 100 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def qs_mixed(r):
    return querystring.run(c.ORDERS, r.df("orders"), "o_orderstatus=F&o_orderdate.gte=1999-01-01T00:00:00&o_custkey=<99&&o_totalprice=abc&sort=dearest&size=30").select("o_orderkey")


@query(
    "SELECT * FROM (VALUES ('o_orderkey', 'bigint', true, '=,in,>,>=,<,<=,range'), ('o_custkey', 'bigint', true, '=,in,>,>=,<,<=,range'), ('o_orderstatus', 'string', true, '=,in'), "
    "('o_totalprice', 'double', true, '=,>,>=,<,<=,range'), ('o_orderdate', 'timestamp_ntz', true, '=,>,>=,<,<=,range'), ('o_orderpriority', 'string', true, '=,in')) t(field, type, indexed, ops)"
)
def queryable_fields(r):
    return c.ORDERS.queryable_fields(r.df("orders"))


# ---- changelogs ----

_LOG = "(SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ts_ms, event_type, CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END AS score, event_type = 'error' AS gone, event_id % 3 <> 0 AS headed FROM events)"
_MARKED = f"(SELECT *, lag(gone) OVER w AS p_gone, lag(event_type) OVER w AS p_type, lag(score) OVER w AS p_score FROM {_LOG} WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
_KIND = "CASE WHEN gone AND (p_gone IS NULL OR p_gone) THEN 'Filtered' WHEN gone THEN 'Delete' WHEN p_gone IS NULL OR p_gone THEN 'Add' WHEN event_type = p_type AND score = p_score THEN 'Same' ELSE 'Update' END"
_FEED = f"(SELECT *, {_KIND} AS update_type FROM {_MARKED})"


@query(f"SELECT user_id AS key, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM {_LOG} GROUP BY user_id")
def fold_latest(r):
    folded = changelog.latest_by_key(c.event_log(r.spark, r.sf_dir), tombstones=False)
    return folded.select("key", F.coalesce("value.event_type", F.lit("error")).alias("event_type"), "seq")


@query(f"SELECT user_id AS key, arg_max(event_type, event_id) AS event_type, arg_max(score, event_id) AS score FROM {_LOG} GROUP BY user_id HAVING NOT arg_max(gone, event_id)")
def fold_tombstone(r):
    return changelog.latest_by_key(c.event_log(r.spark, r.sf_dir)).select("key", "value.event_type", "value.score")


@query(f"SELECT user_id AS key, event_id AS seq, update_type, CASE WHEN NOT gone THEN score END AS new_score FROM {_FEED}")
def change_feed(r):
    feed = changelog.transitions(c.event_log(r.spark, r.sf_dir), c.EVENT)
    return feed.select("key", "seq", "update_type", F.col("new.score").alias("new_score"))


@query(f"SELECT user_id AS key, arg_max(event_type, event_id) AS event_type, arg_max(score, event_id) AS score, arg_max(ts_ms, event_id) AS ts_ms FROM {_FEED} WHERE update_type IN ('Add', 'Update', 'Delete') GROUP BY user_id HAVING NOT arg_max(gone, event_id)")
def conditional_update(r):
    return changelog.held(c.event_log(r.spark, r.sf_dir), c.EVENT).select("key", "value.event_type", "value.score", "ts_ms")


@query(f"SELECT user_id AS key, event_id AS seq, CASE WHEN user_id % 5 = 0 THEN 'skip' WHEN gone THEN 'delete' WHEN score < 3 THEN 'delete' WHEN score % 7 = 0 THEN 'skip' ELSE 'keep' END AS decision FROM {_LOG}")
def ingest_filters(r):
    keys = (changelog.RowFilter(F.col("key") % 5 != 0),)
    values = (changelog.RowFilter(F.col("value.score") >= 3, treat_as_delete=True), changelog.RowFilter(F.col("value.score") % 7 != 0))
    return changelog.decided(c.event_log(r.spark, r.sf_dir), (), keys, values).select("key", F.col("offset").alias("seq"), "decision")


@query(f"SELECT event_id AS seq, event_type = 'click' OR NOT headed AS is_click, NOT (event_type = 'click') OR NOT headed AS is_other, headed AS has_kind, event_type LIKE 'v%' OR NOT headed AS starts_v FROM {_LOG}")
def header_filters(r):
    log, headers = c.event_log(r.spark, r.sf_dir), F.col("headers")
    kind = lambda how, **k: changelog.HeaderFilter("kind", how, **k).condition(headers)
    return log.select(
        F.col("offset").alias("seq"),
        kind("equals", values=("click",)).alias("is_click"),
        kind("not_equals", values=("click",)).alias("is_other"),
        (~kind("not_exists")).alias("has_kind"),
        kind("predicate", predicate=lambda v: v.startswith("v")).alias("starts_v"),
    )


@query(f"SELECT event_id AS seq, CASE WHEN headed THEN 'kind-' || event_type ELSE event_type END AS tagged, ts_ms AS created_ms FROM {_LOG} WHERE NOT gone")
def enrich(r):
    log = c.event_log(r.spark, r.sf_dir)
    spec = EntitySpec("events", key="user_id", headers={"kind": "kind"}, timestamp_columns=("created_ms",))
    wide = log.withColumn("value", F.when(F.col("value").isNotNull(), F.col("value").withField("kind", F.lit(None).cast("string")).withField("created_ms", F.lit(None).cast("long"))))
    rows = changelog.enriched(wide, spec).where("value IS NOT NULL")
    tagged = F.when(F.col("value.kind").isNotNull(), F.concat(F.lit("kind-"), "value.kind")).otherwise(F.col("value.event_type"))
    return rows.select(F.col("offset").alias("seq"), tagged.alias("tagged"), F.col("value.created_ms").alias("created_ms"))


@query(f"SELECT user_id AS key, gone AS tombstone, n_headers FROM (SELECT *, CASE WHEN gone THEN 1 ELSE 2 END::BIGINT AS n_headers FROM {_FEED} WHERE update_type IN ('Add', 'Update', 'Delete'))")
def produce_if_changed(r):
    feed = changelog.change_feed(c.event_log(r.spark, r.sf_dir), c.EVENT)
    spec = EntitySpec("events", key="user_id", headers={"event_type": "kind"})
    return changelog.to_produce(feed, spec, "me", "out").select("key", F.col("value").isNull().alias("tombstone"), size("headers").alias("n_headers"))


@query(f"SELECT user_id AS key, event_id AS seq FROM {_LOG} WHERE NOT (headed AND event_type = 'view')")
def self_consume(r):
    log = c.event_log(r.spark, r.sf_dir)
    own = log.withColumn("headers", F.transform("headers", lambda h: F.struct(F.lit(changelog.PRODUCER_HEADER).alias("key"), h["value"].alias("value"))))
    return changelog.decided(own, producer_id="view").where("decision <> 'skip'").select("key", F.col("offset").alias("seq"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'broken ' || event_id END AS quarantine, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def poison_quarantine(r):
    from pyspark.sql.types import LongType, StructField, StructType

    e = c.load(r.spark, r.sf_dir, "events")
    raw = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.col("props")).alias("value"))
    return changelog.parsed(raw, StructType([StructField("k", LongType())])).select("seq", "quarantine", F.col("value.k").alias("k"))


# ---- recency ----

_REL = "(SELECT o_orderpriority AS grp, max((epoch_us(o_orderdate) // 1000)) AS last_ts, count(*)::BIGINT AS n FROM orders GROUP BY 1)"
_BY_CUSTOMER = "(SELECT o_custkey::VARCHAR AS grp, max((epoch_us(o_orderdate) // 1000)) AS last_ts, count(*)::BIGINT AS n FROM orders GROUP BY 1)"
_AFTER = 980000000000


def _by_customer(r) -> DataFrame:
    return recency.last_update_simple((r.df("orders"), F.col("o_custkey"), scalars.to_millis(F.col("o_orderdate"))))


@query(f"SELECT grp, last_ts, n FROM {_REL}")
def last_update_rel(r):
    return recency.last_update_simple((r.df("orders"), F.col("o_orderpriority"), scalars.to_millis(F.col("o_orderdate"))))


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey::VARCHAR IN (SELECT grp FROM {_BY_CUSTOMER} WHERE last_ts > {_AFTER})")
def updated_after(r):
    return r.query("orders").updated_after(_by_customer(r), "o_custkey", _AFTER).map(F.col("o_orderkey"))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey::VARCHAR IN (SELECT grp FROM {_BY_CUSTOMER} WHERE last_ts > {_AFTER} AND last_ts <= 990000000000)")
def updated_window(r):
    return r.query("orders").with_("o_orderstatus", "F").updated_after(_by_customer(r), "o_custkey", _AFTER, 990000000000).map(F.col("o_orderkey"))


@query(f"SELECT (SELECT coalesce(max(last_ts), 0) FROM {_BY_CUSTOMER} WHERE last_ts > {_AFTER})::BIGINT AS max_after, (SELECT coalesce(max(last_ts), 0) FROM {_BY_CUSTOMER} WHERE last_ts > 9990000000000)::BIGINT AS none_after")
def updated_after_max(r):
    rel = _by_customer(r)
    walked = lambda after: F.coalesce(F.max(F.when(recency.in_window(F.col("last_ts"), after), F.col("last_ts"))), F.lit(0).cast("long"))
    return rel.agg(walked(_AFTER).alias("max_after"), walked(9990000000000).alias("none_after"))


@query("SELECT grp, max(ts) AS last_ts, count(*)::BIGINT AS n FROM (SELECT o_custkey::VARCHAR AS grp, (epoch_us(o_orderdate) // 1000) AS ts FROM orders UNION ALL SELECT user_id::VARCHAR, (epoch_us(ts) // 1000) FROM events) GROUP BY grp")
def last_update_shared(r):
    events = c.load(r.spark, r.sf_dir, "events")
    return recency.last_update_simple((r.df("orders"), F.col("o_custkey"), scalars.to_millis(F.col("o_orderdate"))), (events, F.col("user_id"), scalars.to_millis(F.col("ts"))))


@query("SELECT o_orderpriority AS grp, max((epoch_us(o_orderdate) // 1000)) AS last_ts, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def last_update_filtered(r):
    rows = r.query("orders").with_range("o_totalprice", gt=100000.0).to_df()
    return recency.last_update_simple((rows, F.col("o_orderpriority"), scalars.to_millis(F.col("o_orderdate"))))


@query(f"SELECT min(last_ts) AS min_ts, max(last_ts) AS max_ts, sum(n)::BIGINT AS entities FROM {_REL} WHERE grp IN ('1-URGENT', '5-LOW')")
def last_update_lookups(r):
    return recency.lookups(last_update_rel_of(r), ["1-URGENT", "5-LOW"])


def last_update_rel_of(r) -> DataFrame:
    return recency.last_update_simple((r.df("orders"), F.col("o_orderpriority"), scalars.to_millis(F.col("o_orderdate"))))


_EVENTS = f"(SELECT o_type AS grp, event_id AS seq, ts_ms AS ts, -1 AS delta FROM (SELECT *, last_value(CASE WHEN update_type IN ('Add', 'Update') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o_type FROM {_FEED}) WHERE update_type = 'Delete' OR (update_type = 'Update' AND o_type <> event_type) UNION ALL SELECT event_type, event_id, ts_ms, CASE WHEN update_type = 'Update' AND o_type = event_type THEN 0 ELSE 1 END FROM (SELECT *, last_value(CASE WHEN update_type IN ('Add', 'Update') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o_type FROM {_FEED}) WHERE update_type IN ('Add', 'Update'))"


@query(f"WITH e AS {_EVENTS}, x AS (SELECT grp, max(seq) AS rs, arg_max(ts, seq) AS rt FROM e WHERE delta < 0 GROUP BY grp), f AS (SELECT e.grp, sum(delta) AS n, sum(CASE WHEN seq <= rs THEN delta ELSE 0 END) AS rest, max(CASE WHEN rs IS NULL OR seq > rs THEN ts END) AS since, any_value(rt) AS rt FROM e LEFT JOIN x USING (grp) GROUP BY e.grp) SELECT grp, CASE WHEN rest > 0 THEN greatest(since, rt) ELSE since END AS last_ts, n::BIGINT AS n FROM f WHERE n > 0")
def last_update_exact(r):
    feed = changelog.change_feed(c.event_log(r.spark, r.sf_dir), c.EVENT)
    return recency.last_update(recency.events(feed, "event_type"))


# ---- writes, headers, results as JSON ----


@query(f"SELECT user_id AS key, arg_max(event_type, event_id) AS event_type, count(*)::BIGINT AS n FROM (SELECT * FROM {_LOG} WHERE NOT gone UNION ALL SELECT * FROM {_LOG} WHERE NOT gone AND event_id % 2 = 0) GROUP BY user_id")
def fan_in(r):
    """Two topics read as one."""
    log = c.event_log(r.spark, r.sf_dir).where("value IS NOT NULL")
    both = changelog.fan_in(log, log.where("offset % 2 = 0"))
    return both.groupBy("key").agg(F.max_by("value.event_type", "offset").alias("event_type"), F.count("*").alias("n"))


@query(f"SELECT user_id AS key, max(event_id) AS seq, arg_max(gone, event_id) AS tombstone FROM {_LOG} GROUP BY user_id")
def compacted(r):
    return changelog.compacted(c.event_log(r.spark, r.sf_dir)).select("key", F.col("offset").alias("seq"), F.col("value").isNull().alias("tombstone"))


@query("SELECT o_custkey AS key, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey")
def writes(r):
    """Rows appended as upserts, then deletes of some keys, folded."""
    spec = EntitySpec("orders", key="o_custkey")
    rows = r.df("orders").select("o_custkey", "o_orderkey")
    up = changelog.upserts(rows, spec, first_offset=F.col("o_orderkey"))
    gone = changelog.deletes(rows.where("o_custkey % 3 = 0").select("o_custkey").distinct(), spec, up.schema["value"].dataType, first_offset=1 << 60)
    return changelog.latest_by_key(changelog.fan_in(up, gone)).select("key", "value.o_orderkey")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey * 1000003 END AS tenant, o_orderstatus AS state, md5(o_orderkey::VARCHAR) AS token FROM orders")
def header_roundtrip(r):
    """Header columns produced and read again: 4 and 8 byte numbers, text, and a uuid of 16 bytes."""
    tenant = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey") * 1000003)
    token = F.regexp_replace(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    rows = r.df("orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("shop"), tenant.alias("tenant"), F.col("o_orderstatus").alias("state"), token.alias("token"))
    spec = EntitySpec("orders", key="o_orderkey", headers={"shop": "h-shop", "tenant": "h-tenant", "state": "h-state", "token": "h-token"})
    feed = changelog.upserts(rows, spec).select("key", F.lit("Add").alias("update_type"), F.col("value").alias("new"))
    sent = changelog.to_produce(feed, spec, "me", kinds={"token": "uuid"})
    value = F.col("value")
    for name in spec.headers:
        value = value.withField(name, F.lit(None).cast(rows.schema[name].dataType))
    got = changelog.enriched(sent.withColumn("value", value), spec, {"token": "uuid"})
    return got.select("value.o_orderkey", F.col("value.shop").cast("long").alias("o_custkey"), "value.tenant", "value.state", F.replace("value.token", F.lit("-"), F.lit("")).alias("token"))


@query("SELECT json_object('conv_id', conv_id, 'turn', turn, 'role', role) AS value FROM conversations WHERE conv_id = 3 AND turn = 1")
def row_by_key_json(r):
    rows = r.df("conversations").select("conv_id", "turn", "role")
    return querystring.by_key(c.TURN, rows, "3,1")


@query("SELECT (SELECT count(*) FROM customer)::BIGINT AS customer, (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(*) FROM nation)::BIGINT AS nation")
def stats_json(r):
    found = stats.registry_json(r).select(F.from_json("value", "array<struct<entity:string,n_rows:bigint,n_indexes:int>>").alias("x"))
    rows = lambda name: F.filter("x", lambda e: e["entity"] == name)[0]["n_rows"].alias(name)
    return found.select(rows("customer"), rows("orders"), rows("nation"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 4 OFFSET 2")
def result_slice(r):
    return r.query("customer").with_("c_nationkey", 3).sort([F.col("c_custkey")]).page(2, 4).map(F.col("c_custkey"))


@query("SELECT 1::BIGINT AS id, 2::BIGINT AS n UNION ALL SELECT 2, 0")
def dual_form_key(r):
    """A key declared on the side that it refers to."""
    reg = Registry()
    reg.add(EntitySpec("ship", key="id", foreign_keys=(ForeignKey("crate", "id", "one_to_many", right_property="ship_id"),)), r.spark.createDataFrame([(1,), (2,)], "id bigint"))
    reg.add(EntitySpec("crate", key="id"), r.spark.createDataFrame([(5, 1), (6, 1)], "id bigint, ship_id bigint"))
    return reg.validated().query("ship").join_with("crate").map(F.col("id"), size("crate").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 100")
def qs_without_operator(r):
    """A name without an operator, and a collection's name, are no filters."""
    rows = r.df("customer").withColumn("tags", F.array("c_mktsegment"))
    return querystring.run(c.CUSTOMER, rows, "tags=BUILDING&c_nationkey=3&sort=c_custkey").select("c_custkey")


# ---- equality, sets, figures, dumps ----


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where everything runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (top or Path(tempfile.gettempdir(), "keyweave").as_uri()).rstrip("/")


def _folder(spark: SparkSession, name: str) -> str:
    """A new shared folder, which goes when the driver ends."""
    folder = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@query("SELECT a.user_id AS key, a.event_id AS seq, NOT (b.event_id IS NULL) AS has_twin FROM events a LEFT JOIN (SELECT event_type, value, min(event_id) AS event_id FROM events GROUP BY ALL HAVING count(*) > 1) b ON a.event_type = b.event_type AND a.value = b.value")
def structural_equality(r):
    log = c.load(r.spark, r.sf_dir, "events").select("event_id", "user_id", F.struct("event_type", "value", "props").alias("v"))
    kind = log.schema["v"].dataType
    marked = log.withColumn("f", fingerprint(F.col("v"), kind, ignore=("props",))).withColumn("form", canonical(F.col("v"), kind, ignore=("props",)))
    twins = marked.groupBy("f", "form").agg(F.count("*").alias("n"))
    return marked.join(twins, ["f", "form"]).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("n") > 1).alias("has_twin"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice <= 50000")
def complement(r):
    return r.query("orders").where(compare(F.col("o_orderstatus"), "!=", "F")).where(compare(F.col("o_totalprice"), "<=", 50000.0)).map(F.col("o_orderkey"))


@query("SELECT 'c_nationkey' AS index_name, count(DISTINCT c_nationkey)::BIGINT AS n_keys, count(c_nationkey)::BIGINT AS n_values FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(c_mktsegment) FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal), count(c_acctbal) FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(c_name) FROM customer")
def index_stats(r):
    return stats.index_stats(c.CUSTOMER, r.df("customer"))


@query("SELECT user_id AS key, count(*)::BIGINT AS n, max(event_id) AS last_offset FROM events GROUP BY user_id")
def dump_roundtrip(r):
    spark = r.spark
    path = _folder(spark, "dump")
    dump.create_dump(c.event_log(spark, r.sf_dir), path)
    return dump.load_dump(spark, path).groupBy("key").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


@query(f"SELECT user_id AS key, arg_max(event_type, event_id) AS event_type, arg_max(score, event_id) AS score FROM {_FEED} WHERE update_type IN ('Add', 'Update', 'Delete') GROUP BY user_id HAVING NOT arg_max(gone, event_id)")
def stream_fold(r):
    """The stateful stream run over the whole log, and its feed folded: the same rows as the batch fold."""
    from ..sources.config import read_changelog
    from ..streaming.upsert import Follower, ParquetTable, stream_feed

    spark = r.spark
    folder = _folder(spark, "stream")
    log = c.event_log(spark, r.sf_dir)
    log.write.parquet(f"{folder}/log")
    feed = stream_feed(read_changelog(spark, f"{folder}/log", log.schema, stream=True), c.EVENT)
    held = ParquetTable(spark, f"{folder}/table", log.schema["key"].dataType, log.schema["value"].dataType)
    Follower(feed, f"{folder}/checkpoint", held.apply, "stream_fold").load()
    return held.read().select("key", "value.event_type", "value.score")
