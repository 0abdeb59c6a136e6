"""The driver's tables as entities."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import EntitySpec, ForeignKey, Index, LastUpdate, PredicateIndex, Registry

CUSTOMER = EntitySpec(
    "customer",
    key="c_custkey",
    indexes=(Index("c_nationkey"), Index("c_mktsegment"), Index("c_acctbal", "range"), Index("c_name", "unique")),
    foreign_keys=(ForeignKey("nation", "c_nationkey", "many_to_one"),),
    sorts={"richest": ("c_acctbal:-1", "c_custkey:1")},
)
ORDERS = EntitySpec(
    "orders",
    key="o_orderkey",
    indexes=(Index("o_orderstatus"), Index("o_orderpriority"), Index("o_orderdate", "range"), Index("o_totalprice", "range")),
    foreign_keys=(ForeignKey("customer", "o_custkey", "many_to_one"),),
    sorts={"dearest": ("o_totalprice:-1", "o_orderkey:1")},
)
LINEITEM = EntitySpec(
    "lineitem",
    key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    indexes=(Index("l_returnflag"), Index("l_shipdate", "range")),
    foreign_keys=(ForeignKey("orders", "l_orderkey", "one_to_many"), ForeignKey("part", "l_partkey", "many_to_one"), ForeignKey("supplier", "l_suppkey", "many_to_one")),
)
PART = EntitySpec("part", key="p_partkey", indexes=(Index("p_brand"), Index("p_type"), Index("p_size", "range"), Index("p_retailprice", "range")))
SUPPLIER = EntitySpec("supplier", key="s_suppkey", indexes=(Index("s_nationkey"), Index("s_acctbal", "range")), foreign_keys=(ForeignKey("nation", "s_nationkey", "many_to_one"),))
NATION = EntitySpec("nation", key="n_nationkey", indexes=(Index("n_name", "unique"),), foreign_keys=(ForeignKey("region", "n_regionkey", "many_to_one"),))
REGION = EntitySpec("region", key="r_regionkey", indexes=(Index("r_name", "unique"),))
DOCUMENT = EntitySpec("documents", key="doc_id", indexes=(Index("lang"), Index("source"), Index("n_chars", "range")))
LABEL = EntitySpec("labels", key="doc_id", foreign_keys=(ForeignKey("documents", "doc_id", "one_to_one"),))
TURN = EntitySpec("conversations", key=("conv_id", "turn"), indexes=(Index("conv_id"), Index("role")))
EVENT = EntitySpec("events", key="user_id", indexes=(Index("event_type"),), last_update=(LastUpdate("by_type", "event_type"),), ignore_equality=("props",))

ENTITIES = {"customer": CUSTOMER, "orders": ORDERS, "lineitem": LINEITEM, "part": PART, "supplier": SUPPLIER, "nation": NATION, "region": REGION, "documents": DOCUMENT, "labels": LABEL, "conversations": TURN}

#: Balances below zero count as not given, so that a column has nulls.
NULLABLE = EntitySpec(
    "accounts",
    key="c_custkey",
    indexes=(Index("balance", "range"),),
    predicates=(
        PredicateIndex("balance", "has"),
        PredicateIndex("balance", "has_not"),
        *(PredicateIndex("balance", "value", op, 5000.0, f"value {op}") for op in ("==", "!=", ">", ">=", "<", "<=")),
        *(PredicateIndex("balance", "no_value", op, 5000.0, f"no value {op}") for op in ("==", "!=", ">", ">=", "<", "<=")),
    ),
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalog(Registry):
    """A registry whose tables are read when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._specs = dict(ENTITIES)
        self._load = partial(load, spark, sf_dir)

    def df(self, name: str) -> DataFrame:
        if name not in self._dfs:
            self._dfs[name] = self._load(name)
        return self._dfs[name]


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", F.when(c["c_acctbal"] >= 0, c["c_acctbal"]).alias("balance"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the distinct parts of their items, as a collection."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))


BASKET = EntitySpec("baskets", key="o_orderkey", indexes=(Index("parts"),), foreign_keys=(ForeignKey("part", "parts", "many_to_one"),))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a changelog by user; an error is a tombstone, and a header carries the event's type."""
    e = load(spark, sf_dir, "events")
    value = F.struct("event_type", F.floor("value").cast("long").alias("score"), "props")
    header = F.struct(F.lit("kind").alias("key"), F.encode("event_type", "UTF-8").alias("value"))
    no_headers = F.array().cast("array<struct<key:string,value:binary>>")
    return e.select(
        F.lit("events").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("user_id").alias("key"),
        F.when(F.col("event_type") != "error", value).alias("value"),
        F.when(F.col("event_id") % 3 != 0, F.array(header)).otherwise(no_headers).alias("headers"),
    )
