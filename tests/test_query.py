"""The fluent API on small tables with literal expectations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keyweave import EntitySpec, ForeignKey, Index, PredicateIndex, Query, Registry, SpecError
from keyweave.functions.predicates import between, compare
from keyweave.operators import querystring
from keyweave.operators.stats import health, registry_json, registry_stats


@pytest.fixture
def ports(spark):
    r = Registry()
    r.add(EntitySpec("harbor", key="Id"), spark.createDataFrame([(1, "A", "west"), (2, "B", "east"), (3, "C", "west")], "Id int, Name string, Coast string"))
    r.add(
        EntitySpec("ship", key="Id", indexes=(Index("Built", "range"),), foreign_keys=(ForeignKey("harbor", "HarborId", "one_to_many"),)),
        spark.createDataFrame([(1, "a1", 1, 2001), (2, "a2", 1, 2005), (3, "b1", 2, 2010), (4, "x", None, 2011)], "Id int, Label string, HarborId int, Built int"),
    )
    r.add(EntitySpec("permit", key="Id", foreign_keys=(ForeignKey("harbor", "HarborId", "one_to_one"),)), spark.createDataFrame([(10, 1, "open"), (11, 3, "open till 3")], "Id int, HarborId int, Note string"))
    r.add(EntitySpec("voyage", key="Id", foreign_keys=(ForeignKey("ship", "ShipId", "one_to_many"),)), spark.createDataFrame([(100, 1, 5), (101, 1, 3), (102, 3, 4)], "Id int, ShipId int, Cargo int"))
    tags = spark.createDataFrame([(1, "red"), (2, "blue"), (3, "none")], "Id int, Name string")
    r.add(EntitySpec("tag", key="Id"), tags)
    r.add(EntitySpec("tagged", key="Id", foreign_keys=(ForeignKey("tag", "TagIds", "many_to_one"),)), spark.createDataFrame([(1, [1, 2, 1]), (2, [2]), (3, []), (4, None), (5, [9])], "Id int, TagIds array<int>"))
    return r.validated()


def test_one_to_one_from_either_side(ports, rows):
    joined = ports.query("harbor").join_with("permit")
    assert rows(joined.map(F.col("Id"), F.col("permit.Note"))) == [(1, "open"), (2, None), (3, "open till 3")]
    assert rows(ports.query("harbor").inner_join_with("permit").map(F.col("Id"))) == [(1,), (3,)]
    assert rows(ports.query("permit").join_with("harbor").map(F.col("Id"), F.col("harbor.Name"))) == [(10, "A"), (11, "C")]


def test_outer_filter_narrows_the_right_only(ports, rows):
    late = lambda b: b.with_range("Built", gte=2005)
    sizes = lambda q: rows(q.map(F.col("Id"), F.size("ship")))
    assert sizes(ports.query("harbor").join_with("ship", narrow=late)) == [(1, 1), (2, 1), (3, 0)]
    assert sizes(ports.query("harbor").inner_join_with("ship", narrow=late)) == [(1, 1), (2, 1)]
    assert ports.query("harbor").join_with("ship", narrow=late).count() == 3
    assert ports.query("harbor").inner_join_with("ship", narrow=late).count() == 2


def test_nested_and_narrowed_parents(ports, rows):
    q = ports.query("harbor").where(F.col("Coast") == "west").join_with("ship", lambda b: b.join_with("voyage"))
    got = q.map(F.col("Id"), F.transform("ship", lambda b: F.size(b["voyage"])).alias("n"))
    assert [(i, sorted(n)) for i, n in rows(got)] == [(1, [0, 2]), (3, [])]


def test_many_to_many_both_ways(ports, rows):
    forward = ports.query("tagged").join_with("tag")
    names = F.array_sort(F.transform("tag", lambda t: t["Name"]))
    assert rows(forward.map(F.col("Id"), names)) == [(1, ["blue", "red"]), (2, ["blue"]), (3, []), (4, []), (5, [])]
    assert rows(ports.query("tagged").inner_join_with("tag").map(F.col("Id"))) == [(1,), (2,)]
    back = ports.query("tag").join_with("tagged")
    assert rows(back.map(F.col("Id"), F.array_sort(F.transform("tagged", lambda t: t["Id"])))) == [(1, [1]), (2, [1, 2]), (3, [])]


def test_selector_and_compound_key(spark, rows):
    berths = spark.createDataFrame([((1, 7), "x"), ((2, 7), "y"), ((1, 8), "z")], "Berth struct<Id:int,Dock:int>, Owner string")
    slots = spark.createDataFrame([(1, 100)], "SlotId int, Depth int")
    r = Registry()
    r.add(EntitySpec("slot", key="SlotId"), slots)
    r.add(EntitySpec("berth", key="Berth", foreign_keys=(ForeignKey("slot", "Berth", "one_to_one", selector=lambda k: k["Id"]),)), berths)
    got = r.query("berth").join_with("slot").map(F.col("Owner"), F.col("slot.Depth"))
    assert rows(got) == [("x", 100), ("y", None), ("z", 100)]  # every left gets its right


def test_dual_form_key(spark, rows):
    r = Registry()
    r.add(EntitySpec("left", key="Id", foreign_keys=(ForeignKey("right", "Id", "one_to_many", right_property="LeftId"),)), spark.createDataFrame([(1,), (2,)], "Id int"))
    r.add(EntitySpec("right", key="Id"), spark.createDataFrame([(5, 1), (6, 1)], "Id int, LeftId int"))
    r.validated()
    assert rows(r.query("right").join_with("left").map(F.col("Id"), F.col("left.Id"))) == [(5, 1), (6, 1)]
    assert rows(r.query("left").join_with("right").map(F.col("Id"), F.size("right"))) == [(1, 2), (2, 0)]


def test_last_writer_owns_a_unique_value(spark, rows):
    right = spark.createDataFrame([(1, 5, 10), (2, 5, 20), (3, 6, 5)], "Id int, Ref int, Seq int")
    left = Query(spark.createDataFrame([(5,), (6,), (7,)], "Id int"), EntitySpec("l", key="Id"))
    joined = left.join_one(right, right_on="Ref", latest=F.col("Seq"))
    assert rows(joined.map(F.col("Id"), F.col("right1.Id"))) == [(5, 2), (6, 3), (7, None)]


def test_pages_keep_the_total(ports, rows):
    q = ports.query("ship").sort([F.col("Built").desc()]).page(1, 2)
    assert [tuple(r) for r in q.with_total().select("Id", "total_count").collect()] == [(3, 4), (2, 4)]
    assert ports.query("ship").page(10, 5).with_total().count() == 0
    assert ports.query("ship").page(10, 5).count() == 4


def test_sixth_join_is_refused(ports):
    q = ports.query("harbor")
    for k in range(5):
        q = q.join_with("ship", alias=f"b{k}")
    with pytest.raises(ValueError):
        q.join_with("ship", alias="b5")


def test_or_without_filters_is_none(ports):
    q = ports.query("ship")
    assert q.or_(lambda b: b, lambda b: b.with_("HarborId", None)).predicate() is None
    assert q.use_index("Id", []).count() == 0 and q.use_index("HarborId", []).count() == 4
    assert q.or_(lambda b: b.use_index("Id", []), lambda b: b.use_index("HarborId", [])).count() == 0


def test_null_rules(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, v int")
    got = {op: [k for (k,) in rows(df.where(compare(F.col("v"), op, 5)).select("k"))] for op in ("==", "!=", ">", "<=")}
    assert got == {"==": [1], "!=": [2, 3], ">": [3], "<=": [1]}
    with pytest.raises(ValueError):
        between(F.col("v"), gt=1, gte=2)


def test_named_sort_puts_nulls_first(spark):
    df = spark.createDataFrame([(1, None, "Lo"), (2, 5, "Hi"), (3, 7, "Mid")], "k int, v int, e string")
    spec = EntitySpec("s", key="k", sorts={"up": ("v:1",), "down": ("v:-1",), "level": ("e:1",)}, ordinals={"e": ("Lo", "Mid", "Hi")})
    order = lambda name: [r.k for r in Query(df, spec).sort(name).to_df().collect()]
    assert (order("up"), order("down"), order("level")) == ([1, 2, 3], [3, 2, 1], [1, 3, 2])


def test_results(ports):
    q = ports.query("harbor").with_("Id", [1, 2])
    assert q.to_dict()[1].Name == "A" and q.to_json().count() == 2
    assert {r.entity: r.n_rows for r in registry_stats(ports).collect()}["ship"] == 4
    assert health({"a": {"failure": "x"}, "b": {"last_ms": 0}}, 100_000, ("c",)) == ["a: fatal", "b: stalled", "c: missing"]
    ill = {"x": {"lost_partitions": True, "brokers_up": 0, "loaded": False, "faulted": True, "partitions": 0, "handler_since_ms": 5}}
    assert [h.removeprefix("x: ") for h in health(ill, 100_000)] == ["partitions lost", "brokers down", "loading", "faulted", "no partition", "slow handler"]


SCHEMA = "Id int, Name string, Ref int, Refs array<int>, Flag boolean"


@pytest.mark.parametrize(
    ("code", "spec"),
    [
        ("NO_KEY", EntitySpec("e")),
        ("DUPLICATE_KEY", EntitySpec("e", key="Id", key_expr=lambda: F.col("Id"))),
        ("UNKNOWN_KEY", EntitySpec("e", key="Nope")),
        ("UNKNOWN_INDEX", EntitySpec("e", key="Id", indexes=(Index("Nope"),))),
        ("CAPACITY_NOT_MANY", EntitySpec("e", key="Id", indexes=(Index("Ref", "unique", capacity=5),))),
        ("RANGE_TYPE", EntitySpec("e", key="Id", indexes=(Index("Refs", "range"),))),
        ("COMPARE_OP", EntitySpec("e", key="Id", predicates=(PredicateIndex("Ref", "value", "~", 1),))),
        ("UNKNOWN_SORT", EntitySpec("e", key="Id", sorts={"s": ("Nope:1",)})),
        ("SORT_DIRECTION", EntitySpec("e", key="Id", sorts={"s": ("Name:2",)})),
        ("MANY_TO_ONE_INDEX", EntitySpec("e", key="Id", indexes=(Index("Ref", "unique"),), foreign_keys=(ForeignKey("t", "Ref", "many_to_one"),))),
        ("COLLECTION_CARDINALITY", EntitySpec("e", key="Id", foreign_keys=(ForeignKey("t", "Refs", "one_to_many"),))),
        ("COLLECTION_SELECTOR", EntitySpec("e", key="Id", foreign_keys=(ForeignKey("t", "Refs", "many_to_one", selector=lambda c: c),))),
        ("UNKNOWN_TARGET", EntitySpec("e", key="Id", foreign_keys=(ForeignKey("u", "Ref"),))),
        ("FOREIGN_KEY_TYPE", EntitySpec("e", key="Id", foreign_keys=(ForeignKey("t", "Name"),))),
        ("RIGHT_PROPERTY_MISSING", EntitySpec("e", key="Id", foreign_keys=(ForeignKey("t", "Id", right_property="Nope"),))),
    ],
)
def test_rules(spark, code, spec):
    r = Registry()
    r.add(EntitySpec("t", key="Id"), spark.createDataFrame([], "Id int"))
    with pytest.raises(SpecError) as e:
        spec.validate(spark.createDataFrame([], SCHEMA).schema, r)
    assert e.value.code == code


def test_has_value_needs_a_nullable_column(spark):
    df = spark.range(1)
    with pytest.raises(SpecError):
        EntitySpec("e", key="id", predicates=(PredicateIndex("id"),)).validate(df.schema)


PHASES = ("Planned", "Moving", "Done")
COLUMNS = "Id int, Kind string, Depot int, Phase string, Label string, Weight bigint, Grade int"


def crates():
    """Forty rows made by rule."""
    kinds = ("Tea", "Salt", "Rope")
    return [{"Id": k, "Kind": kinds[k * k % 3], "Depot": 7 + k % 4, "Phase": PHASES[k % 5 % 3], "Label": f"{chr(65 + k * 5 % 26)}{k}", "Weight": k * 37 % 101 * 10, "Grade": k * 13 % 50} for k in range(40)]


CRATE = EntitySpec("crate", key="Id", indexes=(Index("Kind"), Index("Depot"), Index("Phase"), Index("Weight", "range")), ordinals={"Phase": PHASES})


@pytest.mark.parametrize(
    ("text", "keep"),
    [
        ("Kind=Salt", lambda r: r["Kind"] == "Salt"),
        ("phase=moving", lambda r: r["Phase"] == "Moving"),
        ("Depot=8,10", lambda r: r["Depot"] in (8, 10)),
        ("Depot=[8,10]", lambda r: r["Depot"] in (8, 10)),
        ("Weight.gt=370", lambda r: r["Weight"] > 370),
        ("Weight.gte=370", lambda r: r["Weight"] >= 370),
        ("Weight=370", lambda r: r["Weight"] == 370),
        ("Grade.lt=13", lambda r: r["Grade"] < 13),
        ("Grade.lte=13", lambda r: r["Grade"] <= 13),
        ("Kind=Tea&Weight.gte=500", lambda r: r["Kind"] == "Tea" and r["Weight"] >= 500),
        ("Weight=110..740", lambda r: 110 <= r["Weight"] <= 740),
        ("Weight=(110..740)", lambda r: 110 < r["Weight"] < 740),
        ("Weight=[110..740)", lambda r: 110 <= r["Weight"] < 740),
        ("Weight=(110..740]", lambda r: 110 < r["Weight"] <= 740),
        ("Grade=13..26", lambda r: 13 <= r["Grade"] <= 26),
        ("Grade=(13..26)", lambda r: 13 < r["Grade"] < 26),
        ("Weight=>370", lambda r: r["Weight"] >= 370),
        ("Weight=<370", lambda r: r["Weight"] <= 370),
        ("?&&Absent=1", lambda r: True),
        ("Grade=many", lambda r: True),
        ("Grade=13,26", lambda r: True),
        ("Label>A0", lambda r: r["Label"] == "A0"),
        ("Label=A0,F1", lambda r: r["Label"] in ("A0", "F1")),
        ("Label", lambda r: False),
    ],
)
def test_query_strings(spark, text, keep):
    df = spark.createDataFrame([tuple(r.values()) for r in crates()], COLUMNS)
    assert {r.Id for r in querystring.run(CRATE, df, text).collect()} == {r["Id"] for r in crates() if keep(r)}


def test_query_string_pages_and_sorts(spark):
    df = spark.createDataFrame([tuple(r.values()) for r in crates()], COLUMNS)
    ids = lambda text, **k: [r.Id for r in querystring.run(CRATE, df, text, **k).collect()]
    assert ids("sort=-Grade&size=3") == [r["Id"] for r in sorted(crates(), key=lambda r: (-r["Grade"], r["Id"]))][:3]
    assert len(ids("from=90", compat=True)) == 40 and ids("from=90") == []
    assert len(ids("from=1&size=2", compat=True)) == 2 and len(ids("from=30&size=10", compat=True)) == 40


def test_rows_by_key(spark, ports):
    df = spark.createDataFrame([tuple(r.values()) for r in crates()], COLUMNS)
    assert [r.value for r in querystring.by_key(CRATE, df.select("Id", "Kind"), "4").collect()] == ['{"Id":4,"Kind":"Salt"}']
    assert querystring.by_key(CRATE, df, "400").count() == querystring.by_key(CRATE, df, "x").count() == querystring.by_key(CRATE, df, "1,2").count() == 0
    assert '"entity":"ship","n_rows":4' in registry_json(ports).first().value


def test_compound_keys(spark, rows):
    df = spark.createDataFrame([(a, b, a * b) for a in range(4) for b in range(4)], "A int, B int, P int")
    q = Query(df, EntitySpec("grid", key=("A", "B")))
    assert rows(q.with_("key", (2, 3)).map(F.col("P"))) == [(6,)]
    assert rows(q.with_("key", [(2, 3), {"A": 1, "B": 1}, (9, 9)]).map(F.col("P"))) == [(1,), (6,)]
    assert q.with_("key", (2, None)).count() == 0 and q.with_("A", 2).count() == 4 and q.use_index("key", []).count() == 0
    plan = q.with_("key", [(2, 3), (1, 1)]).to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan
    nested = spark.createDataFrame([((1, 2), "x"), ((3, 4), "y")], "K struct<a:int,b:int>, V string")
    assert rows(Query(nested, EntitySpec("n", key="K")).with_("K", (3, 4)).map(F.col("V"))) == [("y",)]


def test_unique_joins_never_multiply(spark, rows):
    right = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, None, "c")], "Id int, Ref int, Tag string")
    left = spark.createDataFrame([(5,), (6,), (5,)], "Ref int")
    r = Registry()
    r.add(EntitySpec("tagged", key="Id"), right)
    q = Query(left, EntitySpec("l", key="Ref"), r)
    for df in (right, "tagged"):
        assert rows(q.join_one(df, right_on="Ref", alias="t").map(F.col("Ref"), F.col("t.Tag"))) == [(5, "b"), (5, "b"), (6, None)]
    first = q.join_one("tagged", right_on="Ref", alias="t", narrow=lambda b: b.where(F.col("Tag") == "a"))
    assert rows(first.map(F.col("t.Tag"))) == [(None,)] * 3  # the holder doesn't pass, and nobody takes its place


def test_only_columns_asked_for_are_read(spark):
    from keyweave.plans.queries import QUERIES

    for name in ("join_many", "join_many_inner", "join_nested", "join_chain5"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "l_comment" not in plan and "l_shipdate" not in plan and "l_suppkey" not in plan.split("ReadSchema", 1)[1], name


def test_times_in_query_strings(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 6, 1))], "k int, t timestamp_ntz")
    assert [r.k for r in querystring.run(EntitySpec("e", key="k"), df, "t.gte=2024-03-01").collect()] == [2]
