"""Changelogs, recency and streams against plain models."""

import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyweave import EntitySpec
from keyweave.functions.equality import same
from keyweave.functions.scalars import header_value
from keyweave.operators import recency
from keyweave.sources import changelog, dump, messagepack
from keyweave.sources.config import from_kafka, topic_name
from keyweave.streaming.produce import Producer, wire
from keyweave.streaming.upsert import Follower, ParquetTable

VALUE = "struct<grp:string,n:int,note:string>"
ENVELOPE = f"topic string, partition int, offset bigint, ts_ms bigint, key int, value {VALUE}, headers array<struct<key:string,value:binary>>"
SPEC = EntitySpec("item", key="key", ignore_equality=("note",))


def log(spark, events):
    """Envelopes from (key, value or None, ts)."""
    return spark.createDataFrame([("t", 0, k, ts, key, value, []) for k, (key, value, ts) in enumerate(events)], ENVELOPE)


def model(events):
    """A dictionary and the transitions it goes through."""
    held, feed = {}, []
    for seq, (key, value, ts) in enumerate(events):
        old = held.get(key)
        if value is None:
            kind = "Filtered" if old is None else "Delete"
            held.pop(key, None)
        elif old is None:
            kind, held[key] = "Add", (value, ts)
        elif old[0][:2] == value[:2]:
            kind = "Same"
        else:
            kind, held[key] = "Update", (value, ts)
        feed.append((key, seq, kind, old[0] if old else None))
    return held, feed


def recency_model(events):
    """Group times and sizes by the ordered fold."""
    groups, held = {}, {}

    def add(g, ts, n):
        last, count = groups.get(g, (ts, 0))
        groups[g] = (max(last, ts), count + n)

    def remove(g, ts):
        count = groups[g][1] - 1
        groups.pop(g) if not count else groups.__setitem__(g, (ts, count))

    for key, value, ts in events:
        old = held.get(key)
        if value is None:
            if old:
                remove(old[0], ts)
                del held[key]
        elif old is None:
            held[key] = value
            add(value[0], ts, 1)
        elif old[:2] != value[:2]:
            held[key] = value
            if old[0] == value[0]:
                add(value[0], ts, 0)
            else:
                remove(old[0], ts)
                add(value[0], ts, 1)
    return {(g, ts, n) for g, (ts, n) in groups.items()}


EVENTS = st.lists(st.tuples(st.integers(0, 3), st.none() | st.tuples(st.sampled_from("ab"), st.integers(0, 1), st.sampled_from(["p", None])), st.integers(0, 50)), min_size=1, max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EVENTS)
def test_folds_match_the_model(spark, events):
    rows = log(spark, events)
    held, feed = model(events)
    got = changelog.transitions(rows, SPEC)
    assert {(r.key, r.seq, r.update_type, tuple(r.old) if r.old else None) for r in got.collect()} == set(feed)
    assert {(r.key, tuple(r.value), r.ts_ms) for r in changelog.held(rows, SPEC).collect()} == {(k, v, ts) for k, (v, ts) in held.items()}
    assert {r.key for r in changelog.latest_by_key(rows).collect()} == set(held)
    relation = recency.last_update(recency.events(changelog.change_feed(rows, SPEC), "grp"))
    assert {(r.grp, r.last_ts, r.n) for r in relation.collect()} == recency_model(events)


def test_older_time_still_overwrites(spark):
    rows = log(spark, [(1, ("a", 1, None), 100), (1, ("a", 2, None), 50)])
    assert changelog.held(rows, SPEC).first().value.n == 2
    relation = recency.last_update(recency.events(changelog.change_feed(rows, SPEC), "grp")).first()
    assert (relation.last_ts, relation.n) == (100, 1)


def test_filtered_recency(spark, rows):
    events = [(1, ("a", 1, None), 10), (2, ("a", 0, None), 20), (1, ("a", 0, None), 30), (2, ("b", 1, None), 40)]
    feed = changelog.change_feed(log(spark, events), SPEC)
    enabled = lambda side: F.col(f"{side}.n") == 1
    assert rows(recency.last_update(recency.events(feed, "grp", where=enabled))) == [("b", 40, 1)]
    own = recency.last_update(recency.events(feed, "grp", ts=F.col("new.n") * 1000))
    assert rows(own) == [("a", 0, 1), ("b", 1000, 1)] or rows(own) == [("a", 40, 1), ("b", 1000, 1)]


def test_headers(spark, rows):
    heads = lambda **k: [(n.replace("_", "-"), v) for n, v in k.items()]
    df = spark.createDataFrame([("t", 0, 0, 5, 1, ("a", 1, None), heads(tenant=struct.pack("<i", -7), kind=b"x")), ("t", 0, 1, 6, 2, ("a", 1, None), heads(big=struct.pack("<q", 2**40))), ("t", 0, 2, 7, 3, None, [])], ENVELOPE)
    h = F.col("headers")
    assert rows(df.select("key", header_value(h, "tenant", "int"), header_value(h, "big", "long"), header_value(h, "kind", "string"))) == [(1, -7, None, "x"), (2, None, 2**40, None), (3, None, None, None)]
    exists = (changelog.HeaderFilter("tenant", "exists"), changelog.HeaderFilter("big", "exists"))
    assert rows(changelog.decided(df, exists).select("key", "decision")) == [(1, "keep"), (2, "keep"), (3, "skip")]
    strict = (changelog.HeaderFilter("kind", "predicate", predicate=lambda v: v == "x", pass_on_null=False),)
    assert rows(changelog.decided(df, strict).select("key", "decision")) == [(1, "keep"), (2, "skip"), (3, "skip")]
    spec = EntitySpec("item", key="key", headers={"note": "kind"}, timestamp_columns=())
    assert [r.value.note if r.value else None for r in changelog.enriched(df, spec).orderBy("key").collect()] == ["x", None, None]


def test_filters_first_reject_wins(spark, rows):
    df = log(spark, [(1, ("a", 1, None), 1), (2, ("a", 9, None), 1), (3, None, 1), (4, ("a", None, None), 1)])
    got = changelog.decided(df, key_filters=(changelog.RowFilter(F.col("key") != 1, True),), value_filters=(changelog.RowFilter(F.col("value.n") < 5),))
    assert rows(got.select("key", "decision")) == [(1, "delete"), (2, "skip"), (3, "delete"), (4, "skip")]
    assert {r.key: r.value for r in changelog.applied(got).collect()} == {1: None, 3: None}


def test_writes_and_dump(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "key int, v string")
    spec = EntitySpec("e", key="key")
    written = changelog.upserts(df, spec, F.col("key").cast("long"), 5, "e")
    gone = changelog.deletes(df.where("key = 1").select("key"), spec, written.schema["value"].dataType, 9, 6, "e")
    both = changelog.fan_in(written, gone)
    assert [r.key for r in changelog.latest_by_key(both).collect()] == [2]
    assert changelog.compacted(both).count() == 2
    dump.create_dump(both, tmp_path.as_uri() + "/d")
    assert dump.load_dump(spark, tmp_path.as_uri() + "/d").count() == 3


def test_topic_names(monkeypatch):
    monkeypatch.setenv("ZONE", "eu")
    assert topic_name(" [v:team]-[e:ZONE]-[e:NOPE] ", "x", {"team": "core"}) == "core-eu-[e:NOPE]"
    assert topic_name(None, "orders") == "orders"


def test_structural_equality(spark):
    schema = "s struct<tags:array<int>,list:array<int>,m:map<string,int>,seen:int>"
    df = spark.createDataFrame([(([1, 2], [1, 2], {"a": 1, "b": 2}, 1), ([2, 1, 1], [1, 2], {"b": 2, "a": 1}, 9)), (([1], [1, 2], {}, 1), ([1], [2, 1], {}, 1)), (None, None)], schema.replace("s struct", "x struct") + ", " + schema.replace("s struct", "y struct"))
    got = [r[0] for r in df.select(same(F.col("x"), F.col("y"), df.schema["x"].dataType, sets=("tags",), ignore=("seen",))).collect()]
    assert got == [True, False, True]


def test_load_is_silent_then_live(spark, tmp_path):
    from keyweave.streaming.upsert import Follower, ParquetTable, stream_feed

    folder, top = (tmp_path / "log").as_uri(), tmp_path.as_uri()
    first = [(1, ("a", 1, "x"), 1), (1, ("a", 1, "y"), 2), (2, ("b", 2, None), 3), (2, None, 4), (3, None, 5)]
    rows = log(spark, first)
    rows.coalesce(1).write.parquet(folder)
    seen = []
    kind = rows.schema["value"].dataType
    table = ParquetTable(spark, f"{top}/table", rows.schema["key"].dataType, kind)

    def follower():
        feed = stream_feed(spark.readStream.schema(rows.schema).parquet(folder), SPEC)
        return Follower(feed, f"{top}/checkpoint", table.apply).on_change(lambda df, _: seen.extend((r.key, r.update_type) for r in df.collect()))

    follower().load()
    assert seen == [] and {r.key: tuple(r.value) for r in table.read().collect()} == {1: ("a", 1, "x")}
    more = [(1, ("a", 1, "z"), 6), (1, ("a", 5, "z"), 7), (4, ("c", 1, None), 8), (4, None, 9), (1, None, 10), (5, ("d", 1, None), 11)]
    log(spark, [*first, *more]).where(f"offset >= {len(first)}").coalesce(1).write.mode("append").parquet(folder)
    live = follower().follow_available()
    assert live.failures == []
    assert seen == [(1, "Update"), (4, "Add"), (4, "Delete"), (1, "Delete"), (5, "Add")]
    assert {r.key for r in table.read().collect()} == {5}


def test_handler_failure_is_noted(spark, tmp_path):
    from keyweave.streaming.upsert import Follower

    folder = (tmp_path / "log").as_uri()
    spark.range(1).select(F.col("id").alias("seq")).write.parquet(folder)

    def broken(df, batch_id):
        raise RuntimeError("no")

    feed = spark.readStream.schema("seq bigint").parquet(folder)
    live = Follower(feed, (tmp_path / "c").as_uri()).on_change(broken).follow_available()
    assert live.failures == ["broken: no"]


@pytest.mark.parametrize(("after", "until", "want"), [(5, None, ["b", "c"]), (0, 5, ["a"]), (5, 9, ["b"]), (99, None, [])])
def test_windows_are_open_below(spark, after, until, want):
    relation = spark.createDataFrame([("a", 5, 1), ("b", 9, 1), ("c", 12, 1)], "grp string, last_ts bigint, n bigint")
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    assert sorted(r.g for r in recency.updated_after(df, relation, "g", after, until).collect()) == want
    assert recency.newest_walked(relation, after, until).first()[0] == {"b": 9, "c": 12, "a": 5}.get((want or [""])[-1], 0)


def test_hot_keys_in_stretches(spark, rows):
    """Most rows on one key: short stretches give the same feed as one, and no window holds a whole history."""
    import random

    rng = random.Random(4)
    value = lambda: rng.choice([None, ("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z")])
    events = [(0 if rng.random() < 0.8 else rng.randrange(4), value(), k) for k in range(400)]
    feeds = [rows(changelog.transitions(log(spark, events), SPEC, stretch=n).select("key", "seq", "update_type", "old", "new")) for n in (1, 7, 1 << 20)]
    assert feeds[0] == feeds[1] == feeds[2]
    assert sorted((k, s, u) for k, s, u, *_ in feeds[0]) == sorted((k, s, u) for k, s, u, _ in model(events)[1])
    plan = changelog.transitions(log(spark, events), SPEC)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "_turn" in line.split("windowspecdefinition")[0]]
    assert all("_stretch" in line.split("windowspecdefinition(")[1] for line in windows)


def test_headers_come_back(spark, rows):
    kinds = {"u": "uuid"}
    value = "struct<k:int,i:int,l:bigint,s:string,u:string,b:binary>"
    spec = EntitySpec("h", key="k", headers={c: f"h-{c}" for c in "ilsub"})
    data = [(1, -5, -(1 << 40), "ü", "00112233-4455-6677-8899-aabbccddeeff", bytearray(b"\x00\x01")), (2, 2**31 - 1, 2**63 - 1, "", "ffffffff-0000-1111-2222-333333333333", bytearray()), (3, None, None, None, None, None)]
    feed = spark.createDataFrame([(r[0], "Add", r) for r in data], f"key int, update_type string, new {value}")
    sent = changelog.to_produce(feed, spec, "me", kinds=kinds)
    raw = {h.key: bytes(h.value) for r in sent.where("key = 1").collect() for h in r.headers}
    assert raw["h-i"] == struct.pack("<i", -5) and raw["h-l"] == struct.pack("<q", -(1 << 40))
    assert raw["h-u"].hex() == "33221100554477668899aabbccddeeff"
    wide = sent.select("key", F.struct("key", *(F.lit(None).cast(t).alias(c) for c, t in zip("ilsub", ("int", "bigint", "string", "string", "binary"), strict=True))).alias("value"), "headers")
    assert [tuple(r) for r in changelog.enriched(wide, spec, kinds).orderBy("key").select("value.*").collect()] == data


def test_packed_numbers_in_headers(spark):
    for kind, raw, want in (("int", b"\x07", 7), ("int", b"\xff", -1), ("int", b"\xcc\xc8", 200), ("long", b"\xd2\xff\xff\xff\xfe", -2), ("long", b"\xcf" + b"\x00" * 7 + b"\x05", 5), ("int", b"\xcf" + b"\xff" * 8, None), ("int", b"\x80", None)):
        df = spark.createDataFrame([([("n", bytearray(raw))],)], "headers array<struct<key:string,value:binary>>")
        assert df.select(header_value(F.col("headers"), "n", kind)).first()[0] == want, raw


def test_kafka_rows(spark):
    """Rows as Kafka's source gives them: poison is put aside, a null value is a tombstone, keys have their type."""
    import datetime as dt

    from pyspark.sql.types import IntegerType

    schema = spark.createDataFrame([], VALUE.removeprefix("struct<").removesuffix(">").replace(":", " ")).schema
    rows = [("1", '{"grp":"a","n":2}'), ("2", None), ("3", "{oops"), ("x", '{"grp":"b"}'), ("4", '["no"]')]
    made = [(k.encode(), v.encode() if v else None, "t", 0, i, dt.datetime(2024, 1, 1), []) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(made, "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, headers array<struct<key:string,value:binary>>")
    got = {r.offset: (r.key, r.value.grp if r.value else None, r.quarantine) for r in from_kafka(df, schema, IntegerType()).collect()}
    assert got[0] == (1, "a", None) and got[1] == (2, None, None) and got[2] == (3, None, "{oops") and got[3] == (None, None, "x") and got[4][2]


def test_messagepack(spark):
    schema = spark.createDataFrame([], "a int, s string, t timestamp, l array<int>").schema
    when = b"\xd6\xff" + struct.pack(">I", 86400)
    by_name = b"\x84\xa1a\x05\xa1s\xa2hi\xa1t" + when + b"\xa1l\x92\x01\xd1\xff\x00"
    by_order = b"\x94\xd0\xfb\xd9\x03\xe2\x82\xac\xc0\x90"
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate([by_name, by_order, None, by_name[:-1], b"\xc1", b"\x05"])], "i int, value binary")
    got = {r.i: r for r in changelog.parsed(df, schema, decoder=messagepack.decoder).collect()}
    assert got[0].value.a == 5 and got[0].value.s == "hi" and got[0].value.l == [1, -256] and got[0].value.t.timestamp() == 86400
    assert (got[1].value.a, got[1].value.s, got[1].value.t, got[1].value.l) == (-5, "€", None, [])
    assert got[2].value is None and got[2].quarantine is None
    assert [got[i].quarantine for i in (3, 4, 5)] == [by_name[:-1].hex().upper(), "C1", "05"] and got[3].value is None


def test_table_survives_restart_and_replay(spark, tmp_path, rows):
    kinds = (log(spark, []).schema["key"].dataType, log(spark, []).schema["value"].dataType)
    folder = tmp_path.as_uri()
    feed = lambda *events: spark.createDataFrame([(k, "Update", v, None, s, s) for s, (k, v) in enumerate(events)], f"key int, update_type string, new {VALUE}, old {VALUE}, seq bigint, ts_ms bigint")
    first = ParquetTable(spark, folder, *kinds, buckets=4)
    assert first.read().count() == 0
    first.apply(feed(*((k, ("a", k, "")) for k in range(20))), 0)
    second = ParquetTable(spark, folder, *kinds, buckets=4)  # as after a restart
    second.apply(feed((3, ("b", 3, "")), (99, ("c", 9, "")), (4, None)), 1)
    second.apply(feed((3, None)), 1)  # the same batch again
    held = {r.key: r.value.grp for r in ParquetTable(spark, folder, *kinds, buckets=4).read().collect()}
    assert held == {k: "a" for k in range(20) if k not in (3, 4)} | {3: "b", 99: "c"}
    versions = second.manifest()["versions"]
    assert set(versions.values()) == {0, 1}  # buckets that the batch didn't touch are as they were
    second.apply(feed(*((k, None) for k in [*range(20), 99])), 2)
    assert second.read().count() == 0


def test_producer_writes_what_changed(spark, tmp_path):
    feed = changelog.transitions(log(spark, [(1, ("a", 1, ""), 0), (1, ("a", 1, "same"), 1), (2, ("b", 2, ""), 2), (1, None, 3)]), SPEC)
    out = Producer(SPEC, "me", "out", folder=tmp_path.as_uri())
    out(feed, 0)
    out(feed, 0)
    sent = spark.read.parquet(tmp_path.as_uri())
    assert sorted((r.key, r.value is None) for r in sent.collect()) == [(1, False), (1, True), (2, False)]
    assert {(r.key, r.value) for r in wire(sent.where("key = 2")).select("key", "value").collect()} == {("2", '{"grp":"b","n":2,"note":""}')}
    with pytest.raises(ValueError):
        Producer(SPEC, "me")


def test_load_timeout_names_what_is_pending(spark, tmp_path):
    events = [(1, ("a", 1, ""), 0)]
    log(spark, events).write.parquet(f"{tmp_path}/log")
    slow = lambda rows, batch: __import__("time").sleep(20)
    stream = spark.readStream.schema(log(spark, []).schema).parquet(f"{tmp_path}/log")
    with pytest.raises(TimeoutError, match="laggard"):
        Follower(stream, f"{tmp_path}/c", slow, "laggard").load(seconds=3)
