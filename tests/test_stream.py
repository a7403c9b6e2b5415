"""The masking state over a stream of files, and its decisions."""

import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from veilframe.plans import config as C
from veilframe.plans.engine import Engine
from veilframe.streaming.guard import decide, guard, masked_with_reload
from veilframe.streaming.limiter import limit, take
from veilframe.streaming.store import Shelf, capped_guard, reloading_guard
from veilframe.streaming.windows import rates, sessions


def drain(q, rows, seconds=90):
    """Waits until a query has committed so many rows, and stops it: with timers it never ends by itself."""
    end = time.time() + seconds
    while time.time() < end and q.isActive and sum(p["numInputRows"] for p in q.recentProgress) < rows:
        time.sleep(0.3)
    q.stop()
    assert q.exception() is None


def row(payload, masked, **more):
    return SimpleNamespace(payload=payload, masked=masked, masked_already="**" in payload, may_store=True, **more)


def test_decisions():
    limit = 1 << 20
    assert decide(row("a@b", "**"), None, limit) == ("mask", "**", ("a@b", "**"))
    assert decide(row("**", "**"), ("a@b", "**"), limit) == ("demask", "a@b", ("a@b", "**"))
    assert decide(row("a@b", "**"), ("a@b", "**"), limit) == ("again", "**", ("a@b", "**"))
    assert decide(row("c@d", "++"), ("a@b", "**"), limit) == ("mask", "++", ("c@d", "++"))
    assert decide(row("x**", "x**"), None, limit) == ("echo", "x**", None)
    assert decide(row("plain", "plain"), None, limit) == ("mask", "plain", None)
    assert decide(row("a@b", "**"), None, 2) == ("mask", "**", None)


def test_identity_entries():
    limit = 1 << 20
    assert decide(row("plain", "plain"), None, limit, True) == ("mask", "plain", ("plain", "plain"))
    assert decide(row("x ** y", "x ** y"), ("x ** y", "x ** y"), limit, True) == ("demask", "x ** y", ("x ** y", "x ** y"))


def test_rules_change_between_batches(spark, tmp_path):
    schema = "payload_id string, payload string, system_id string"
    made, path = C.default(), str(tmp_path / "config.json")
    C.save(made, path)
    out = {}

    def write(masked, batch_id):
        out[batch_id] = [r.masked for r in masked.collect()]

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    for enabled in (True, False):
        made.systems[0].types["EMAIL"].enabled = enabled
        C.save(made, path)
        spark.createDataFrame([("a", "почта ivan.p@mail.ru", "default")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = masked_with_reload(stream, lambda: C.load(path), write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [out[k] for k in sorted(out)] == [["почта iv**.*@****.ru"], ["почта ivan.p@mail.ru"]]


def test_forward_then_back(spark, tmp_path):
    schema = "seq long, payload_id string, payload string, system_id string"
    one = [(1, "A", "почта ivan.p@mail.ru", "default"), (2, "b", "тел. +7 916 123-45-67", "analytics"), (3, "", "почта ivan.p@mail.ru", "default")]
    two = [(4, " a ", "почта iv**.*@****.ru", "default"), (5, "a", "почта ivan.p@mail.ru", "default"), (6, "b", "тел. +7 9** ***-**-67", "analytics"), (7, "zz", None, "default")]
    src = tmp_path / "in"
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
        stream = spark.readStream.schema(schema).json(str(src))
        q = guard(stream, Engine(C.default())).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        drain(q, len(rows))
    got = {r.seq: (r.operation, r.result) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got[1] == ("mask", "почта iv**.*@****.ru")
    assert got[3][0] == "mask" and got[7] == ("mask", "")
    assert got[4] == ("demask", "почта ivan.p@mail.ru")
    assert got[5] == ("again", "почта iv**.*@****.ru")
    assert got[6][0] == "echo"  # analytics stores nothing


def test_token_bucket(spark, tmp_path):
    assert take(1.0, 0.0, 0.0, 60) == (True, 0.0, 0.0)
    assert take(0.0, 0.0, 0.5, 60) == (False, 0.5, 0.5)
    assert take(0.0, 0.0, 3600.0, 60) == (True, 59.0, 0.0)
    rows = [(i, "a" if i < 5 else "b", f"2024-01-01 00:00:0{i % 5}") for i in range(7)]
    spark.createDataFrame(rows, "seq long, system_id string, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, system_id string, ts timestamp").json(str(tmp_path / "in"))
    q = limit(stream, 2).writeStream.format("memory").queryName("limits").outputMode("append").start()
    drain(q, len(rows))
    assert {r.seq: r.allowed for r in spark.table("limits").collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", "mask", "s1") for s in (1, 2, 5, 40)]
    spark.createDataFrame(rows, "ts string, op string, system_id string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, op string, system_id string").json(str(tmp_path / "in"))
    for name, df in (("w_rates", rates(stream, slide="10 seconds")), ("w_sessions", sessions(stream, gap="10 seconds"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w_rates" else "append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {(str(r.start)[-8:], r.n) for r in spark.table("w_rates").select(F.date_format("start", "HH:mm:ss").alias("start"), "n").collect()} == {("00:00:00", 3), ("00:00:40", 1)}


class Memory(dict):
    def put(self, key, value):
        self[key] = value

    def remove(self, key):
        self.pop(key, None)


def test_shelf_against_a_plain_list():
    """Random puts, expiries and evictions: what stays is what a list in order of the last put says."""
    import random

    r = random.Random(6)
    for _ in range(50):
        shelf, order, now = Shelf(Memory(), Memory()), [], 0
        for _ in range(200):
            now += r.randrange(3)
            key = str(r.randrange(12))
            if r.random() < 0.7:
                shelf.put(key, key, "*" + key, now + 20)
                order = [x for x in order if x[0] != key] + [(key, now + 20)]
            elif r.random() < 0.5:
                assert shelf.expire(now) == [k for k, until in order if until <= now]
                order = [x for x in order if x[1] > now]
            else:
                cap = r.randrange(4, 12)
                gone = shelf.evict(cap)
                assert gone == [k for k, _ in order[: max(0, len(order) - cap)]]
                order = order[max(0, len(order) - cap) :]
            assert shelf.count == len(order) == len(shelf.entries) and all(shelf.get(k) == (k, "*" + k) for k, _ in order)
        assert len(shelf.queue) <= 200


def test_capped_store_evicts_expires_and_restarts(spark, tmp_path):
    schema = "seq long, payload_id string, payload string, system_id string"
    text = "почта {}van.p@mail.ru"
    mask = "почта {}**.*@****.ru"
    config = C.default()
    config.store.shards, config.store.max_entries, config.store.ttl_ms = 1, 3, 3_600_000
    rows = [(i, f"p{i}", text.format("ab"[i % 2]), "default") for i in range(5)]
    back = [(10 + i, f"p{i}", mask.format("ab"[i % 2] + "v"), "default") for i in range(5)]
    src = tmp_path / "in"
    for batch in (rows, back):  # the second run starts from the checkpoint
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(src))
        stream = spark.readStream.schema(schema).json(str(src))
        q = capped_guard(stream, Engine(config)).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        drain(q, len(batch))
    got = spark.read.schema("seq long, payload_id string, operation string, result string").json(str(tmp_path / "out")).collect()
    assert sorted(r.payload_id for r in got if r.operation == "evicted") == ["p0", "p1"]  # the oldest over the cap
    assert {r.seq: r.operation for r in got if r.seq is not None and r.seq >= 10} == {10: "echo", 11: "echo", 12: "demask", 13: "demask", 14: "demask"}
    assert {r.result for r in got if r.operation == "demask"} == {text.format("a"), text.format("b")}


def test_a_timer_sweeps_the_store(spark, tmp_path):
    schema = "seq long, payload_id string, payload string, system_id string"
    config = C.default()
    config.store.shards, config.store.ttl_ms = 1, 500
    spark.createDataFrame([(1, "p", "почта ivan.p@mail.ru", "default")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = capped_guard(stream, Engine(config)).writeStream.format("memory").queryName("swept").outputMode("append").start()
    end = time.time() + 60
    while time.time() < end and spark.table("swept").where("operation = 'expired'").isEmpty():
        time.sleep(0.5)
    q.stop()
    assert [(r.payload_id, r.seq) for r in spark.table("swept").where("operation = 'expired'").collect()] == [("p", None)]


def test_a_mapping_outlives_changed_rules(spark, tmp_path):
    schema = "payload_id string, payload string, system_id string"
    made, path, out = C.default(), str(tmp_path / "config.json"), {}

    def write(done, batch_id):
        out[batch_id] = {r.payload_id: (r.operation, r.result) for r in done.collect()}

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    steps = [(True, [("a", "почта ivan.p@mail.ru")]), (False, [("A ", "почта iv**.*@****.ru"), ("b", "почта anna.k@mail.ru")]), (True, [("a", "почта ivan.p@mail.ru")])]
    for enabled, rows in steps:
        made.systems[0].types["EMAIL"].enabled = enabled
        C.save(made, path)
        spark.createDataFrame([(*r, "default") for r in rows], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = reloading_guard(stream, lambda: C.load(path), str(tmp_path / "mapping"), write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert q.exception() is None
    assert [out[k] for k in sorted(out)] == [
        {"a": ("mask", "почта iv**.*@****.ru")},
        {"A ": ("demask", "почта ivan.p@mail.ru"), "b": ("mask", "почта anna.k@mail.ru")},  # the rule is off now, the mapping is there
        {"a": ("again", "почта iv**.*@****.ru")},
    ]
