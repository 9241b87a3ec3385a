"""Version log, change detection, agents and the streaming queries."""

import pytest
from pyspark.sql import functions as F

from treelode.operators import agents, diff, versions
from treelode.plans.workspace import Workspace
from treelode.streaming.changelog import latest_changes, read_log
from treelode.streaming.watch import Watcher

LOG = "path STRING, seq BIGINT, op STRING, timestamp_ms BIGINT, size BIGINT"


@pytest.fixture
def log(spark):
    rows = [("a", 1, "snapshot", 10, 1), ("b", 2, "snapshot", 11, 2), ("a", 3, "replace", 12, 3), ("b", 4, "tombstone", 13, 0)]
    return spark.createDataFrame(rows, LOG)


def as_dict(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) for r in df.collect()}


def test_reads(log, spark):
    assert as_dict(versions.changes_since(log), "path", "op", "seq") == {"a": ("replace", 3), "b": ("tombstone", 4)}
    assert as_dict(versions.changes_since(log, 3), "path", "seq") == {"b": (4,)}
    assert versions.changes_since(log, 99).count() == 0
    assert as_dict(versions.at_cursor(log, 2), "path", "seq") == {"a": (1,), "b": (2,)}
    assert versions.changes_count(log, 1).first()[0] == 3
    assert versions.current_seq(log).first()[0] == 4
    assert versions.current_seq(log.filter("false")).first()[0] == 0
    tracked = spark.createDataFrame([("a",), ("c",)], "path STRING")
    assert [tuple(r) for r in versions.hot_files(tracked, log, 5).collect()] == [("a", 3), ("c", 0)]


def test_version_cap(spark):
    log = spark.range(1, 351).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 2)).alias("path"),
        F.col("id").alias("seq"), F.lit("snapshot").alias("op"),
    )
    kept = versions.retained(log)
    assert as_dict(kept.groupBy("path").agg(F.count("*").alias("n"), F.max("seq").alias("m")), "path", "n", "m")["hot"] == (100, 348)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # pruned before the shuffle, too


def test_sequence_is_dense_and_ordered(spark):
    df = spark.range(1000).select(F.format_string("f%04d", F.pmod(F.col("id") * 7919, F.lit(1000))).alias("path"))
    rows = versions.number_rows(df, ["path"], start=41).orderBy("seq").collect()
    assert [(r["path"], r["seq"]) for r in rows] == [(f"f{i:04d}", 42 + i) for i in range(1000)]
    assert versions.number_rows(df.filter("false"), ["path"]).count() == 0


def test_diff_cascade(spark):
    schema = "path STRING, mtime_ms BIGINT, size BIGINT, hash BIGINT"
    known = spark.createDataFrame(
        [("same", 1, 5, 9), ("touched", 1, 5, 9), ("edited", 1, 5, 9), ("grown", 1, 5, 9), ("nohash", 1, 5, 0), ("gone", 1, 5, 9)], schema
    )
    now = spark.createDataFrame(
        [("same", 1, 5, None), ("touched", 2, 5, 9), ("edited", 2, 5, 8), ("grown", 2, 6, None), ("nohash", 2, 5, 9), ("new", 2, 1, None)], schema
    )
    assert as_dict(diff.diff(known, now), "path", "change") == {
        "same": ("unchanged",), "touched": ("unchanged",), "edited": ("modified",), "grown": ("modified",),
        "nohash": ("modified",), "gone": ("deleted",), "new": ("created",),
    }
    assert {r["path"] for r in diff.needs_hash(known, now).collect()} == {"touched", "edited"}
    ops = as_dict(diff.to_versions(diff.diff(known, now)), "path", "op", "size")
    assert ops["gone"] == ("tombstone", 0) and ops["grown"] == ("snapshot", 6) and "same" not in ops


def test_agents(spark):
    none = spark.createDataFrame([], "id BIGINT, name STRING, state STRING, cursor BIGINT, last_seen BIGINT, edit_count BIGINT")
    names = spark.createDataFrame([("ann", 1), ("bob", 2)], "name STRING, ord BIGINT")
    table = agents.register(none, names, next_id=1, now_ms=100)
    assert as_dict(table, "name", "id", "state", "last_seen") == {"ann": (1, "active", 100), "bob": (2, "active", 100)}
    leases = spark.createDataFrame([(1, "a", 900), (2, "b", 900)], "agent_id BIGINT, path STRING, expiry BIGINT")
    table = agents.heartbeat(table, spark.createDataFrame([(1, 400)], "id BIGINT, at_ms BIGINT"))
    table, leases = agents.reap_stale(table, leases, timeout_ms=200, now_ms=500)
    assert as_dict(table, "name", "state") == {"ann": ("active",), "bob": ("crashed",)}
    assert [r["path"] for r in leases.collect()] == ["a"]
    table = agents.heartbeat(table, spark.createDataFrame([(2, 600)], "id BIGINT, at_ms BIGINT"))
    assert as_dict(table, "name", "state")["bob"] == ("active",)


def grant_one_by_one(held, requests, now):
    """Requests in order against a dict of leases, as single calls would be."""
    held, out = dict(held), {}
    for req, agent, path, ttl in sorted(requests):
        other = any(p == path and a != agent and now < e for (a, p), e in held.items())
        out[req] = not other
        if not other:
            held = {k: e for k, e in held.items() if k[1] != path or k[0] == agent}
            held[agent, path] = now + ttl
    return out, held


def test_leases_equal_sequential_calls(spark):
    held = {(1, "a"): 2000, (2, "b"): 500, (3, "c"): 2000}
    requests = [
        (1, 2, "a", 60), (2, 1, "a", 60), (3, 2, "b", 60), (4, 1, "b", 60), (5, 9, "z", 60), (6, 8, "z", 60), (7, 9, "z", 70), (8, 1, "b", 5),
    ]
    want, after = grant_one_by_one(held, requests, 1000)
    leases = spark.createDataFrame([(a, p, e) for (a, p), e in held.items()], "agent_id BIGINT, path STRING, expiry BIGINT")
    asked = spark.createDataFrame(requests, "req BIGINT, agent_id BIGINT, path STRING, ttl_ms BIGINT")
    decided = agents.grant(leases, asked, 1000)
    assert {r["req"]: r["granted"] for r in decided.collect()} == want
    got = agents.apply_grants(leases, decided, 1000)
    assert {(r["agent_id"], r["path"]): r["expiry"] for r in got.collect()} == after
    freed = agents.release(got, spark.createDataFrame([(3, "c")], "agent_id BIGINT, path STRING"))
    assert freed.filter("path = 'c'").count() == 0


def test_an_expired_lease_stays_until_its_path_is_granted(spark):
    held = {(1, "a"): 500, (2, "b"): 500, (3, "c"): 2000}
    requests = [(1, 9, "b", 60), (2, 9, "c", 60)]
    _, after = grant_one_by_one(held, requests, 1000)
    assert after[1, "a"] == 500
    leases = spark.createDataFrame([(a, p, e) for (a, p), e in held.items()], "agent_id BIGINT, path STRING, expiry BIGINT")
    asked = spark.createDataFrame(requests, "req BIGINT, agent_id BIGINT, path STRING, ttl_ms BIGINT")
    got = agents.apply_grants(leases, agents.grant(leases, asked, 1000), 1000)
    assert {(r["agent_id"], r["path"]): r["expiry"] for r in got.collect()} == after


def test_streaming_latest_changes(spark, log, tmp_path):
    source = str(tmp_path / "log")
    log.filter("seq <= 2").write.mode("append").parquet(source)
    log.filter("seq > 2").write.mode("append").parquet(source)
    query = (
        latest_changes(read_log(spark, source, 1, LOG)).writeStream.outputMode("complete").format("memory")
        .queryName("latest_changes").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert as_dict(spark.table("latest_changes"), "path", "op", "seq") == {"a": ("replace", 3), "b": ("tombstone", 4)}


def test_watcher_picks_up_an_edit(spark, tree_of, tmp_path):
    ws = Workspace(spark, tree_of({"a.py": "def a(): pass\n"}), str(tmp_path / "state"))
    ws.index()
    notify = tmp_path / "notify"
    notify.mkdir()
    watcher = Watcher(ws, notify_dir=str(notify)).start()
    try:
        assert ws.status()["watcher_running"] is True
        with open(f"{ws.root}/b.py", "w") as handle:
            handle.write("def b(): pass\n")
        for _ in range(60):
            if ws.current_seq() > 1:
                break
            watcher.queries[0].awaitTermination(1)
        assert ws.current_seq() == 2
    finally:
        watcher.stop()
    assert {r["name"] for r in ws.symbols().collect()} == {"a", "b"}
    watcher.on_notify(spark.createDataFrame([("a.py",), ("../x",)], "value STRING"), 0)
    assert ws.current_seq() == 3
