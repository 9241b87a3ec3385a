"""Agents and leases as keyed state: decisions follow event time, whatever the batches are."""

import datetime as dt
import random

from treelode.streaming import agents

START = dt.datetime(2024, 1, 1)
BASE = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)


def moment(ms):
    return START + dt.timedelta(milliseconds=ms)


def brute(events, timeout):
    """The same rules, one event after the other over a global clock."""
    state, seen, asked, holder, out = {}, {}, {}, {}, []

    def let_go(agent, at):
        for path in list(asked.pop(agent, {})):
            free(path, agent, asked_req.get((agent, path)), at)

    def free(path, agent, req, at):
        if path in holder and holder[path][0] == agent:
            del holder[path]
            out.append((path, req, agent, "released", at, None))

    asked_req = {}
    times = sorted({e[5] for e in events} | {e[5] + e[4] for e in events if e[3] == "request"} | {e[5] + timeout + 1 for e in events if e[3] in ("register", "beat")})
    for at in times:
        for path in [p for p, (_, end) in holder.items() if end <= at]:
            agent, end = holder.pop(path)
            out.append((path, None, agent, "expired", end, end))
        for agent, path, req, kind, ttl, _ in sorted((e for e in events if e[5] == at), key=lambda e: (e[2] is None, e[2] or 0)):
            if kind == "register":
                state[agent], seen[agent] = "active", at
            elif state.get(agent) in (None, "departed"):
                if kind == "request":
                    out.append((path, req, agent, "refused", at, None))
            elif kind == "beat":
                state[agent], seen[agent] = "active", at
            elif kind == "request":
                asked.setdefault(agent, {})[path] = True
                asked_req[agent, path] = req
                if path in holder and holder[path][0] != agent:
                    out.append((path, req, agent, "refused", at, None))
                else:
                    holder[path] = (agent, at + ttl)
                    out.append((path, req, agent, "granted", at, at + ttl))
            elif kind == "release":
                free(path, agent, req, at)
            elif kind == "depart":
                state[agent] = "departed"
                let_go(agent, at)
        for agent in [a for a in state if state[a] == "active" and at - seen[a] > timeout]:
            state[agent] = "crashed"
            let_go(agent, at)
    return out


def decided(spark, folder, batches, timeout):
    for i, rows in enumerate(batches):
        made = [(a, p, r, k, t, moment(at)) for a, p, r, k, t, at in rows]
        spark.createDataFrame(made, agents.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(agents.EVENT).parquet(f"{folder}/in").withWatermark("at", "0 seconds")
        query = (
            agents.lease_book(source, timeout).writeStream.format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return sorted(((*r[:4], r[4] - BASE, None if r[5] is None else r[5] - BASE) for r in spark.read.parquet(f"{folder}/out").collect()), key=repr)


def test_replays_in_other_batches_decide_alike(spark, tmp_path):
    rng = random.Random(5)
    events, at = [(a, None, None, "register", None, a) for a in (1, 2, 3)], 10
    for req in range(1, 60):
        at += rng.choice([0, 3, 40, 200])
        agent, path = rng.randrange(1, 5), rng.choice("ab")
        kind = rng.choice(["request"] * 5 + ["beat", "release", "depart" if req > 50 else "beat"])
        events.append((agent, None if kind in ("beat", "depart") else path, req, kind, 100 if kind == "request" else None, at))
    # Two rows of one time that share a key fall into different orders; req decides.
    end = [(9, None, None, "register", None, at + 100_000), (9, None, None, "beat", None, at + 200_000)]
    want = sorted(brute(events, 700), key=repr)
    assert {w[3] for w in want} == {"granted", "refused", "released", "expired"}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        whole = decided(spark, str(tmp_path / "one"), [events, end], 700)
        cut = next(i for i in range(len(events) // 2, len(events)) if events[i][5] > events[i - 1][5])
        split = decided(spark, str(tmp_path / "two"), [events[:cut][::-1], events[cut:], end], 700)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert whole == want
    assert split == want
