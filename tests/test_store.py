"""The bucketed store by its files and plans, and the stateful stream against a fold over all answers."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sievelake.operators import bucketed, evidence
from sievelake.streaming import store as S

SCHEMA = "entity string, field string, source string, query_key string, state string, value string, seen_at timestamp"
T0 = datetime(2024, 1, 1)


def row(e, f, v, t, state="FOUND"):
    return (e, f, "s", "q", state, v, T0 + timedelta(seconds=t))


def files_of(path, versions):
    return {os.path.relpath(os.path.join(d, n), path): os.stat(os.path.join(d, n)).st_mtime_ns for v in versions for d, _, ns in os.walk(f"{path}/data/v={v}") for n in ns if n.endswith(".parquet")}


def told(df):
    return sorted(tuple(r[c] for c in (*evidence.KEY, "state", "value", "first_seen", "seen_at")) for r in df.collect())


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    st = bucketed.Store(spark, path, buckets=16)
    rows = [row(f"e{e}", f"f{f}", "v", 0) for e in range(100) for f in range(20)]
    assert st.upsert(spark.createDataFrame(rows, SCHEMA)) == 1
    before = files_of(path, [1])
    batch = [row("e7", f"f{f}", "v" if f % 2 else "w", 5) for f in range(20)]  # 1 % of the rows, of one entity
    assert st.upsert(spark.createDataFrame(batch, SCHEMA)) == 2
    m = st.manifest()
    assert len(m["touched"]) == 1 and m["buckets"][str(m["touched"][0])] == 2 and sum(v == 2 for v in m["buckets"].values()) == 1
    assert files_of(path, [1]) == before  # nothing old is rewritten
    assert {n.split("/")[2] for n in files_of(path, [2])} == {f"b={m['touched'][0]}"}
    read = {p.split("/data/")[1].rsplit("/", 1)[0] for p in st.of(spark.createDataFrame(batch, SCHEMA).select("entity")).inputFiles()}
    assert read == {f"v=2/b={m['touched'][0]}"}
    # The same as the batch operator.
    want = evidence.upsert(evidence.upsert(spark.createDataFrame([], SCHEMA).withColumn("first_seen", F.col("seen_at")), spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(batch, SCHEMA))
    assert told(st.current()) == told(want)
    assert told(st.current(1)) == told(want.limit(0).unionByName(spark.createDataFrame(rows, SCHEMA).withColumn("first_seen", F.col("seen_at"))))


def test_upserts_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(3)
    st = bucketed.Store(spark, str(tmp_path / "store"), buckets=5)
    want = spark.createDataFrame([], SCHEMA).withColumn("first_seen", F.col("seen_at"))
    for n in range(3):
        keys = {(rng.choice(["a", "b", "é", None, "hot", "hot", "hot"]), f"f{rng.randrange(12)}") for _ in range(40)}
        batch = spark.createDataFrame([row(e, f, rng.choice(["x", "y", None]), n, "NO_MATCH" if rng.random() < 0.2 else "AMBIGUOUS") for e, f in keys if e], SCHEMA)
        st.upsert(batch)
        want = spark.createDataFrame(evidence.upsert(want, batch).select(want.columns).collect(), want.schema)
    assert told(st.current()) == told(want)
    assert st.upsert(spark.createDataFrame([], SCHEMA)) == 3  # nothing new, no version


def test_failed_and_concurrent_upserts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    st = bucketed.Store(spark, path, buckets=4)
    st.upsert(spark.createDataFrame([row("a", "f", "v", 0)], SCHEMA))
    old = told(st.current())
    with pytest.raises(Exception, match="unknown state"):
        st.upsert(spark.createDataFrame([row("a", "f", "v", 1, "BOGUS")], SCHEMA))
    broken = spark.createDataFrame([row("a", "f", "z", 1)], SCHEMA)
    monkeypatch.setattr(bucketed.Files, "put", lambda *a: (_ for _ in ()).throw(OSError("the driver died here")))
    with pytest.raises(OSError):
        st.upsert(broken)
    monkeypatch.undo()
    assert told(st.current()) == old and st.versions() == [1]
    assert st.upsert(broken) == 3 and told(st.current())[0][5] == "z"  # version 2 is left behind
    monkeypatch.setattr(bucketed.Files, "claim", lambda *a: False)
    with pytest.raises(RuntimeError, match="another job"):
        st.upsert(broken)
    monkeypatch.undo()
    assert told(st.current(1)) == old
    assert st.vacuum(keep=1) == [1, 2] and st.versions() == [3] and told(st.current())[0][5] == "z"
    with pytest.raises(ValueError, match="no version"):
        st.current(1)


def test_clustered_tables_join_without_shuffle(spark, tmp_path):
    made = []
    for n in ("left", "right"):
        st = bucketed.Store(spark, str(tmp_path / n), buckets=8)
        st.upsert(spark.createDataFrame([row(f"e{e}", "f", n, 0) for e in range(200)], SCHEMA))
        made.append(st.clustered(f"clustered_{n}_{int(time.time() * 1000)}"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    both = made[0].join(made[1], evidence.KEY)
    plan = both._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Join" in plan and "Exchange" not in plan and both.count() == 200


def fold(rows):
    """Latest answer and first_seen of each key from all rows: of equal times the largest value, then state."""
    by = {}
    for e, f, s, q, state, v, t in rows:
        if state not in evidence.STATES or state == "FOUND" and not v or t is None:
            continue
        key = (e, f, s, q)
        at = by.setdefault(key, {})
        at[t] = max(at.get(t, (False, "", "", None)), (v is not None, v or "", state, v), key=lambda x: x[:3])
    out = []
    for key, at in by.items():
        seq = sorted(at.items())
        first = seq[-1][0]
        for t, x in reversed(seq):
            if x[3] != seq[-1][1][3]:
                break
            first = t
        out.append((*key, seq[-1][1][2], seq[-1][1][3], first, seq[-1][0]))
    return sorted(out, key=repr)


def test_stream_in_any_order_equals_the_fold(spark, tmp_path):
    """Answers out of order, repeated, over several batches and a restart; refused rows go to a table, and run-out answers are told."""
    rng = random.Random(9)
    rows = [row(f"e{rng.randrange(4)}", f"f{rng.randrange(3)}", rng.choice(["x", "y", None]), rng.randrange(30), rng.choice(["AMBIGUOUS", "NOT_APPLICABLE", "FOUND", "NO_MATCH", "BOGUS"])) for _ in range(240)]
    rows += rows[:40]
    src, out, cp = (str(tmp_path / n) for n in ("in", "store", "cp"))
    for n in range(4):
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run = lambda: S.run_available(spark, src, SCHEMA, out, cp, files_per_batch=2, buckets=4)
    run()
    assert sorted(told(S.current(spark, out)), key=repr) == fold(rows[:200])
    spark.createDataFrame(rows[200:], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()  # a restart: state and sources go on
    got = S.current(spark, out)
    assert sorted(told(got), key=repr) == fold(rows)
    bad = spark.read.parquet(f"{out}/refused").groupBy("why").count().collect()
    assert {r["why"]: r["count"] for r in bad} == {"unknown state: BOGUS": sum(r[4] == "BOGUS" for r in rows), "FOUND needs a value": sum(r[4] == "FOUND" and not r[5] for r in rows)}
    # These answers are years old: those of states with a time to live have run out, the others never do.
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([("new", "f", "s", "q", "NO_MATCH", None, now), ("late", "f", "s", "q", "FOUND", "v", T0)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    over = {(r.entity, r.field): (r.state, r.expired) for r in S.current(spark, out).collect()}
    assert over["new", "f"] == ("NO_MATCH", False) and over["late", "f"] == ("FOUND", False)
    assert all(x == (evidence.TTL_SECONDS[s] is not None) for (e, _), (s, x) in over.items() if e not in ("new", "late"))


def test_state_forgets_old_repeats():
    class Values:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    class Handle:
        def getValueState(self, *a):
            return Values()

        listTimers = lambda self: []
        registerTimer = deleteTimer = lambda self, t: None

    import pandas as pd

    class Clock:
        getCurrentProcessingTimeInMs = lambda self: 0

    p = S.Latest()
    p.init(Handle())
    day = 86400 * 10**6
    for d in range(400):
        out = list(p.handleInputRows(("e", "f", "s", "q"), iter([pd.DataFrame({"seen_us": [d * day], "state": ["FOUND"], "value": ["v" if d < 300 else "w"]})]), Clock()))
    assert len(p._rows()) < 100 and out[0]["first_seen"][0] == pd.Timestamp(300 * day, unit="us")
