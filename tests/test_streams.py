"""State that ends by timers, stores that are filled once, and erasure under readers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talentlake.session import new_path, ship
from talentlake.sources import store as store_module
from talentlake.sources.store import Store
from talentlake.streaming import sinks, state, timers
from talentlake.streaming.replay import replayed

HOUR = 3600
#: The time that the tests count from; Spark takes rows of the epoch itself as late.
BASE = 1_700_000_000


def jobs(spark, rows):
    return spark.createDataFrame(rows, "token string, status string, s long, seq long").withColumn("at", F.timestamp_seconds(F.col("s") + BASE))


def sink(spark, rows, build, spans=3):
    """Rows that a stream over a table puts out, and the rows of state that it keeps at the end."""
    out, kept = new_path(spark, "out"), []

    def start(stream, checkpoint):
        run = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        kept.append(sum(op["numRowsTotal"] for op in run.lastProgress["stateOperators"]))
        return run

    replayed(rows, "at", start, spans)
    return [tuple(r) for r in spark.read.parquet(out).collect()], kept[-1]


LIVES = [
    ("a", "CREATED", 0, 1), ("a", "IN_QUEUE", 2 * HOUR, 2), ("a", "IN_QUEUE", 5 * HOUR, 3),  # exactly 3 h later: stands
    ("a", "COMPLETED", 6 * HOUR, 4), ("a", "FAILED", 7 * HOUR, 5), ("a", "COMPLETED", 30 * HOUR, 6),  # after a final state: no change
    ("a", "CREATED", 30 * HOUR + 1, 7),  # a new life
    ("b", "CREATED", 1 * HOUR, 8), (None, "CREATED", 1 * HOUR, 9), ("c", "FAILED", 2 * HOUR, 10), ("d", "CREATED", 47 * HOUR, 11), ("e", "IN_QUEUE", 47 * HOUR, 12),
    ("e", "IN_QUEUE", 47 * HOUR, 12), ("z", "CREATED", 49 * HOUR, 13),
]


@pytest.mark.parametrize("spans", [1, 3])
def test_job_lives_do_not_depend_on_batches(spark, spans):
    ship(spark)
    timers.timed(spark)
    got, kept = sink(spark, jobs(spark, LIVES), lambda s: timers.job_lives_stream(s, "token", "status", "at", "seq"), spans)
    seconds = lambda x: int(x.timestamp()) - BASE
    at = {(r[0], seconds(r[2])): (r[1], seconds(r[3]), seconds(r[4]), r[5]) for r in got}
    assert at == {
        ("a", 0): ("COMPLETED", 6 * HOUR, 30 * HOUR, 6), ("a", 30 * HOUR + 1): ("CREATED", 30 * HOUR + 1, 33 * HOUR + 1, 1),
        ("b", HOUR): ("CREATED", HOUR, 4 * HOUR, 1), ("c", 2 * HOUR): ("FAILED", 2 * HOUR, 26 * HOUR, 1),
    }
    assert len(got) == 4 and kept == 3  # d, e and z stand: nothing else is kept


def test_timers_expire_what_cleanup_does(spark):
    ship(spark)
    timers.timed(spark)
    rows = [(f"t{i}", ("COMPLETED", "IN_QUEUE", "FAILED", "CREATED")[i % 4], i * 1700, i) for i in range(80)]
    got, _ = sink(spark, jobs(spark, rows), lambda s: timers.job_lives_stream(s, "token", "status", "at", "seq"), 2)
    gone = state.expired(jobs(spark, rows), F.timestamp_seconds(F.lit(BASE + 79 * 1700)), "at").collect()
    assert sorted(r[0] for r in got) == sorted(r["token"] for r in gone) and 0 < len(got) < 80


def test_changes_end_with_expiry(spark):
    ship(spark)
    timers.timed(spark)
    got, _ = sink(spark, jobs(spark, LIVES), lambda s: timers.job_states_stream(s, "token", "status", "at", "seq"), 3)
    of_a = [s for t, s, _ in sorted(got, key=lambda r: (r[2], r[1] != "EXPIRED")) if t == "a"]
    assert of_a == ["CREATED", "IN_QUEUE", "COMPLETED", "EXPIRED", "CREATED", "EXPIRED"]


def test_request_logs_go_when_their_window_has_passed(spark):
    ship(spark)
    timers.timed(spark)
    rows = [(f"u{i % 7}", BASE + i, i) for i in range(50)] + [("last", BASE + 10_000, 99)]
    frame = spark.createDataFrame(rows, "who string, epoch long, n long").withColumn("at", F.timestamp_seconds("epoch"))
    got, kept = sink(spark, frame, lambda s: timers.limited_stream(s.drop("at"), "who", "epoch", "n", 2, 100), 2)
    want = {r["n"]: r["allowed"] for r in state.limited(frame.drop("at"), "who", "epoch", "n", 2, 100).collect()}
    assert {r[2]: r[3] for r in got} == want and kept <= 2  # the last client's log and its timer


# -- stores -----------------------------------------------------------------------------------------------------------

FINISHED = "token string, status string, research_consent boolean, at long, batch_id long"


def finished(spark, rows):
    return spark.createDataFrame(rows, "token string, status string, research_consent boolean, at long")


def stores(spark):
    root = new_path(spark, "stores")
    return [Store(spark, f"{root}/{n}", FINISHED) for n in ("results", "opted_in")]


def tokens(store):
    return sorted(r["token"] for r in store.read().collect())


def test_a_batch_is_stored_once(spark):
    results, opted_in = stores(spark)
    run = sinks.finalizer(results, opted_in)
    first = finished(spark, [("a", "COMPLETED", True, 1), ("a", "COMPLETED", True, 2), ("b", "COMPLETED", False, 1), ("c", "FAILED", True, 1), ("d", "IN_QUEUE", True, 1), (None, "FAILED", True, 1)])
    for _ in range(2):
        run(first, 0)
    assert tokens(results) == ["a", "b", "c"] and tokens(opted_in) == ["a"]
    run(finished(spark, [("a", "FAILED", True, 9), ("e", "COMPLETED", True, 9)]), 1)  # poll and webhook report once more
    assert tokens(results) == ["a", "b", "c", "e"] and tokens(opted_in) == ["a", "e"]
    assert {r["token"]: r["at"] for r in results.read().collect()} == {"a": 1, "b": 1, "c": 1, "e": 9}


def test_a_failure_between_the_sinks(spark, monkeypatch):
    results, opted_in = stores(spark)
    batch = finished(spark, [("a", "COMPLETED", True, 1), ("b", "COMPLETED", True, 1)])
    real = opted_in.append
    monkeypatch.setattr(opted_in, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.finalizer(results, opted_in)(batch, 0)
    assert tokens(results) == ["a", "b"] and tokens(opted_in) == []
    monkeypatch.setattr(opted_in, "append", real)
    sinks.finalizer(results, opted_in)(batch, 0)
    sinks.finalizer(results, opted_in)(batch, 0)
    assert tokens(results) == tokens(opted_in) == ["a", "b"]


def test_a_failure_before_a_version_is_made(spark, monkeypatch):
    """Parts of a version that was never published are seen by nobody and are cleared away."""
    results, opted_in = stores(spark)
    batch = finished(spark, [("a", "COMPLETED", True, 1)])
    with monkeypatch.context() as m:
        m.setattr(results, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.finalizer(results, opted_in)(batch, 0)
    assert tokens(results) == []
    sinks.finalizer(results, opted_in)(batch, 0)
    results.vacuum()
    assert tokens(results) == ["a"] and results._fs.listStatus(results._path(f"{results.root}/data")).__len__() == 1


def test_erasure_under_a_reader(spark):
    store = Store(spark, new_path(spark, "erasure"), "id long, withdrawal_hash string")
    rows = spark.range(30).select("id", F.sha2(F.col("id").cast("string"), 256).alias("withdrawal_hash"))
    for lo in (0, 10, 20):
        store.append(rows.where((F.col("id") >= lo) & (F.col("id") < lo + 10)))
    held, parts = store.read(), store.manifest()["parts"]
    run = sinks.eraser(store)
    for _ in range(2):
        run(spark.createDataFrame([(" 12 ",), ("15",), ("15",), ("none",), (None,)], "code string"), 0)
    assert held.count() == 30 and store.read().count() == 28 and store.read().where("id in (12, 15)").count() == 0
    now = store.manifest()
    assert [p for p in parts if p in now["parts"]] == [parts[0], parts[2]]  # other parts are not written anew
    assert now["version"] == 4
    store.vacuum()
    assert store.versions() == [4] and store.read().count() == 28
    store.erase(rows.select("withdrawal_hash"), "withdrawal_hash")
    assert store.read().count() == 0 and store.read().columns == ["id", "withdrawal_hash"]


def test_many_keys_are_not_sent_to_the_driver(spark, monkeypatch):
    seen, joined = [], type(spark.range(1)).join

    def join(self, *args, **kind):
        out = joined(self, *args, **kind)
        seen.append("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(spark.range(1)), "join", join)
    for few, broadcast in ((5, False), (10_000, True)):
        monkeypatch.setattr(store_module, "FEW", few)
        store, seen[:] = Store(spark, new_path(spark, "keys"), "id long"), []
        store.append(spark.range(100))
        store.erase(spark.range(0, 100, 2), "id")
        assert seen == [broadcast] * 2 and sorted(r[0] for r in store.read().collect()) == list(range(1, 100, 2))
    monkeypatch.undo()


def test_writers_at_once(spark, monkeypatch):
    """A writer that another one forestalls looks again and loses nothing."""
    root = new_path(spark, "race")
    one, other = (Store(spark, root, "id long") for _ in range(2))
    one.append(spark.range(3))
    real, late = one._publish, []

    def publish(manifest):
        if not late:
            late.append(other.erase(spark.range(2), "id"))
        return real(manifest)

    monkeypatch.setattr(one, "_publish", publish)
    one.append(spark.range(10, 12))
    assert sorted(r[0] for r in one.read().collect()) == [2, 10, 11] and one.versions() == [1, 2, 3]
    assert sorted(r[0] for r in other.read(1).collect()) == [0, 1, 2]
    one.compact()
    assert len(one.manifest()["parts"]) == 1 and other.read().count() == 3


def test_lives_of_a_call_are_one_frame():
    """However many jobs of a token end in a call, its rows travel in one batch, in order; so do changes of state."""

    class Job:
        now = None
        get = lambda self: self.now
        exists = lambda self: self.now is not None
        update = lambda self, job: setattr(self, "now", job)

    class Handle:
        registerTimer = deleteTimer = lambda self, at: None

    hour = 3_600_000_000
    times = [0, 10 * hour, 10 * hour, 40 * hour, 50 * hour]
    rows = [pd.DataFrame({"s": ["IN_QUEUE", "FAILED", "IN_PROGRESS", "IN_QUEUE", "IN_QUEUE"], "t": times, "o": [1, 3, 2, 4, 5]}).iloc[part] for part in ([4, 1], [2, 0, 3])]
    for changes in (False, True):
        lives = timers._Lives("token", "s", "t", "o", (3, 24), changes)
        lives.handle, lives.job = Handle(), Job()
        (frame,) = lives.handleInputRows((7,), iter(rows), None)
        got = frame.values.tolist()
        if changes:
            assert got == [[7, s, at * hour] for s, at in (("IN_QUEUE", 0), ("EXPIRED", 3), ("IN_PROGRESS", 10), ("FAILED", 10), ("EXPIRED", 34), ("IN_QUEUE", 40), ("EXPIRED", 43), ("IN_QUEUE", 50))]
        else:
            assert got == [[7, "IN_QUEUE", 0, 0, 3 * hour, 1], [7, "FAILED", 10 * hour, 10 * hour, 34 * hour, 2], [7, "IN_QUEUE", 40 * hour, 40 * hour, 43 * hour, 1]]
        assert lives.job.now == ("IN_QUEUE", 50 * hour, 50 * hour, 1)
