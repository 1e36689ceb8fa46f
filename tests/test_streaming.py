from pyspark.sql import functions as F

from sheaf.operators import usage
from sheaf.streaming import events


def drain(df, mode="append"):
    name = f"t{abs(hash((id(df), mode))) % 10**9}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_rate_limit_streams_as_in_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 6").select("user_id", "event_id", "ts")
    got = {r.event_id: r.allowed for r in drain(events.limited(stream(spark, e, str(tmp_path / "e")), "user_id", 2, 7200))}
    assert got == {r.event_id: r.allowed for r in usage.admissions(e, "user_id", 2, 7200).collect()} and not all(got.values())


def test_breaker_and_leases(spark, tmp_path):
    calls = spark.createDataFrame([("p", i, s, ok) for i, (s, ok) in enumerate([(0, False), (1, False), (2, True), (40, True), (41, False)])], "k string, event_id int, s int, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s")
    got = {r.event_id: r.state for r in drain(events.breaker(stream(spark, calls, str(tmp_path / "c")), "k", failures=2))}
    assert got == {0: "closed", 1: "closed", 2: "open", 3: "half-open", 4: "closed"}
    log = [(0, "a", "claim"), (5, "b", "claim"), (20, "a", "renew"), (45, "b", "claim"), (60, "b", "claim"), (61, "b", "release"), (62, "a", "claim"), (100, "a", "claim")]
    claims = spark.createDataFrame([("j", w, a, s) for s, w, a in log], "job string, worker string, action string, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s")
    rows = sorted(drain(events.leases(stream(spark, claims, str(tmp_path / "l")), "job")), key=lambda r: r.us)
    assert [r.outcome for r in rows] == ["granted", "refused", "renewed", "refused", "granted", "released", "granted", "failed"]


def in_batches(spark, rows, schema, path):
    """A stream that gets each list of rows as a micro-batch of its own."""
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s")
        df.coalesce(1).write.parquet(f"{path}/{i}")
        for f in (path / str(i)).glob("part-*.parquet"):
            f.rename(path / f"{i:03d}.parquet")
            (path / f"{i:03d}.parquet").touch()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*.parquet")


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return df.sparkSession.table(name).collect(), sizes


def test_idle_keys_leave_the_state_and_late_events_are_dropped(spark, tmp_path):
    hour = 3600
    first = [(k, k, 0) for k in range(50)]
    rows = [first, [(0, 100, 1 * hour), (0, 101, 1 * hour + 1)], [(0, 102, 9 * hour)], [(0, 104, 9 * hour + 60)], [(7, 103, 5), (0, 106, 9 * hour + 120)], [(0, 105, 20 * hour)]]
    got, sizes = drained(events.limited(in_batches(spark, rows, "k long, event_id long, s long", tmp_path), "k", 2, 2 * hour), "limited_idle")
    allowed = {r.event_id: r.allowed for r in got}
    assert 103 not in allowed  # hours behind the watermark
    assert [allowed[i] for i in (0, 100, 101, 102, 104, 106, 105)] == [True, True, False, True, True, False, True] and max(sizes) == 50 and sizes[-1] == 1


def test_a_breaker_without_failures_has_no_state(spark, tmp_path):
    rows = [[(k, k, 0, k % 2 == 0) for k in range(20)], [(1, 100, 5, True), (3, 101, 6, False)], [(3, 102, 7, False)], [(3, 103, 4 * 86_400, True)], [(2, 104, 8 * 86_400, True)]]
    got, sizes = drained(events.breaker(in_batches(spark, rows, "k long, event_id long, s long, ok boolean", tmp_path), "k", failures=3), "breaker_idle")
    state = {r.event_id: r.state for r in got}
    assert state[102] == "closed" and state[103] == "half-open" and state[104] == "closed"
    assert max(sizes) == 10 and sizes[-1] == 0
