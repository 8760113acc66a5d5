import random

from foliant.streaming import state as S


def test_token_bucket():
    b = S.TokenBucket(1.0, 2.0)
    assert [b.consume(t) for t in (0, 0, 0, 0.5, 1.0, 10, 10, 10)] == [True, True, False, False, True, True, True, False]
    d = S.DualLimiter(S.TokenBucket(1, 1), S.TokenBucket(10, 10))
    assert [d.consume(t, a) for t, a in ((0, 11), (0, 10), (0.5, 1), (1, 10), (3, 10))] == [False, True, False, True, True]


def test_breaker_transitions():
    b = S.CircuitBreaker(2, 10, 2)
    b.record(True, 0)
    for t in (1, 2):
        b.record(False, t)
    assert b.state == "OPEN" and not b.allows(11.9) and b.allows(12) and b.state == "HALF_OPEN"
    b.record(True, 13)
    assert b.state == "CLOSED"  # successes count over all time
    b.record(False, 14)
    b.record(True, 15)
    assert b.failures == 0


def test_half_open_failure_opens_again():
    b = S.CircuitBreaker(1, 10, 3)
    b.record(False, 0)
    assert b.allows(10)
    b.record(False, 11)
    assert b.state == "OPEN" and not b.allows(20)


def test_key_health():
    k = S.KeyHealth(limit=3)
    for _ in range(9):
        k.record("other", 0)
    k.record("success", 0)
    assert k.active and k.errors == 0
    for _ in range(10):
        k.record("other", 0)
    assert not k.active
    k = S.KeyHealth()
    k.record("rate_limit", 100)
    assert not k.available(159) and k.available(160)
    k.record("daily_quota", 100)
    assert not k.available(86399)
    k.record("invalid_key", 0)
    assert not k.active


def test_carry_buffer():
    held: list[str] = []
    assert S.carry(held, ["a", "b"]) == ["a", "b"] and S.carry(held, []) == ["a", "b"]
    S.carry(held, [str(k) for k in range(12)])
    assert held == [str(k) for k in range(2, 12)]


def _sum(s, row):
    s[0] += row["v"]
    return row["k"], row["o"], s[0]


def test_ordered_fold_keeps_keys_apart(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(5) if rnd.random() < 0.6 else 9, o, rnd.randrange(10)) for o in range(3000)]
    want, sums = [], {}
    for k, o, v in rows:
        sums[k] = sums.get(k, 0) + v
        want.append((k, o, sums[k]))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint")
    got = [tuple(r) for r in S.ordered_fold(df, "k", ["o"], lambda: [0], _sum, "k bigint, o bigint, s bigint").collect()]
    assert sorted(got) == sorted(want)


def test_streams(spark, tmp_path):
    from foliant.streaming.streams import limited, windowed

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "value", "user_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("w").count() == windowed(events, "1 day").count()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([(1, 0.0), (1, 0.1), (1, 5.0), (2, 0.0)], "key bigint, at double")
    rows.coalesce(1).write.parquet(str(tmp_path / "r"))
    q = limited(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r")), 1.0, 1.0).writeStream.outputMode("append").format("memory").queryName("l").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {(r.key, r["at"], r.allowed) for r in spark.table("l").collect()} == {(1, 0.0, True), (1, 0.1, False), (1, 5.0, True), (2, 0.0, True)}


def test_periodic_flush_and_a_clock_set_back():
    from foliant.streaming.state import PeriodicFlush

    b = PeriodicFlush(3, 100)
    assert [b.add(t) for t in (0, 10, 20, 30, 130, 50, 60, 61, 400)] == [0, 0, 3, 0, 2, 0, 0, 3, 1]
