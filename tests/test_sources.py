"""Readers, writers and generators."""

from pyspark.sql import functions as F

from rillway.sources import generate, io


def test_journal_round_trip(spark, tmp_path):
    path = f"{tmp_path}/journal"
    rows = spark.createDataFrame([("task_created", f"T{i}", i) for i in range(20)], "kind string, subject string, at_ms long")
    io.append_journal(io.numbered(rows.limit(20), ["at_ms"]), path)
    first = io.read_journal(spark, path)
    assert io.head(first) == 20 and first.where("trace_id = '' and origin = ''").count() == 20
    io.append_journal(io.numbered(rows, ["at_ms"], head=20), path)
    both = io.read_journal(spark, path)
    assert [r.seq for r in both.orderBy("seq").collect()] == list(range(1, 41))
    assert io.between(both, 5, 8).count() == 3
    assert io.head(io.read_journal(spark, path).limit(0)) == 0


def test_replay_by_key(spark):
    from rillway.functions.scalars import partition_for_key

    log = spark.range(200).select(F.col("id").alias("offset"), F.concat(F.lit("k"), F.col("id") % 9).alias("key")).withColumn("partition", partition_for_key(F.col("key")))
    assert io.replay_log(log, 10, 50, ["k1", "k4"]).count() == sum(i % 9 in (1, 4) for i in range(10, 51))


def test_documents(spark, tmp_path):
    log = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "a", 3)], "scenario string, kind string, seq long")
    io.write_event_samples(log, f"{tmp_path}/samples")
    got = spark.read.json(f"{tmp_path}/samples").first()
    assert got.journal_head == 3 and got.kinds.a == 2
    text = io.metrics_document({"kinds": log.groupBy("kind").count()})
    assert text == io.metrics_document({"kinds": log.repartition(7).groupBy("kind").count()})
    assert io.document_digest("a\r\nb\n") == io.document_digest("a\nb\n")
    alerts = spark.createDataFrame([("r", "ERROR", "x", 1.0, 0.0, 5, "m")], "rule string, severity string, subject string, value double, threshold double, at_ms long, message string")
    io.write_alerts(alerts, f"{tmp_path}/alerts")
    assert spark.read.option("header", True).csv(f"{tmp_path}/alerts").columns == ["rule", "severity", "subject", "value", "threshold", "at_ms", "message"]


def test_generators(spark):
    t = generate.tasks(spark, 2000, seed=7)
    assert t.where("origin_hub = destination_hub").count() == 0 and t.exceptAll(generate.tasks(spark, 2000, seed=7).repartition(9)).count() == 0
    share = {r.priority: r["count"] / 2000 for r in t.groupBy("priority").count().collect()}
    assert abs(share[2] - 0.45) < 0.05 and set(share) == {1, 2, 3, 4, 5}
    f = generate.fleet(spark, 8).orderBy("vehicle_id").collect()
    assert f[6].x == 72.0 and f[7].battery == 94.0 and f[0].vehicle_id == "AGV-01"
    log = spark.range(1000).select(F.col("id").alias("offset"), F.concat(F.lit("m"), "id").alias("msg_id"))
    n = generate.perturbed(log, 3, duplicate=0.5, drop=0.2, window=3).count()
    assert 1100 < n < 1300
    assert generate.scenarios(spark).count() == 6


def test_fleet_and_deadlines(spark):
    """Each lap stands 12 metres further out both ways; a deadline allows for every road on the way."""
    from rillway.sources import generate as g

    got = {r.vehicle_id: (r.x, r.y) for r in g.fleet(spark, 13).collect()}
    assert got["AGV-01"] == (60.0, 60.0) and got["AGV-07"] == (72.0, 72.0) and got["AGV-13"] == (84.0, 84.0)
    hops = {(a, b): n for a, b, n in g._hops()}
    assert hops["A", "B"] == 1 and hops["A", "F"] == 3 and hops["A", "E"] == 2 and len(hops) == 30
    for r in g.tasks(spark, 300, 5).collect():
        allowance = 120_000 + 90_000 * hops[r.origin_hub, r.destination_hub]
        assert 1.6 * allowance - 1 <= r.deadline_ms - r.created_ms <= 3.2 * allowance
