from pyspark.sql import functions as F

from driftline.operators import learning, outages, validity
from driftline.plans import catalogue


def test_baselines_beat_the_mean(spark, sf_dir):
    ev = catalogue.events(spark, sf_dir).withColumn("valid", F.lit(True))
    runs = validity.islands(ev, "trip", "i", "valid")
    w = validity.sliding_windows(runs, "trip", "i", F.array("value", F.col("k").cast("double")), 8, 1)
    w = w.withColumn("label", F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]) / 8 + F.element_at("window", -1)[1])
    w = learning.window_features(w, 2).cache()
    for model in (learning.ridge_baseline(w, "label", 0.1), learning.boosted_baseline(w, "label", rounds=3)):
        m = outages.error_metrics(model.transform(w), "predicted", "label", []).first()
        assert m.mae < m.mae_of_mean


def test_configurations_need_maps(spark):
    trips, maps = spark.createDataFrame([("a",), ("b",)], "trip string"), spark.createDataFrame([("a",)], "trip string")
    got = {(r.trip, r.config) for r in learning.configurations(spark, trips, maps).collect()}
    assert ("a", "ekf_ai_map") in got and ("b", "ekf_ai_map") not in got and ("b", "ekf_only") in got and len(got) == 6


def test_distance_errors_and_sampling(spark):
    frames = spark.createDataFrame([("a", i, 10.0) for i in range(50)], "trip string, i long, speed double")
    out = spark.createDataFrame([("a", 10, 20)], "trip string, start long, end long")
    r = learning.distance_errors(frames, out, "trip", "i", 0.1, lambda d: d.withColumn("predicted", F.lit(9.0))).first()
    assert r.distance_m == 10.0 and abs(r.error_pct - 10) < 1e-9
    ages = spark.range(2000).select(learning.sampled_reference_age(120.0, 0.2, 3, "id").alias("x")).agg(F.avg("x").alias("m"), F.count("x").alias("n")).first()
    assert 55 < ages.m < 65 and 1500 < ages.n < 1700
    kept = learning.repeat_dropout(frames.withColumn("speed", F.col("i") * 1.0), "trip", "i", "speed", 0.5, 1)
    assert 0 < kept.where("speed = i - 1").count() < 50
    assert learning.split_report(frames.withColumn("split", F.lit("train")), "split", "speed").first().windows == 50


def test_normalised_and_transposed(spark):
    from driftline.functions import motion

    a = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    row = spark.range(1).select(motion.transpose(a, 2).alias("t"), motion.normalise(a[1], F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0))).alias("n")).first()
    assert row.t == [[1.0, 3.0], [2.0, 4.0]] and row.n == [1.0, 1.0]


def test_batches_of_windows_are_predicted(spark):
    def load():
        def model(x, s):
            assert x.dtype == "float32" and x.shape[1:] == (2, 3)
            return x[:, 0].sum(axis=1) + s[:, 0], x[:, 1, -1:], s[:, 1] * 0

        return model

    df = spark.createDataFrame([(k, [[k * 1.0, 0.0], [1.0, 0.0], [1.0, k * 0.5]], [10.0, 0.0, 1.0]) for k in range(20)] + [(20, None, [0.0, 0.0, 0.0])], "k int, x array<array<double>>, s array<double>")
    got = learning.predict_speeds(df, load).orderBy("k").collect()
    assert [r.predicted for r in got] == [*[k + 12.0 for k in range(20)], None]
    assert all(abs(r.variance - 2.718281828 ** (r.k * 0.5)) < 1e-3 * r.variance and r.p_stationary == 0.5 for r in got[:20])
