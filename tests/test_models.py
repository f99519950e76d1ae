"""How often model jobs read and shuffle their rows."""

from pyspark.sql import functions as F

from foldwright.operators import models as J


def test_probe_moves_all_contexts_in_one_shuffle(spark, monkeypatch):
    key = F.col("id")
    rows = spark.range(240).select(
        key.alias("row"), (key % 17).cast("double").alias("signal"), (key / 240).alias("time"), (key % 3).alias("missing_count"), (key % 3).alias("missing_pattern"),
        (key % 2).alias("route"), (key % 11).alias("unit"), (key % 7).cast("double").alias("held_out"), (key % 5 < 2).cast("int").alias("target"),
    )
    plain, calls, contexts = J.context_shuffle, [], []

    def counted(df, *rest):
        calls.append(rest)
        return plain(df, *rest)

    monkeypatch.setattr(J, "context_shuffle", counted)
    fit = J.fit_predict
    monkeypatch.setattr(J, "fit_predict", lambda train, *rest: contexts.append(train) or fit(train, *rest))
    train = rows.filter("time < 0.6")
    made = J.operator_feature_probe(train, rows.filter("time >= 0.6"), "row", 3, ("conditional_routing", "observation_regime"))
    assert made.count() == 2 and len(calls) == 1
    # The null of routing is fitted on the route that a shuffle of it alone gives.
    alone = plain(train, "row", "route", 3).select(F.sum(F.col("route") * F.col("signal"))).first()[0]
    assert contexts[2].select(F.sum("routed")).first()[0] == alone


def test_crossfit_builds_a_representation_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        seen.add(1)
        return float(x)

    rows = spark.range(120).select("id", (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 13).alias("x")).filter("y < 2")
    folds = rows.select("id", F.lit(0).alias("fold"), F.when(F.col("id") < 60, J.TRAIN).otherwise(J.VALIDATION).alias("role"))
    build = lambda a, b: (a.withColumn("f", costly("x")), b.withColumn("f", costly("x")), ["f"])
    made = J.crossfit_oof(rows, folds, "id", "y", {"r": build}, {"one": J.logistic, "two": J.logistic}, (0,))
    assert made.count() == 2 * rows.filter("id >= 60").count()
    assert seen.value == rows.count()
