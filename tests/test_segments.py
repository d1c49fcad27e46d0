"""Segmented calculations equal plain windows, whatever the data and partitioning."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperfold.plans import segments as sg


def frame(spark, seed, n=400):
    rnd = random.Random(seed)
    rows, used = [], set()
    while len(rows) < n:
        # one key holds most rows; another is null
        key = rnd.choice(["hot"] * 6 + ["a", "b", None])
        pos = rnd.randrange(3000)
        if (key, pos) in used:
            continue
        used.add((key, pos))
        rows.append((key, pos, rnd.choice([None, 1, 5, 9]), rnd.randrange(50)))
    return spark.createDataFrame(rows, "k string, pos int, v int, w int")


def test_segmented_equals_window(spark):
    for seed in range(3):
        df = frame(spark, seed)
        w = Window.partitionBy("k").orderBy("pos")
        before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
        plain = df.select(
            "k", "pos", F.row_number().over(w).cast("bigint").alias("rn"),
            F.coalesce(F.sum("w").over(before), F.lit(0)).alias("s"), F.max("v").over(before).alias("m"),
            F.last("v", ignorenulls=True).over(upto).alias("c"), F.lead("v").over(w).alias("l"),
            F.count("*").over(Window.partitionBy("k")).alias("t"))
        calcs = [sg.row_number("rn"), sg.prefix_sum(F.col("w"), "s"), sg.prefix_max(F.col("v"), "m"),
                 sg.carry(F.col("v"), "c"), sg.lead(F.col("v"), "l"), sg.total("t"), sg.total("u", F.col("w"))]
        plain = plain.join(df.groupBy("k").agg(F.sum("w").alias("u")).withColumnRenamed("k", "k2"), F.expr("k <=> k2")).drop("k2")
        want = sorted(map(tuple, plain.collect()), key=str)
        cut = sg.segmented(df.repartition(5), ["k"], ["pos"], [F.floor(F.col("pos") / 64)], calcs)
        for seg in (cut, sg.ranged(df.repartition(5), ["k"], ["pos"], calcs)):
            assert want == sorted(map(tuple, seg.select("k", "pos", "rn", "s", "m", "c", "l", "t", "u").collect()), key=str)


def test_a_hot_key_has_a_summary_row_for_each_range(spark):
    rows = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    rows = rows.where("k < 3000")  # one key holds two thirds of a million rows, a thousand others one each
    before = set(sg_tables(spark))
    out = sg.ranged(rows, ["k"], ["id"], [sg.row_number("rn")])
    assert out.where("k = -1").agg(F.max("rn")).first()[0] == rows.where("k = -1").count()
    (path,) = set(sg_tables(spark)) - before
    summary = spark.read.parquet(path).groupBy("k", sg.RANGE).count()
    assert summary.count() <= rows.select("k").distinct().count() + int(spark.conf.get("spark.sql.shuffle.partitions"))


def sg_tables(spark):
    from paperfold.sources import shared

    return list(shared._made)


def test_numbering_without_key(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("pos"))
    for out in (sg.numbered(df, [], ["pos"], [F.floor(F.col("pos") / 100)], "rn"), sg.numbered_all(df, ["pos"], "rn")):
        assert out.count() == 1000 and out.where(F.col("rn") != F.col("pos") / 3 + 1).count() == 0
