"""Running sums, ranks, quantiles and samples against brute force, with hot groups."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.operators import prefix as px
from sluice.operators import sampling as sa


def skewed(rows=3000, seed=1):
    """Half of the rows in one group, many ties, a long tail of tiny groups."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        group = "hot" if rng.random() < 0.5 else f"g{rng.randrange(60)}"
        out.append((i, group, round(rng.random() ** 4, 3)))
    return pd.DataFrame(out, columns=["id", "g", "v"])


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_sums_with_a_hot_group(spark, ranges):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    counts = px.value_counts(df, "v", ["g"])
    got = px.running_sums(counts, ["v"], ["n"], ["g"], ranges).toPandas().sort_values(["g", "v"])
    assert (got.cum_n == got.groupby("g").n.cumsum()).all()
    assert (got.total_n == got.groupby("g").n.transform("sum")).all()
    assert got.n.sum() == len(pdf)


def test_running_sums_without_groups(spark):
    counts = px.value_counts(spark.createDataFrame(skewed()), "v")
    got = px.running_sums(counts, ["v"], ["n"]).toPandas().sort_values("v")
    assert (got.cum_n == got.n.cumsum()).all() and (got.total_n == 3000).all()


def test_ranges_split_the_hot_group(spark):
    rows = spark.createDataFrame(skewed(8000)).withColumn("n", F.lit(1))
    sizes = px.with_range(rows, ["g", "v", "id"], ["n"], 16).filter("g = 'hot'").groupBy("_range").count().collect()
    assert len(sizes) >= 5 and max(r["count"] for r in sizes) < 2500


def test_rank_matches_row_number(spark):
    pdf = skewed()
    got = px.ranked(spark.createDataFrame(pdf), ["v", "id"], ["g"], "place").toPandas()
    got = got.sort_values(["g", "v", "id"])
    assert (got.place == got.groupby("g").cumcount() + 1).all()


def test_quantiles_match_numpy(spark):
    pdf = skewed()
    probs = [0.0, 0.01, 0.25, 0.5, 0.995, 1.0]
    rows = px.exact_quantiles(spark.createDataFrame(pdf), "v", probs, ["g"]).collect()
    assert len(rows) == pdf.g.nunique()
    for row in rows:
        values = pdf[pdf.g == row["g"]].v.to_numpy()
        assert row["n"] == len(values)
        assert row["quantiles"] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_quantiles_of_a_constant(spark):
    df = spark.range(50).select(F.lit(0.25).alias("v"))
    row = px.exact_quantiles(df, "v", [0.1, 0.9]).first()
    assert (row["n"], row["quantiles"]) == (50, [0.25, 0.25])


def ids(spark, n=2000):
    return spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("sample_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))


def smallest(names, seed, n):
    return set(sorted(names, key=lambda s: hashlib.sha256(f"{seed}:{s}".encode()).hexdigest())[:n])


@pytest.mark.parametrize("n", [0, 1, 137, 2000, 5000])
def test_hash_sample_is_the_smallest_hashes(spark, n):
    df = ids(spark)
    got = [r["sample_id"] for r in sa.hash_sample(df, n, 7).collect()]
    assert len(got) == min(n, 2000)
    assert set(got) == smallest([f"s{i}" for i in range(2000)], 7, n)


def test_hash_sample_does_not_depend_on_partitioning(spark):
    a = {r[0] for r in sa.hash_sample(ids(spark), 300, 9).select("sample_id").collect()}
    b = {r[0] for r in sa.hash_sample(ids(spark).repartition(7), 300, 9).select("sample_id").collect()}
    assert a == b


def test_hash_sample_per_group_share(spark):
    got = sa.hash_sample(ids(spark), lambda n: F.floor(n * 0.1), 3, ["label"]).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 160, 1: 40}


def test_balanced_sample_tops_up_a_small_class(spark):
    got = sa.balanced_sample(ids(spark), 1000, 5)
    assert got.count() == 1000 and got.select("sample_id").distinct().count() == 1000
    assert got.filter("label = 1").count() == 400


def test_balanced_sample_of_one_class_and_of_everything(spark):
    ones = ids(spark).filter("label = 1")
    assert sa.balanced_sample(ones, 100, 5).count() == 100
    assert sa.balanced_sample(ones, 10_000, 5).count() == 400


def test_mix_replaces_a_share(spark):
    base = ids(spark, 1250)
    foreign = ids(spark, 400).withColumn("sample_id", F.concat(F.lit("f"), "sample_id"))
    mixed = sa.mix_streams(base, foreign, 0.05, 42)
    got = {r["component"]: r["count"] for r in mixed.groupBy("component").count().collect()}
    assert got == {"id": 1188, "ood": 62}  # 62.5 rounds half to even


def test_shuffle_is_a_permutation(spark):
    got = sorted(r["position"] for r in sa.shuffled(ids(spark, 500), 1).select("position").collect())
    assert got == list(range(500))


@pytest.mark.parametrize("n", [2, 1500])
def test_top_per_group_small_and_large(spark, n):
    pdf = skewed()
    order = [F.col("v"), F.col("id")]
    got = sa.top_per_group(spark.createDataFrame(pdf), n, ["g"], order).toPandas()
    want = pdf.sort_values(["g", "v", "id"]).groupby("g").head(n)
    assert sorted(got.id) == sorted(want.id)


def test_drawn_padding_is_shared_or_per_row(spark):
    terms = [f"t{i}" for i in range(20)]
    df = ids(spark, 30)
    shared = df.select(sa.drawn_padding(terms, 5, 1).alias("p")).distinct().collect()
    assert len(shared) == 1 and len(set(shared[0]["p"].split())) == 5
    own = df.select(sa.drawn_padding(terms, 5, 1, "sample_id").alias("p")).distinct().count()
    assert own > 20


@pytest.mark.parametrize("hot", [True, False])
def test_join_with_hot_keys(spark, hot):
    from sluice.session import join_hot

    pdf = skewed() if hot else pd.DataFrame({"id": range(3000), "g": [f"g{i}" for i in range(3000)], "v": 0.0})
    df = spark.createDataFrame(pdf)
    table = pd.DataFrame({"g": ["hot", "g1", "g2", "none"], "w": [1, 2, 3, 4]})
    got = join_hot(df, spark.createDataFrame(table), ["g"]).toPandas().sort_values("id")
    want = pdf.merge(table, on="g", how="left").sort_values("id")
    assert list(got.id) == list(want.id) and got.w.fillna(0).tolist() == want.w.fillna(0).tolist()


def test_join_small_beyond_its_limit(spark, monkeypatch):
    from sluice import session

    df = spark.createDataFrame(skewed())
    table = spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, w int")
    small = sorted(session.join_small(df, table, ["g"]).select("id", "w").collect())
    monkeypatch.setattr(session, "SMALL_BYTES", 1)
    assert sorted(session.join_small(df, table, ["g"]).select("id", "w").collect()) == small


def test_running_sums_keep_rows_of_a_null_group(spark):
    rows = spark.range(2000).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("v"), F.lit(1).cast("long").alias("n"))
    other = spark.range(500).select(F.lit("a").alias("g"), F.col("id").alias("v"), F.lit(1).cast("long").alias("n"))
    got = px.running_sums(rows.unionByName(other), ["v"], ["n"], ["g"])
    found = {r["g"]: (r["most"], r["total"]) for r in got.groupBy("g").agg(F.max("cum_n").alias("most"), F.max("total_n").alias("total")).collect()}
    assert found == {None: (2000, 2000), "a": (500, 500)}
