"""Plans and helpers that have to scale with the item rows."""

import pytest
from pyspark.sql import functions as F

from rankmix.model import ScoreSet
from rankmix.operators.weights import pairwise, strengths
from rankmix.sources.frames import with_batch_ids


def score_set(spark, n=40, models=("A", "B", "C"), classes=4):
    """Item rows made here; scores with a few ties."""
    cols = [F.array(*[((F.col("item_id") * (7 * i + 3 * k + 1) + k) % 11 / 10.0) for k in range(classes)]).alias(f"s{i}")
            for i in range(len(models))]
    df = spark.range(n).withColumnRenamed("id", "item_id").select(
        "item_id", (F.col("item_id") % classes).cast("int").alias("label"), *cols)
    return ScoreSet(df=df, models=models, n_classes=classes)


@pytest.mark.parametrize("corr", ["CD", "KSI"])
def test_diversity_of_first_items_is_not_computed_for_other_items(spark, corr):
    """no condition on the matrices reaches the item rows."""
    ss = with_batch_ids(score_set(spark), 8)
    for frame in (strengths(ss, corr), pairwise(ss, corr)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "transform" in line]
    assert strengths(ss, corr).count() == 5 * 3 and pairwise(ss, corr).count() == 5 * 6


def test_average_ranks_are_made_in_the_tasks(spark):
    """ranks of whole blocks, as the array expression has them: NULL without
    a rank, NaN on top, ties shared, arrays of any length."""
    from rankmix.functions import avg_rank_desc
    from rankmix.operators.ranks import item_ranks
    rows = [(1, [0.5, 0.5, None, float("nan")], [0.1, 0.2]), (None, [0.0, -0.0, 1.0], [None, None]),
            (1, [], [0.3]), (4, None, [0.3, 0.2, 0.3]), (5, [float("nan"), float("nan"), 2.0], [7.0])]
    df = spark.createDataFrame(rows, "item_id long, s0 array<double>, s1 array<double>")
    got = item_ranks(ScoreSet(df=df, models=("A", "B"), n_classes=4))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = None
    for i, m in enumerate("AB"):
        own = df.select("item_id", F.lit(m).alias("model"), F.posexplode(F.arrays_zip(F.col(f"s{i}").alias("s"), avg_rank_desc(F.col(f"s{i}")).alias("r"))))
        own = own.select("item_id", "model", F.col("pos").alias("cls"), F.col("col.s").alias("score"), F.col("col.r").alias("rank"))
        want = own if want is None else want.unionByName(own)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_score_directory_is_written_and_read_in_one_pass(spark, tmp_path):
    """one grouping for all models; cells travel by line, not alone."""
    from rankmix.sources import files
    from rankmix.sources.frames import to_long, to_wide
    ss = score_set(spark, models=("A", "x b", "C"))
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    long = to_long(ss).coalesce(1)
    long = long.mapInArrow(count, long.schema)
    files.write_score_dir(long, ss.models, ss.n_classes, str(tmp_path / "d"))
    assert made.value == 40 * 3 * 4
    back = to_wide(files.read_score_folders(spark, str(tmp_path / "d")), truth=ss.df.select("item_id", "label"), batch_size=8)
    assert "FlatMapGroupsInArrow" in back.df._jdf.queryExecution().executedPlan().toString()
    assert back.models == ("A", "C", "x b") and back.n_classes == 4
    got = {r["item_id"]: (r["label"], r["s0"], r["s2"], r["s1"]) for r in back.df.collect()}
    assert got == {r["item_id"]: (r["label"], r["s0"], r["s1"], r["s2"]) for r in ss.df.collect()}


def test_next_round_is_written_without_a_shuffle(spark, monkeypatch):
    """A round's rows stay where their batch lies."""
    from rankmix.operators.combine import fused_specs, layer_of
    from rankmix.operators.weights import batch_weights
    from rankmix.plans import layer as L, search as S
    seen = []
    monkeypatch.setattr(S, "materialize", lambda nxt: seen.append(nxt) or nxt)
    ss = L.prepare(score_set(spark), 8)
    layer = layer_of(ss, batch_weights(ss, ("AC",)), fused_specs(ss.models, ("AC",)))
    S._next_base(ss, layer, [{"j": 3, "top": None, "kind": "SC", "fusion_model": "AB_AC", "accuracy": 1.0}])
    assert "Exchange" not in seen[0].df._jdf.queryExecution().executedPlan().toString()
