"""Models judged on rows they never saw, where the labels do depend on the features."""

import random

import pytest

from strata.plans import model
from strata.sources.sinks import write_text

COLUMNS = "id bigint, followers_count int, friends_count int, time_zone string, hashtag string, label double"


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(11)
    made = []
    for i in range(3000):
        followers, friends, zone = draw.randrange(1000), draw.randrange(1000), draw.choice(["x", "y", None])
        label = (5.0 if followers > 500 else 1.0) + (4.0 if zone == "x" else 0.0) + draw.gauss(0, 0.3)
        made.append((i, followers, friends, zone, draw.choice("ab"), label))
    return spark.createDataFrame(made, COLUMNS)


@pytest.mark.parametrize("algo", ["tree", "forest"])
def test_held_out_error_is_far_below_the_mean(spark, tmp_path, rows, algo):
    training, held_out = model.split(rows, ["id"], 0.7, seed=2)
    assert training.count() + held_out.count() == 3000 and held_out.count() > 700
    pipeline = model.feature_pipeline(
        ["followers_count", "friends_count"], ["time_zone"], algo, num_features=256, seed=1
    )
    model.train(training, pipeline, str(tmp_path / "model"))
    fitted = model.load(str(tmp_path / "model"))
    mean = training.agg({"label": "avg"}).first()[0]
    by_mean = model.rmse(held_out.selectExpr("label", f"{mean}D AS prediction"))
    assert model.rmse(model.score(fitted, held_out)) < by_mean / 2


def test_a_model_description_is_stored_as_text(spark, tmp_path, rows):
    pipeline = model.feature_pipeline(["followers_count"], ["time_zone"], "tree", num_features=256, seed=1)
    fitted = model.train(rows, pipeline)
    text = model.describe(fitted)
    write_text(spark, text, str(tmp_path / "tree"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "tree")).collect()]
    assert "\n".join(lines).rstrip() == text.rstrip() and "If (feature" in text
    shares = model.importances(fitted)
    assert abs(sum(shares.values()) - 1) < 1e-9 and len(shares) >= 2
