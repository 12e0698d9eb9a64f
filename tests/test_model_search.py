"""The search over numbers of trees from one fit."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from emberline.ml import churn_model as cm


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        x = [rng.random() for _ in range(4)]
        rows.append((float(x[0] + 0.3 * rng.random() > 0.6), Vectors.dense(x), i % 3))
    return spark.createDataFrame(rows, ["label", "features", "fold"]).coalesce(1).cache()


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting"])
def test_the_first_trees_are_a_model(points, name):
    classifier = cm._classifier(name)
    classifier.setParams(**{cm.TREES[name]: 6, "maxDepth": 3})
    whole = classifier.fit(points)
    cut = cm.first_trees(whole, 3)
    assert len(cut.trees) == 3 and [t.toDebugString for t in cut.trees] == [t.toDebugString for t in whole.trees[:3]]
    assert cm.first_trees(whole, 6) is whole
    scored = [r[0] for r in cut.transform(points).select(vector_to_array("probability")[1]).collect()]
    assert all(0 <= p <= 1 for p in scored) and cm._auc().evaluate(cut.transform(points)) > 0.8
    if name == "gradient_boosting":
        # boosting adds trees one after the other, so fewer rounds of it give the same trees
        classifier.setParams(maxIter=3)
        again = [r[0] for r in classifier.fit(points).transform(points).select(vector_to_array("probability")[1]).collect()]
        assert scored == pytest.approx(again)


def test_search_looks_at_every_point(points):
    seen = []
    grid = {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.1, 0.5]}
    found, auc = cm._search("gradient_boosting", grid, points, 3, 4)
    for depth in grid["maxDepth"]:
        for step in grid["stepSize"]:
            for k in grid["maxIter"]:
                scores = []
                for fold in range(3):
                    classifier = cm._classifier("gradient_boosting")
                    classifier.setParams(maxIter=k, maxDepth=depth, stepSize=step)
                    scores.append(cm._auc().evaluate(classifier.fit(points.where(points.fold != fold)).transform(points.where(points.fold == fold))))
                seen.append((sum(scores) / 3, {"maxIter": k, "maxDepth": depth, "stepSize": step}))
    best = max(s for s, _ in seen)
    assert auc == pytest.approx(best) and any(p == found and s == pytest.approx(best) for s, p in seen)
