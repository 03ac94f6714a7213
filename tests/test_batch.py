"""Batched logistic fits against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evweave.operators import batch as B
from evweave.operators import models as MD
from evweave.operators import split as X
from evweave.queries.common import FEATURES, labelled_sr
from evweave.session import materialize

from conftest import SF01


@pytest.fixture(scope="module")
def data(spark):
    return X.with_rank(labelled_sr(spark, SF01).select("event_key", "tag", "label", "weight", *FEATURES), 42)


def test_forty_four_models_in_the_passes_of_one(spark, data):
    sets = {"all": FEATURES, "two": FEATURES[:2], "three": FEATURES[1:4], "one": FEATURES[4:]}
    specs = [B.Spec(f"{n}|{b}", f, class_weights=(float(b), 10.0)) for n, f in sets.items() for b in range(10, 21)]
    batch = B.fit_many(data, specs)
    assert len(batch.models) == 44
    assert batch.passes <= max(len(m.history) for m in batch.models.values()) + 2
    for s in (specs[0], specs[15], specs[43]):
        one = MD.fit_classifier(data, s.features, "logistic", negative_weights="signed", class_weights=s.class_weights)
        m = batch.models[s.name]
        assert m.coefs == pytest.approx(one.coefs, rel=1e-9, abs=1e-12)
        assert (m.n_rows, len(m.history)) == (one.n_rows, len(one.history))
        assert m.abs_weight == pytest.approx(one.abs_weight)
        assert [x for _, x in m.history] == pytest.approx([x for _, x in one.history])


def test_row_conditions_and_unweighted(spark, data):
    specs = [B.Spec(str(t), FEATURES, rows=f"tag = {t}") for t in range(3)] + [B.Spec("flat", FEATURES, weighted=False)]
    batch = B.fit_many(data, specs)
    for t in range(3):
        one = MD.fit_classifier(data.where(F.col("tag") == t), FEATURES, "logistic", negative_weights="signed")
        assert batch.models[str(t)].coefs == pytest.approx(one.coefs, rel=1e-9, abs=1e-12)
    flat = MD.fit_signed_logistic(data.withColumn("one", F.lit(1.0)), FEATURES, weight="one")
    assert batch.models["flat"].coefs == pytest.approx(flat.coefs, rel=1e-9, abs=1e-12)
    facts = {r["model"]: r for r in batch.facts(spark).collect()}
    assert sum(facts[str(t)]["n_rows"] for t in range(3)) == facts["flat"]["n_rows"] == data.count()
    scored = batch.score(data, {str(t): f"tag = {t}" for t in range(3)})
    assert scored.count() == 2 * data.count()
    assert scored.where("model <> 'flat' and model <> cast(tag as string)").count() == 0


def test_coefficients_have_no_gradient(spark, data):
    batch = B.fit_many(data, [B.Spec("m", FEATURES, class_weights=(12.0, 10.0), reg=0.0)])
    c = {r["feature"]: r["coefficient"] for r in batch.coefficients(spark).collect()}
    z = F.lit(c[None])
    for f in FEATURES:
        z = z + F.lit(c[f]) * F.col(f)
    r = F.col("weight") * F.when(F.col("label") == 1, 10.0).otherwise(12.0) * (1 / (1 + F.exp(-z)) - F.col("label"))
    g = data.agg(F.sum(r).alias("g"), *[F.try_divide(F.sum(r * F.col(f)), F.max(F.abs(F.col(f)))).alias(f) for f in FEATURES],
                 F.sum(F.abs(r)).alias("size")).first()
    assert max(abs(g["g"]), *(abs(g[f]) for f in FEATURES)) <= 1e-4 * g["size"]


def test_validation_loss_in_the_same_pass(spark, data):
    train, val = (X.part_condition(0.6, 0.2, 0.2, p) for p in ("train", "val"))
    batch = B.fit_many(data, [B.Spec("m", FEATURES, rows=train, validation=val, reg=0.0)])
    h = batch.history_table(spark).orderBy("iteration").collect()
    assert len(h) >= 3 and [r["iteration"] for r in h] == list(range(len(h)))
    for part, col in ((train, "loss"), (val, "val_loss")):
        p = MD.score(batch.models["m"], data.where(part))
        e = p.agg((F.sum(F.col("weight") * -F.when(F.col("label") == 1, F.log("score")).otherwise(F.log(1 - F.col("score"))))
                   / F.sum(F.abs("weight"))).alias("e")).first()["e"]
        assert h[-1][col] == pytest.approx(e)
    n = data.where(train).count()
    assert batch.models["m"].n_rows == n == X.split_sizes(data.count(), 0.6, 0.2, 0.2)[0]


def test_more_conditions_than_one_pass_flags(spark, data, monkeypatch):
    specs = [B.Spec(str(t), ["f_qty"], rows=f"tag = {t}") for t in range(3)]
    whole = B.fit_many(data, specs)
    monkeypatch.setattr(B, "CONDITIONS", 2)
    parts = B.fit_many(data, specs)
    for s in specs:
        assert parts.models[s.name].coefs == pytest.approx(whole.models[s.name].coefs, rel=1e-12)


def test_refusals(spark, data):
    with pytest.raises(ValueError):
        B.fit_many(data, [B.Spec("a", FEATURES), B.Spec("a", FEATURES)])
    with pytest.raises(ValueError):
        B.fit_many(data, [B.Spec("a", FEATURES, rows="tag = 99")])


def test_random_starts_end_alike(spark, data):
    batch = B.fit_many(data, [B.Spec("a", FEATURES, start=0, tol=1e-10), B.Spec("b", FEATURES, start=1, tol=1e-10),
                              B.Spec("c", FEATURES, tol=1e-10)])
    a, b, c = (np.array(batch.models[n].coefs) for n in "abc")
    assert a == pytest.approx(c, rel=1e-4, abs=1e-5) and b == pytest.approx(c, rel=1e-4, abs=1e-5)
    assert batch.models["a"].history[0][1] != batch.models["b"].history[0][1]


def test_split_conditions_equal_the_split(spark, data):
    for sizes in ((0.6, 0.2, 0.2), (0.5, 0.3, 0.2), (0.3, 0.3, 0.4)):
        s = X.assign_split(data.select("event_key"), *sizes, seed=42)
        want = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
        j = data.join(s, "event_key")
        for part in ("train", "val", "test"):
            assert j.where(X.part_condition(*sizes, part)).where(F.col("split") != part).count() == 0
            assert data.where(X.part_condition(*sizes, part)).count() == want[part]
