import threading
from types import SimpleNamespace

from quotelens.catalog import learning


def test_both_losses_are_fitted_side_by_side(spark, monkeypatch):
    """one fit after the other would never meet here."""
    meet = threading.Barrier(2, timeout=20)

    def fitted(d, candidate):
        meet.wait()
        return spark.createDataFrame([(candidate.name,)], "model_name string")

    monkeypatch.setattr(learning, "_holdout_predictions", fitted)
    rows = learning.model_boosted(SimpleNamespace(model_frame=None)).collect()
    assert [r[0] for r in rows] == [learning.BOOSTED.name, learning.BOOSTED_SQUARED.name]
