"""AGG-23: draws by blocks of users, with and without a broadcast of the gains."""

import pytest

from loomspan.plans import catalog, evaluation


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_blocks_change_nothing(spark, sf_dir, monkeypatch, sent):
    run = catalog.queries()["agg23_bootstrap"]
    want = run(spark, sf_dir).collect()
    monkeypatch.setattr(evaluation, "DRAWN", 4)
    monkeypatch.setattr(evaluation, "SENT_USERS", sent)
    assert run(spark, sf_dir).collect() == want
