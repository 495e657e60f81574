"""Static guards on the library source."""

import pathlib

ROOT = pathlib.Path(__file__).resolve().parents[1] / "riskloom"


def test_no_local_checkpoint_or_driver_side_data_loops():
    for path in ROOT.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text, path
        assert ".toPandas()" not in text, path


def test_every_registered_query_is_documented():
    from riskloom.plans.registry import REGISTRY, _load
    _load()
    assert all(spec.doc for spec in REGISTRY.values())
