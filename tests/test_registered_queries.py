"""Every registered query with an oracle text agrees with it on the small tables."""

import pytest

import __spark_entry__ as contract
from readsift.checks import frames, learning, registry
from readsift.checks.compare import compare, duck
from readsift.session import stage

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.fixture(scope="module", autouse=True)
def shared_frames():
    """Build the frames many queries start from once; ``labelled_reads`` and
    ``features_by_date`` check those frames themselves."""
    kept = {}

    def once(make):
        def run(spark, sf_dir, **options):
            key = (make.__name__, sf_dir, tuple(sorted(options.items())))
            if key not in kept:
                kept[key] = stage(make(spark, sf_dir, **options), "test-frame")
            return kept[key]

        return run

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(frames, "labelled", once(frames.labelled))
        shared = once(frames.frame)
        patch.setattr(frames, "frame", shared)
        patch.setattr(learning, "frame", shared)
        yield


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, con, small_dir, name):
    ok, message, _ = compare(spark, con, small_dir, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns[0] == "METER_ID"
