"""The indexed frame experiments run on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from readsift import config
from readsift.operators.rank import row_index
from readsift.plans.features import time_series_features
from readsift.plans.reads import labelled_reads
from readsift.sources.tables import Warehouse

_ORDER = ("read_dtm", "METER_ID", "channel_id")


def experiment_frame(wh: Warehouse, since=config.DEFAULT_SINCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Labelled exceptions in time order: ``row_idx``, ``Date``, features, label.

    Ordering by the read instant orders by ``Date`` too and settles its ties.
    """
    wide = labelled_reads(wh, since, keep=("read_dtm", "channel_id"))
    indexed = row_index(wide, _ORDER)
    kept = time_series_features(
        indexed.select("*", *[indexed[c].alias(f"_keep_{c}") for c in keep]), sort=False
    ).drop("read_dtm", "channel_id")
    return kept.withColumnsRenamed({f"_keep_{c}": c for c in keep})
