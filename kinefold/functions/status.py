"""Status words of the annotation tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of keypoint and instance statuses.
KEYPOINT_CODES = {"unlabeled": -1, "missing": 0, "visible": 1, "projected": 2}
INSTANCE_CODES = {"unlabeled": -1, "absent": 0, "labeled": 1, "present": 2}


def status_code(status: Column, codes: dict[str, int] = KEYPOINT_CODES) -> Column:
    """The code of a status; null for an unknown word, which the contract calls a violation."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in codes.items()))
    return F.try_element_at(table, status).cast("tinyint")


def positioned(status: Column) -> Column:
    """Whether a row of this status has coordinates."""
    return status.isin("visible", "projected")


def visibility_target(status: Column) -> Column:
    """1 seen, 0 looked for and not seen, null where nothing is claimed."""
    return F.when(status == "visible", 1.0).when(status == "missing", 0.0)


def finite(column: Column) -> Column:
    """The value, or null where it is not a finite number."""
    x = column.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
