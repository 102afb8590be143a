"""Space-separated id lists in ascending numeric order (submission format)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_id_string(ids: str | Column) -> Column:
    """Aggregate: ids of a group as ``"9 10 100"`` (numeric, not text, order).

    The list of one group is one value of the submission file: one order's
    predicted products.  In the last tier of the cascade that is every product
    the user ever bought, so it is bounded by the catalogue, not by a basket.
    """
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat_ws(
        " ", F.transform(F.sort_array(F.collect_list(c)), lambda x: x.cast("string"))
    )
