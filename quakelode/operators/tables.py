"""One wide feature table from which every experiment takes its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelode.constants import FAULT_BUFFER_KM, MAGNITUDE_DAYS
from quakelode.operators import etas, features, gps, grid
from quakelode.sources.polylines import with_elevation

KEY = ["row", "col", "issue_date"]


def wide_features(cells: DataFrame, issues: DataFrame, history: DataFrame, coast: DataFrame, fault: DataFrame, elevations: DataFrame, drivers: DataFrame, positions: DataFrame) -> DataFrame:
    """(row, col, issue_date, latitude, longitude, and the columns of all grid feature sets) for every cell and date.

    cells carry their number in the regional grid as ``cell``; elevations have (cell, elevation). The neighbourhood join
    and fault distances are of the events' distinct places, once for counts, magnitudes, recency and fault means; all parts have the same keys, so they join in place.
    """
    near = features.near_places(cells, history)
    lines = grid.nearest_line_km(near.select(*features.PLACE).distinct(), fault, features.PLACE, "event_fault_km", FAULT_BUFFER_KM)
    static = with_elevation(grid.with_statics(cells, coast, fault), elevations, "cell")
    out = features.place_windows(near.join(lines, features.PLACE), history, cells, issues, "event_fault_km").join(features.place_recency(near, history, cells, issues), KEY)
    out = out.join(static, ["row", "col"])
    out = out.withColumns({f"fault_mean_{d}d": F.coalesce(f"fault_mean_{d}d", "fault_km") for d in MAGNITUDE_DAYS})
    out = out.join(features.tide_at_issues(static, issues, drivers).select(*KEY, "tide"), KEY)
    out = out.join(gps.cell_features(cells, issues, positions), KEY)
    return out.join(etas.planar_intensity(cells, issues, history), KEY)
