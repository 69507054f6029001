"""Fixed values of the forecasting task."""

TARGET_MAGNITUDE, RADIUS_KM, WINDOW_DAYS, GRID_STEP, COMPLETENESS = 2.0, 100.0, 30, 0.5, 1.75
EARTH_KM, EARTH_MEAN_KM = 6371.0, 6371.0088  #: of the grid model; of the triggering model and of event labels
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 25.0, 50.0, -90.0, -65.0
COUNT_DAYS = (7, 30, 90, 365)
MAGNITUDE_DAYS = (30, 90, 365)
NO_EVENT_DAYS = 999.0
FAULT_BUFFER_KM = 5.0
TIDE_SCALE_KM = 50.0
DAY = 86400
#: Triggering model: published amplitudes and shape, and amplitudes fitted to the catalogue.
PAPER = {"K": 0.146, "a": 0.406, "c": 0.566, "p": 1.22, "d": 60.5, "q": 1.52, "mu": 0.134e-9}
FITTED = {"K": 0.846192771684, "mu": 2.12608430449e-08}
DT_MAX, DIST_MAX, MAG_MIN, MAG_REFERENCE = 180.0, 200.0, 1.75, 5.0
BAND_EDGES_KM, BAND_DAYS = (0.0, 25.0, 50.0, 100.0, 200.0), 1825.0
CLIP_GRID, CLIP_EVENT = 1e-4, 1e-15
EPSG_5070 = {"semi_major": 6378137.0, "flattening": 1 / 298.257222101, "lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0}
