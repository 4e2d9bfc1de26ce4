"""Fixed values of the data model."""

# Band key -> asset key of the scene catalogue.
BAND_ASSETS = {
    "B01": "B01_20m", "B02": "B02_10m", "B03": "B03_10m", "B04": "B04_10m", "B05": "B05_20m",
    "B06": "B06_20m", "B07": "B07_20m", "B08": "B08_10m", "B8A": "B8A_20m", "B09": "B09_60m",
    "B11": "B11_20m", "B12": "B12_20m", "SCL": "SCL_20m", "VV": "vv", "VH": "vh",
}

# Bands that are computed, not fetched.
GENERATED_BANDS = ["zenith", "azimuth"]

# Bands each offered index reads.
INDEX_BANDS = {
    "SCL": ["SCL"],
    "NDVI": ["B04", "B08"],
    "NBR": ["B08", "B12"],
    "MSI": ["B08", "B11"],
    "LAI": ["B03", "B04", "B05", "B06", "B07", "B8A", "B11", "B12", "zenith", "azimuth"],
}

# Reflectance of calibration plates 1 to 6.
PLATE_REFLECTANCE = {1: 0.1, 2: 0.15, 3: 0.4, 4: 0.05, 5: 0.5, 6: 0.94}

# Marker colours by confidence.
STYLE_DEFAULT = "#3388ff"
STYLE_HIGH, STYLE_MEDIUM, STYLE_LOW = "#2ecc71", "#f1c40f", "#e74c3c"

# Media file extensions, sensor size (mm) and radii (m).
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "mpg", "mpeg", "m4v", "ts", "webm", "3gp"]
SENSOR_FOCAL_MM, SENSOR_WIDTH_MM, SENSOR_HEIGHT_MM = 13.0, 10.88, 8.704
FULL_FRAME_WIDTH_MM, FULL_FRAME_HEIGHT_MM = 36.0, 24.0
EARTH_MEAN_M, EARTH_EQUATOR_M, METERS_PER_DEGREE = 6_371_000.0, 6_378_137.0, 111_320.0

# NDVI colour ramp.
NDVI_COLORS = ["#FF0000", "#FF7441", "#FFE51E", "#FFFDA9", "#00B61E", "#006837"]
NDVI_STOPS = [0, 45, 64, 105, 200, 255]

# Hyperspectral camera band count and spectral range (nm).
CAMERA_BANDS, CAMERA_FIRST_NM, CAMERA_LAST_NM = 224, 397.66, 1003.81
