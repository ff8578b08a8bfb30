"""Fixed domain values: thresholds, sites, rivers, texts, feature names.

Everything here is a value the results depend on; there is no logic in this file.
"""

# Water depth thresholds in cm, lower bound inclusive.
DEPTH_WASPADA = 20.0
DEPTH_SIAGA = 50.0
DEPTH_AWAS = 100.0

# One row per depth band (level, label, colour, recommendation).
RISK_BANDS = [
    ("NORMAL", "AMAN", "green", "Kondisi aman. Tetap pantau informasi cuaca."),
    ("WASPADA", "WASPADA", "yellow", "Hati-hati genangan air di jalan rendah. Bersihkan drainase."),
    ("SIAGA", "SIAGA", "orange", "Siaga banjir. Amankan barang elektronik ke tempat lebih tinggi."),
    ("AWAS", "AWAS", "red", "BAHAYA. Segera evakuasi ke tempat aman. Ikuti arahan petugas."),
]

# Alert labels from lowest to highest rank, and the default gate.
ALERT_RANK = ["AMAN", "WASPADA", "SIAGA", "AWAS"]
ALERT_MIN_LEVEL = "SIAGA"

# Command wording per level.
COMMAND_TERMS = {
    "WASPADA": "SIAGA III (WASPADA)",
    "SIAGA": "SIAGA II (DARURAT)",
    "AWAS": "SIAGA I (AWAS)",
}

# Rain (mm), tide (m), elevation (m) limits.
RAIN_HEAVY = 50.0
RAIN_EXTREME = 150.0
RAIN_BURST = 10.0
TIDE_HIGH = 2.5
TIDE_DATUM_OFFSET = 2.8
ELEVATION_LOW = 5.0
DRAIN_CAPACITY_MM = 200.0
FLOOD_PROBABILITY = 0.65

# Antecedent-precipitation decay and upstream travel time.
API_DECAY = 0.85
UPSTREAM_LAG_HOURS = 6

# Local time zone (UTC+8) and the defaults used where a measurement is absent.
LOCAL_ZONE = "Asia/Singapore"
RAINY_MONTHS = (11, 12, 1, 2, 3)
OUTLOOK_RAINY_MONTHS = (11, 12, 1, 2, 3, 4)
HOURLY_DEFAULTS = {
    "precipitation": 0.0,
    "soil_moisture_surface": 0.4,
    "soil_moisture_root": 0.4,
    "wind_speed": 2.0,
}

# Monitoring sites (name, lat, lon, runoff coefficient) and the upstream gauge.
SITES = [
    ("Simpang Lembuswana", -0.472740, 117.143783, 0.90),
    ("Simpang Sempaja", -0.457889, 117.155432, 0.85),
    ("Jalan Antasari", -0.493922, 117.136894, 0.95),
    ("Lempake (Hulu)", -0.428987, 117.168341, 0.60),
    ("Kebon Agung", -0.439812, 117.172938, 0.70),
]
UPSTREAM_SITES = [("Hulu Karang Mumus (Badak Baru)", -0.352493, 117.228945)]

# River centre lines as (lon, lat) vertices; metres per degree.
RIVERS = {
    "Mahakam": [(117.05, -0.55), (117.13, -0.52), (117.16, -0.50), (117.22, -0.53), (117.30, -0.55)],
    "Karang Mumus": [(117.16, -0.40), (117.165, -0.45), (117.155, -0.48), (117.15, -0.50)],
}
METRES_PER_DEGREE = 111139.0

# Map extent (lon, lat) used for the display grid.
MAP_EXTENT = (117.05, -0.58, 117.22, -0.42)

# Amenity groups.
SCHOOL_AMENITIES = ["school", "university", "college", "kindergarten"]
HOSPITAL_AMENITIES = ["hospital", "clinic", "pharmacy"]

# Class names in label order 0, 1, 2.
STATUS_LABELS = {"Aman": 0, "Air Meluap": 1, "Banjir": 2}

# Indonesian day and month abbreviations, Monday and January first.
ID_DAYS = ["Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu", "Minggu"]
ID_MONTHS = ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agust", "Sep", "Okt", "Nov", "Des"]

# Alert texts.
ALERT_ICON = {"AMAN": "✅", "WASPADA": "⚠️", "SIAGA": "🟠", "AWAS": "🔴"}
ALERT_ICON_OTHER = "ℹ️"
ALERT_DEFAULT_REASON = "Data cuaca dan pasang surut"
ALERT_DEFAULT_ADVICE = "Pantau kondisi secara berkala"
ALERT_SOURCE = "Sistem Peringatan Dini Banjir"

# Tidal constituents, period in hours.
CONSTITUENT_PERIOD_H = {"M2": 12.4206, "K1": 23.9345, "S2": 12.0, "O1": 25.8193}

# Names of the 37 model features in model order.
LAG_FEATURES = [f"rain_lag{i}" for i in range(1, 8)]
CORE_FEATURES = [
    "rain_sum_imputed",
    "rain_intensity_max",
    "soil_moisture_surface_mean",
    "soil_moisture_root_mean",
    "pasut_msl_max",
]
DERIVED_FEATURES = [
    "soil_saturation_index",
    "rain_cumsum_3d",
    "rain_cumsum_7d",
    "tide_rain_interaction",
    "is_high_tide",
    "is_heavy_rain",
    "api_7day",
]
TEMPORAL_FEATURES = ["month_sin", "month_cos", "is_rainy_season", "is_weekend"]
HISTORY_FEATURES = ["prev_flood_30d", "prev_meluap_30d"]
EVENT_FEATURES = [
    "rain_intensity_3h",
    "rain_burst_count",
    "soil_saturation_trend",
    "tide_rain_sync",
    "consecutive_rain_days",
    "hour_risk_factor",
    "drain_capacity_index",
    "upstream_rain_6h",
    "wind_speed_max",
    "rainfall_acceleration",
]
STATIC_FEATURES = ["elevation_m", "drainage_capacity"]
STATIC_DEFAULTS = {"elevation_m": 2.0, "drainage_capacity": 50.0}

FEATURES_V4 = CORE_FEATURES + LAG_FEATURES + DERIVED_FEATURES + TEMPORAL_FEATURES + HISTORY_FEATURES
FEATURES_V6 = FEATURES_V4 + EVENT_FEATURES
FEATURES_V7 = FEATURES_V6 + STATIC_FEATURES
