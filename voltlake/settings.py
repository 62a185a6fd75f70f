"""Values the results depend on, gathered so a caller can see and override them."""

from datetime import timedelta

# --- fixed values -----------------------------------------------------------
# Transmission-level fuels counted as renewable.
RENEWABLE_FUELS = ("WIND", "NPSHYD", "BIOMASS")

# Lowest score of each recommendation, best first.
RECOMMENDATION_BANDS = (
    (75, "Excellent, run anything"),
    (55, "Good, go for it"),
    (35, "Fair, non-urgent can wait"),
)
RECOMMENDATION_REST = "Poor, consider waiting"

# Upper edges (exclusive), lowest first.
TEMPERATURE_BANDS = ((4, "freezing"), (10, "cold"), (16, "mild"))
TEMPERATURE_REST = "warm"
INTENSITY_BANDS = ((50, "very low"), (100, "low"), (200, "moderate"), (300, "high"))
INTENSITY_REST = "very high"

# Lower edges (inclusive) of the wind condition, strongest first, in km/h.
WIND_BANDS = ((50, "strong"), (30, "good"), (15, "moderate"))
WIND_REST = "calm"

# A stress hour is cold, calm, in the evening peak (UTC) and short of renewables.
STRESS_BELOW_TEMP_C = 7
STRESS_BELOW_WIND_KMH = 20
STRESS_HOURS_UTC = (16, 20)
STRESS_BELOW_RENEWABLE_SHARE = 0.30

# Solar index: radiation that counts as full sun; wind index: speed scored as 100.
FULL_SUN_WM2 = 800.0
REFERENCE_WIND_KMH = 20.0

# Slider gain of the cost / carbon weight.
WEIGHT_GAIN = 1.8

LOCAL_ZONE = "Europe/London"
PERIODS_PER_DAY_MAX = 50  # the autumn clock change makes a 25-hour day
ROLLING_HOURS = 168

PRODUCT_MARK = "AGILE"
PRODUCT_DIRECTION = "IMPORT"

# regionid, shortname, full_name
REGION_LOOKUP = (
    (1, "North Scotland", "North Scotland"),
    (2, "South Scotland", "South Scotland"),
    (3, "North West England", "North West England"),
    (4, "North East England", "North East England"),
    (5, "Yorkshire", "Yorkshire"),
    (6, "North Wales", "North Wales & Merseyside"),
    (7, "South Wales", "South Wales"),
    (8, "West Midlands", "West Midlands"),
    (9, "East Midlands", "East Midlands"),
    (10, "East England", "East England"),
    (11, "South West England", "South West England"),
    (12, "South England", "South England"),
    (13, "London", "London"),
    (14, "South East England", "South East England"),
)
# --- end of fixed values ----------------------------------------------------

SLOT = timedelta(minutes=30)
LOOKBACK = timedelta(hours=24)
LOOKAHEAD = timedelta(hours=48)
BEST_WINDOW_HORIZON = timedelta(hours=48)
RUN_HORIZON = timedelta(hours=36)
