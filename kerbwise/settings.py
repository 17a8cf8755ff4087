"""Parameters of the engine and the fixed values its results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------
# Word patterns, rule tables, limits and labels below decide the results and
# are part of the data contract. They are stated as plain text, in order.

NULL_TOKENS = ("NULL", "", "None")

# Tokens that a pandas-style CSV reader treats as missing before any cleaning.
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

TEXT_CLEAR = (
    r"normal|no problem|no issue|cleared|clear|smooth|fine|ok\b|resolved|"
    r"ಸಮಸ್ಯೆ ಇಲ್ಲ|ಸರಿ|ಕ್ಲಿಯರ್"
)
TEXT_AFFECTED = (
    r"slow|jam|block|stuck|heavy traffic|swol|choke|congest|conje|diversion|"
    r"ನಿಧಾನ|ಬ್ಲಾಕ್|ಜಾಮ್|ಟ್ರಾಫಿಕ್"
)

# Ordered (pattern, label) rules, first match wins. The scoring report and the
# calendar use different sets, so both are kept.
REPORT_RULES = (
    (r"chinnaswamy|m chinnaswamy|cricket|ipl|rcb", "Chinnaswamy Stadium (cricket/IPL)"),
    (r"rathotsava|rathothsava|utsava|uthsava|car festival|temple|jatre|palakki", "Religious procession/festival"),
    (r"metro|namma metro", "Metro construction/closure"),
    (r"nhai|bwssb|k.?ride|kride|white ?tapping|tar|asphalt|road work|works|construction", "Infrastructure works"),
    (r"protest|dharna|bandh|rally", "Protest/rally"),
    (r"vip|cm |minister|convoy", "VIP movement"),
)
CALENDAR_RULES = (
    (r"chinnaswamy|cricket|ipl|rcb", "Chinnaswamy cricket/IPL"),
    (r"rathotsava|utsava|uthsava|car festival|temple|jatre|palakki", "Religious procession"),
    (r"metro", "Metro construction"),
    (r"nhai|bwssb|kride|k.?ride|white ?tapping|road work|works|construction", "Infrastructure works"),
    (r"protest|dharna|bandh|rally", "Protest/rally"),
    (r"vip|cm |minister|convoy", "VIP movement"),
)
SCENARIO_LABELS = (
    "Cricket / IPL (Chinnaswamy)", "Religious procession", "Metro construction",
    "Infrastructure works", "Protest / rally", "VIP movement",
)
SCENARIO_RULES = tuple((pattern, label) for (pattern, _), label in zip(CALENDAR_RULES, SCENARIO_LABELS))
DEFAULT_ARCHETYPE = "Other planned"
DEFAULT_SCENARIO = "Other"

URGENCY_TIERS = {
    "accident": "red", "protest": "red", "public_event": "red", "congestion": "red",
    "vip_movement": "red", "procession": "amber", "water_logging": "amber",
    "tree_fall": "amber", "construction": "amber", "fog / low visibility": "amber",
    "vehicle_breakdown": "std", "pot_holes": "std", "road_conditions": "std",
    "others": "std", "debris": "std",
}
URGENCY_LABELS = {
    "red": "Deploy ≤15 min", "amber": "Deploy ≤1 hr",
    "green": "Pre-position (known)", "std": "Standard",
}
GREEN_ARCHETYPES = ("Metro construction", "Infrastructure works", "VIP movement")

PASSIVE_CAUSES = ("pot_holes", "tree_fall", "road_conditions", "debris")
LIVE_CAUSES = ("congestion", "accident", "public_event", "procession", "protest", "vip_movement")

EARTH_RADIUS_KM = 6371.0
NON_CORRIDOR = "Non-corridor"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Bounds:
    """Inclusive coordinate box of the city."""

    lat_min: float = 12.6
    lat_max: float = 13.3
    lon_min: float = 77.3
    lon_max: float = 77.9


BOUNDS = Bounds()
TIMEZONE = "Asia/Kolkata"
GRID_DEG = 0.012
ZONE_GRID_DEG = 0.006

CENSOR_BAND_MIN = (118, 182)
TRUST_LIMIT_MIN = 1440
CLEARANCE_CLIP_MIN = (2.0, 600.0)
MODEL_CLEARANCE_LIMIT_MIN = 600

PAIR_WINDOW_SEC = 90 * 60
SPILL_KM = 4.0
BURST_KM = 1.5
BURST_MIN_SIZE = 4
NODE_MIN_INCIDENTS = 20
EDGE_MIN_COUNT = 3
BLAST_MIN_LIFT = 1.1
BLAST_TOP = 3
DIVERSION_TOP = 2
DIVERSION_KM = 8.0

REACH_KM = 2.5
UNITS = 8
PLAN_MINSEP_KM = 1.8
CURVE_UNITS = 15
CURVE_MINSEP_KM = 2.0
SWEEP_UNITS = 16
EVENT_RADIUS_KM = 1.5
PREVENTABLE_SHARE = 0.35

PANEL_MIN_INCIDENTS = 5
HOLDOUT_DAYS = 30
WARMUP_DAYS = 56
FOLD_DAYS = 7
TOP_SHARE = 0.20
