"""Tables, priors, thresholds and feature names the results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: text tokens read as missing -------------------------------------------
MISSING_TOKENS = ["--", "---", ""]
DEFAULT_NA_WORDS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: name spelling in bout lists -> spelling in the entity list ------------
NAME_ALIASES = {
    "Waldo Cortes Acosta": "Waldo Cortes-Acosta",
    "YiSak Lee": "Yi Sak Lee",
    "Zach Reese": "Zachary Reese",
    "Cam Nelson": "Cameron Nelson",
    "Kai Kamaka III": "Kai Kamaka",
    "Sean King III": "Sean King",
    "Levi Rodrigues Jr.": "Levi Rodrigues",
    "Michael Aswell Jr.": "Michael Aswell",
    "Ilimbek Akylbek": "Ilimbek Akylbek Uulu",
    "Rafael Cerquiera": "Rafael Cerqueira",
    "Muhammad Saidov": "Muhammad Said",
    "Hector Santiago": "Hector de Sousa Santiago",
    "Ben Johnston": "Benjamin Donovan Johnston",
    "Adrian Luna Martinetti": "Juan Adrian Luna",
    "Patricio Pitbull": "Patricio Freire",
    "Mahammadali Osmanli": "Mehemmedeli Osmanli",
}

# --- Fixed values: class names in matching order, weight limit (lbs), women's class ------
WEIGHT_CLASSES = [
    ("Women's Strawweight", 115.0, True),
    ("Women's Flyweight", 125.0, True),
    ("Women's Bantamweight", 135.0, True),
    ("Women's Featherweight", 145.0, True),
    ("Light Heavyweight", 205.0, False),
    ("Super Heavyweight", None, False),
    ("Heavyweight", 265.0, False),
    ("Strawweight", 115.0, False),
    ("Flyweight", 125.0, False),
    ("Bantamweight", 135.0, False),
    ("Featherweight", 145.0, False),
    ("Lightweight", 155.0, False),
    ("Welterweight", 170.0, False),
    ("Middleweight", 185.0, False),
    ("Catch Weight", None, False),
    ("Open Weight", None, False),
]
OTHER_CLASS = "Other"
NO_CLASS = "Catch Weight"

# --- Fixed values: divisions and their limits, lightest first ----------------------------
DIVISION_LBS = {
    "Strawweight": 115.0,
    "Flyweight": 125.0,
    "Bantamweight": 135.0,
    "Featherweight": 145.0,
    "Lightweight": 155.0,
    "Welterweight": 170.0,
    "Middleweight": 185.0,
    "Light Heavyweight": 205.0,
    "Heavyweight": 265.0,
}
WOMEN_PREFIX = "Women's "

# --- Fixed values: per-side statistics, in table order -----------------------------------
PLAIN_STATS = ["kd", "sub_att", "rev", "ctrl_s"]
PAIR_STATS = ["sig", "tot", "td", "head", "body", "leg", "dist", "clinch", "ground"]
STAT_COLS = PLAIN_STATS + [f"{p}_{k}" for p in PAIR_STATS for k in ("landed", "att")]

# --- Fixed values: source header of each "x of y" statistic ------------------------------
PAIR_HEADERS = {
    "sig": "SIG.STR.",
    "tot": "TOTAL STR.",
    "td": "TD",
    "head": "HEAD",
    "body": "BODY",
    "leg": "LEG",
    "dist": "DISTANCE",
    "clinch": "CLINCH",
    "ground": "GROUND",
}

# --- Fixed values: headers of the four raw files -----------------------------------------
RAW_EVENTS = ["EVENT", "URL", "DATE", "LOCATION"]
RAW_RESULTS = ["EVENT", "BOUT", "OUTCOME", "WEIGHTCLASS", "METHOD", "ROUND", "TIME",
               "TIME FORMAT", "REFEREE", "DETAILS", "URL"]
RAW_STATS = ["EVENT", "BOUT", "ROUND", "FIGHTER", "KD", "SIG.STR.", "SIG.STR. %", "TOTAL STR.",
             "TD", "TD %", "SUB.ATT", "REV.", "CTRL", "HEAD", "BODY", "LEG", "DISTANCE",
             "CLINCH", "GROUND"]
RAW_ENTITIES = ["FIGHTER", "HEIGHT", "WEIGHT", "REACH", "STANCE", "DOB", "URL"]

# --- Fixed values: finish types, in probability order ------------------------------------
FINISH_TYPES = ["KO/TKO", "SUB", "DEC"]


@dataclass(frozen=True)
class Priors:
    """Long-run averages that a short history is pulled towards."""

    slpm: float = 3.3
    sig_acc: float = 0.44
    td15: float = 1.5
    td_acc: float = 0.38
    sub15: float = 0.55
    kd15: float = 0.3
    ctrl: float = 0.21
    win: float = 0.5
    finish: float = 0.5
    ko_share: float = 0.33
    sub_share: float = 0.2
    dec_share: float = 0.45
    fin_loss: float = 0.15
    bout_minutes: float = 10.5
    # weight of the prior, in the unit of each rate's denominator
    minutes: float = 15.0
    strike_att: float = 40.0
    td_att: float = 6.0
    bouts: float = 2.0
    one_bout: float = 1.0
    # neutral values for unknown static attributes
    age: float = 30.0
    reach_minus_height: float = 2.0


PRIORS = Priors()
DAYS_PER_YEAR = 365.25
LAYOFF_CLIP_DAYS = 1500.0

# --- Fixed values: feature groups and their features, in model order ---------------------
FEATURE_GROUPS = {
    "opponent-strength rating": ["glicko_rating", "glicko_rd"],
    "experience": ["n_fights", "win_pct"],
    "recent form": ["wins_last3", "wins_last5", "win_pct_last5", "streak"],
    "age": ["age"],
    "height": ["height_in"],
    "reach": ["reach_in"],
    "stance": ["southpaw", "switch"],
    "activity (days since last bout)": ["days_since_last"],
    "striking output": ["slpm", "slpm_last3", "slpm_last5", "kd15"],
    "striking defence / damage absorbed": ["sapm", "sapm_last3", "sapm_last5", "sig_def"],
    "striking differential": ["sig_diff_pm", "sig_diff_pm_last3", "sig_diff_pm_last5"],
    "striking accuracy": ["sig_acc"],
    "wrestling offence": ["td15", "td15_last5", "td_acc", "ctrl_pct", "ctrl_pct_last5"],
    "takedown defence": ["td_def"],
    "submission threat": ["sub15", "sub_win_share"],
    "finishing / durability": ["finish_rate", "ko_win_share", "dec_win_share", "fin_loss_rate",
                               "avg_fight_min"],
}
PROFILE_FEATURES = [name for names in FEATURE_GROUPS.values() for name in names]
RATING_FEATURES = FEATURE_GROUPS["opponent-strength rating"]
DIFF_FEATURES = [f"{name}_diff" for name in PROFILE_FEATURES]
CONTEXT_FEATURES = ["min_prior_fights"]
MODEL_FEATURES = DIFF_FEATURES + CONTEXT_FEATURES

# --- Fixed values: inputs of the finish-type model ---------------------------------------
FINISH_PROFILE = ["ko_win_share", "sub_win_share", "finish_rate", "kd15", "sub15", "slpm",
                  "td15", "ctrl_pct", "sig_acc", "fin_loss_rate", "sapm", "sig_def", "td_def",
                  "avg_fight_min", "n_fights", "age"]
FINISH_DIFFS = ["glicko_rating", "win_pct", "sig_diff_pm", "reach_in"]
FINISH_CONTEXT = ["weight_lbs", "is_female", "five_rounds", "is_title"]
FINISH_FEATURES = (
    [f"w_{c}" for c in FINISH_PROFILE]
    + [f"l_{c}" for c in FINISH_PROFILE]
    + [f"wl_{c}_diff" for c in FINISH_DIFFS]
    + FINISH_CONTEXT
)
DEFAULT_WEIGHT_LBS = 170.0
FINISH_C_GRID = (0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 1.0)
FINISH_HOLDOUT_YEARS = 2


@dataclass(frozen=True)
class Periods:
    """Half-open chronological periods, ISO dates."""

    min_train: str = "2001-01-01"
    validation: str = "2022-01-01"
    test: str = "2024-01-01"
    finish_min_train: str = "2010-01-01"
    walk_forward_years: tuple[int, ...] = (2017, 2018, 2019, 2020, 2021)


PERIODS = Periods()

# --- Fixed values: network rating --------------------------------------------------------
INITIAL_RATING = 1500.0
INITIAL_RD = 350.0
MIN_RD = 30.0
INACTIVITY_DAYS_TO_RESET = 1825

# --- Fixed values: model search spaces and selection -------------------------------------
MODEL_GRIDS = {
    "logistic_regression": [{"C": 0.01}, {"C": 0.1}, {"C": 1.0}],
    "random_forest": [
        {"numTrees": 400, "maxDepth": depth, "minInstancesPerNode": leaf}
        for depth in (6, 10)
        for leaf in (20, 50)
    ],
    "boosted_trees": [
        {"maxIter": rounds, "maxDepth": depth}
        for depth in (2, 3)
        for rounds in (200, 400)
    ],
}
SEED = 42
SIMPLICITY_MARGIN = 0.002
CALIBRATIONS = ("none", "sigmoid")
PLATT_C = 1e6

# --- Fixed values: warnings, explanation, roster -----------------------------------------
LIMITED_HISTORY_BOUTS = 3
MIN_IMPACT = 0.005
ACTIVE_DAYS = 730

# --- Fixed values: entity resolution -----------------------------------------------------
MIN_PLAUSIBLE_AGE = 18
MAX_PLAUSIBLE_AGE = 45

# --- Fixed values: model age policy (days) -----------------------------------------------
RECALIBRATE_AFTER_DAYS = 180
RETRAIN_AFTER_DAYS = 365


@dataclass(frozen=True)
class GateLimits:
    """Limits of the model-quality gate."""

    min_bouts: int = 8000
    baseline_margin: float = 0.01
    max_validation_log_loss: float = 0.68
    max_test_log_loss_increase: float = 0.02
    max_refit_mean_abs_diff: float = 0.05
    min_refit_same_favourite: float = 0.90


GATE = GateLimits()

# --- Fixed values: month abbreviations of schedule pages ---------------------------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
