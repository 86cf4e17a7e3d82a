"""Fixed values that define the estimator's results, in natural order."""

# --- Fixed values: signal model -------------------------------------------------
TX_POWER_DBM = -66.0
PATH_LOSS_N = 2.4
RSSI_SIGMA = 5.0
FLOOR_ATTENUATION_DB = 6.0
WALL_ATTENUATION_DB = 6.0
MIN_DISTANCE_FT = 1.0
METRES_PER_FOOT = 0.3048
FLOOR_ELEVATION_FT = {1: 0.0, 2: 8.75, 3: 17.5}
ZONE_LIKELIHOOD_STRENGTH = 0.3
MISSING_RSSI = -100.0

# --- Fixed values: Kalman bank ---------------------------------------------------
KALMAN_P_RSSI, KALMAN_P_VELOCITY = 10.0, 5.0
KALMAN_Q, KALMAN_R, STALE_S = 0.5, 0.6, 30.0

# --- Fixed values: cycles and features -------------------------------------------
FEATURE_WINDOW = 20
POSITION_WINDOW = 10
VARIANCE_NORM, DELTA_NORM, DISPLACEMENT_NORM = 8.0, 3.0, 4.0
VARIANCE_WEIGHT, DELTA_WEIGHT, DISPLACEMENT_WEIGHT = 0.25, 0.25, 0.50
SLEEPING_BELOW, STATIONARY_BELOW = 0.15, 0.45
DEFAULT_DT, MAX_DT, MIN_INTERVAL_S = 0.5, 10.0, 0.25

# --- Fixed values: floor model ----------------------------------------------------
HMM_RATE, HMM_SIGMA = 0.01, 8.0
HMM_STAIR_RADIUS_FT, HMM_STAIR_BOOST, HMM_MAX_OFF = 6.0, 5.0, 0.3
HMM_SELF = 0.97

# --- Fixed values: particle filter ------------------------------------------------
PARTICLES = 500
MAX_SPEED_FT_S, MOTION_SIGMA, DRIFT_RATE = 3.28, 1.5, 0.15
RESAMPLE_RATIO = 0.5
STAIR_RADIUS_FT, STAIR_BASE_P, STAIR_RATE, STAIR_COOLDOWN_S = 4.0, 0.02, 0.8, 5.0
TELEPORT_BELIEF, TELEPORT_HOLD_S, TELEPORT_SHARE = 0.85, 2.0, 0.3
MIN_DT = 0.01

# --- Fixed values: grid, survey, classifier ---------------------------------------
GRID_FT = 0.5
SURVEY_FT, SURVEY_MIN_ANCHORS, SURVEY_HIGH_STD = 3.0, 3, 8.0
SURVEY_DWELL_S, OCCLUDED_DWELL_S = 30.0, 15.0
TREES, TREE_DEPTH, MIN_LEAF, FOREST_SEED = 200, 30, 3, 42
AUGMENT_FACTOR, AUGMENT_SIGMA, AUGMENT_DROPOUT = 5, 1.5, 0.15
DENSITY_FT = 2.0
