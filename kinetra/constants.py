"""Fixed values of the detection model; results depend on them."""

SAFE_DISTANCE_BASE, MAX_WARNING_TIME, MAX_RELATIVE_SPEED = 5.0, 10.0, 50.0
RISK_WEIGHTS = {"distance": 0.3, "time": 0.3, "speed": 0.2, "angle": 0.1, "type": 0.1}
SEARCH_RADIUS, TIME_WINDOW, PROBE_STEP, MIN_RELATIVE_SPEED = 100.0, 10.0, 0.1, 0.1
HIGH_RISK = 0.7
PREDICTION_HORIZON, PREDICTION_STEP, PREDICTION_WINDOW, HISTORY_CAP = 10.0, 0.5, 1.0, 100
STATIONARY_SPEED, CONSTANT_ACCELERATION = 0.1, 0.1
SAME_TYPE, OTHER_TYPE = 0.5, 0.8
ALERT_RISK, MEDIUM_RISK, URGENT_RISK, ALERT_EXPIRY = 0.3, 0.6, 0.8, 30.0
GRID_BASE, GRID_MAX_LEVEL, SPLIT_ABOVE, MERGE_BELOW = (1000.0, 1000.0, 100.0), 3, 50, 10
LOOKAHEAD, LOOKAHEAD_RISK, LOOKAHEAD_DISTANCE, STALE_AFTER = 5.0, 0.5, 50.0, 10.0
CONTACT_RADIUS = 2.0
OVER_FACTOR, UNDER_FACTOR, TARGET_FACTOR = 1.2, 0.8, 0.9
CLOSING_SPEED, CONTACT_HORIZON = 12.5, 5.0
HEARTBEAT_INTERVAL, HEARTBEAT_MISSES = 5.0, 3
QUEUE_CAPACITY = 10_000
BREAKER = {"failures": 5, "recovery": 30.0, "trial_calls": 3}
VEHICLE_SIZES = {"car": 2.0, "truck": 4.0, "bus": 5.0, "motorcycle": 1.0}
