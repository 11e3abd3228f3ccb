"""Names and fixed values shared by the operators.

Everything in this module is a fixed value: column names, word lists, weights and ranges that
results depend on.
"""

# --- fixed values: column names -------------------------------------------------------------

FLAGS = ["is_accident_burst", "is_high_amount_accident", "is_mistyped_entity_accident"]

LABEL = "target_accident"

# Model inputs, in the order they are assembled.
FEATURES = [
    "amount",
    "mean_24hr",
    "stddev_30day",
    "max_amount_7day",
    "hour_of_day",
    "day_of_week",
    "day_of_month",
    "month_of_year",
    "is_weekend",
    "time_since_last_txn",
    "mean_amount_rolling",
    "std_amount_rolling",
    "amount_deviation_rolling",
    "is_new_recipient",
    "is_duplicate_transaction_within_X_minutes",
    "time_deviation_from_user_norm",
    "is_unusual_location_for_user",
]

OUTPUT_COLUMNS = [
    "timestamp",
    "customer_id",
    "amount",
    "recipient_entity",
    "city",
    "accident_probability",
]

CATEGORICAL_COLUMNS = ["transaction_type", "city", "entity_type"]

# --- fixed values: what a missing column is filled with ---------------------------------------

PLACEHOLDERS = {
    "timestamp": "2024-01-01",
    "customer_id": "default_customer",
    "recipient_entity": "default_recipient",
    "city": "default_city",
}

# --- fixed values: cities and their populations -----------------------------------------------

CITY_POPULATION = {
    "New York": 8_468_000,
    "Los Angeles": 3_849_000,
    "Chicago": 2_697_000,
    "Houston": 2_303_000,
    "Phoenix": 1_644_000,
    "Philadelphia": 1_576_000,
    "San Antonio": 1_472_000,
    "San Diego": 1_381_000,
    "Dallas": 1_289_000,
    "Austin": 974_000,
    "Jacksonville": 972_000,
    "Fort Worth": 956_000,
    "San Francisco": 808_000,
    "Columbus": 907_000,
    "Charlotte": 911_000,
    "Indianapolis": 880_000,
    "Seattle": 733_000,
    "Denver": 711_000,
    "Washington": 672_000,
    "Boston": 651_000,
}

# Cities of the older bank table.
BANK_CITIES = ["New York", "Chicago", "Los Angeles", "Houston", "Phoenix", "Seattle", "Boston"]

# --- fixed values: transaction types, their weights and amount ranges ------------------------

CARD = "Credit Card (POS/Online)"
ONLINE = "Online Purchase (Non-Card)"
WALLET = "Venmo/PayPal Transfer"
ACH = "Bank Transfer (ACH)"

TYPE_WEIGHT = {CARD: 0.60, ONLINE: 0.15, WALLET: 0.15, ACH: 0.10}

AMOUNT_RANGE = {
    CARD: (5.0, 200.0),
    ONLINE: (15.0, 500.0),
    WALLET: (10.0, 300.0),
    ACH: (50.0, 5000.0),
}

# Range of a type that is not in the table above.
OTHER_AMOUNT_RANGE = (1.0, 100.0)

# Entity types whose recipients are account numbers a person types in by hand.
TYPED_ENTITY_TYPES = ["Person-to-Person", "Friend/Family Transfer"]

# --- fixed values: recipients by transaction type and entity type ----------------------------

ENTITY_POOLS = {
    CARD: {
        "Grocery": ["SuperMart", "FreshFoods", "CornerMarket"],
        "Retail": ["FashionHub", "TechGadgets", "BookWorm", "HomeGoods"],
        "Restaurant": ["PizzaPalace", "SushiSpot", "CafeConnect", "BurgerJoint"],
        "Gas Station": ["SpeedyGas", "FuelStop"],
        "Online Service": ["StreamFlix", "CloudStoragePro", "FitnessApp"],
        "Travel": ["AirLink", "RoadTrips"],
        "Healthcare": ["MediCare Pharmacy", "Dr. Visit Co-pay"],
    },
    WALLET: {
        "Person-to-Person": [f"1{n:09d}" for n in range(100, 200)],
        "Small Business": ["Local Coffee Shop", "Freelance Designer", "Yoga Studio"],
    },
}

# Types a burst child can have.
BURST_CHILD_TYPES = [CARD, WALLET]

# --- fixed values: payment intensity by hour, weekday (Monday = 0) and day of month -----------

HOUR_INTENSITY = {
    0: 0.01, 1: 0.01, 2: 0.01, 3: 0.01, 4: 0.01, 5: 0.02, 6: 0.05, 7: 0.2,
    8: 0.5, 9: 0.8, 10: 1.0, 11: 1.2, 12: 1.5, 13: 1.8, 14: 1.2, 15: 1.0,
    16: 0.9, 17: 1.1, 18: 1.0, 19: 0.8, 20: 0.7, 21: 0.5, 22: 0.3, 23: 0.1,
}

WEEKDAY_INTENSITY = {0: 1.0, 1: 1.0, 2: 1.1, 3: 1.0, 4: 1.2, 5: 1.5, 6: 1.3}

MONTH_DAY_INTENSITY = {1: 1.8, 15: 1.5, 28: 1.2, 29: 1.2, 30: 1.2, 31: 1.2}

# --- fixed values: ranges the per-customer traits are drawn from ------------------------------

TRAIT_RANGE = {
    "burst": (0.02, 0.05),
    "high": (0.003, 0.008),
    "multiplier": (2.5, 4.0),
    "typo": (0.002, 0.005),
    "home": (0.75, 0.95),
}

BURST_MAX_CHILDREN = 3
BURST_GAP_SECONDS = (0.01, 5.0)
HIGH_AMOUNT_JITTER = (0.8, 1.2)
DIGIT_SHIFTS = [-3, -2, -1, 1, 2, 3]
ANOMALY_SHARE = 0.03

# --- fixed values: risk bands and the model's parameters --------------------------------------

HIGH_RISK = 0.8
MEDIUM_RISK = 0.6

TREES = 100
TREE_DEPTH = 6
LEARNING_RATE = 0.1
TEST_SHARE = 0.2
SEED = 42
