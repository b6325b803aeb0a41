"""Every list, label, pattern and threshold below has to equal the rate desk's own."""

from __future__ import annotations

# ---- statuses shown in the mapped file, and the short keys they are filtered by -------------------
MATCH = "✅ MATCH"
MULTIPLE = "⚠️ MULTIPLE MATCHES"
NO_MATCH = "❌ NO MATCH"
BAD_DATA = "FAILED - BAD DATA"
STATUS_KEYS = {MATCH: "MATCH", MULTIPLE: "MULTIPLE_MATCHES", NO_MATCH: "NO_MATCH", BAD_DATA: "BAD_DATA"}

# ---- thresholds -----------------------------------------------------------------------------------
INSURER_SCORE_MIN = 55
CATEGORY_RATIO_ABOVE = 75
PLAN_RATIO_MIN = 80
SPELLING_RATIO_MIN = 90
MODEL_SHARED_WORDS = 2
PI_PO_MARGIN = 7
STP_TARIFF_MAX = 100.01
ABOVE_25_LAKH = 2_500_000
CLUSTER_PREVIEW_ITEMS = 8
CLUSTER_PREVIEW_CHARS = 80
LOG_RETENTION_DAYS = 7
LIFE_MINIMUM_ROWS = 50

# ---- words that say nothing about which insurer is meant ------------------------------------------
INSURER_STOP_WORDS = ["general", "insurance", "company", "limited", "ltd", "co", "the", "of", "and", "an", "a", "in"]
FILE_NAME_STOP_WORDS = ["general", "insurance", "co", "company", "ltd", "limited", "the", "i"]
AMOUNT_NULL_WORDS = ["null", "nul", "nill", "na"]

# ---- sub products ---------------------------------------------------------------------------------
NEW_VEHICLE_SUB_PRODUCTS = ["1+3", "1+5"]
PACKAGE_SUB_PRODUCTS = ["1+1", "1+3", "1+5"]
WEIGHT_RATED_PRODUCTS = ["gcv 3w", "gcv 4w"]
OD_PREMIUM_SUB_PRODUCTS = ["1+1", "1+3", "saod"]

# ---- rate types -----------------------------------------------------------------------------------
ON_NET, ON_OD, ON_TP, ON_OD_TP = "On Net", "On OD", "On TP", "On OD and TP"
HEALTH_RATE_TYPE = "ON Net 1 Year"
PI_RATE_FIELDS = [
    "pi_od_rate", "pi_tp_rate", "pi_tp_2", "pi_tp_3", "pi_tp_4", "pi_tp_5", "pi_net_rate", "pi_flat_amount", "pi_vli",
]
PI_TYPE_FIELDS = {
    ON_NET: ["pi_net_rate"],
    ON_OD: ["pi_od_rate"],
    ON_TP: ["pi_tp_rate"],
    ON_OD_TP: ["pi_od_rate", "pi_tp_rate"],
}
RATE_FIELDS_2DP = PI_RATE_FIELDS + ["po_od_rate", "po_tp_rate", "po_net_rate", "po_flat_amount"]
TENURE_RATES = ["one_year_rate", "multi_year_2_rate", "multi_year_3_rate", "multi_year_4_rate", "multi_year_5_rate"]

# ---- vehicle classes a product stands for when its class is NA ------------------------------------
PRODUCT_CLASSES = {
    "TW": "Scooter, Bike",
    "PRIVATE CAR": "Car",
    "GCV 4W": "Truck, Pick Up Van, Dumper Tipper, Trailer, Tanker, Goods Carrying Tractor",
    "GCV 3W": "Goods Carrying Rickshaw",
    "PCV 3W": "Passenger Carrying Rickshaw",
    "PCV 4W": "Taxi, School Bus, Other Bus",
    "MISCD": "MISCD-Tractor, MISCD-Others",
    "PCV 2W": "PCV 2W",
}

# ---- calendar and state codes ---------------------------------------------------------------------
MONTH_NAMES = {
    "JAN": "January", "FEB": "February", "MAR": "March", "APR": "April", "MAY": "May", "JUN": "June",
    "JUL": "July", "AUG": "August", "SEP": "September", "OCT": "October", "NOV": "November", "DEC": "December",
}
EVERGREEN = "EVERGREEN"
STATE_ALIASES = {"TG": "TS", "OR": "OD", "GC": "CG"}

# ---- health business types that mean the same -----------------------------------------------------
BUSINESS_TYPE_SYNONYMS = {"rollover": "port", "roll over": "port", "portability": "port", "port": "port"}

# ---- wording of the failure texts -----------------------------------------------------------------
FAILED_ON = "Failed on: "
ALSO_FAILED_ON = "Also failed on: "
SEGMENT_SEPARATOR = " | "
MAKE_MODEL_LABEL = "Policy: vehicle make / model"
UNRESOLVED_MAKE_PREFIX = "Vehicle make/model '"
UNRESOLVED_MAKE_SUFFIX = "' did not share at least "
REGISTRATION_LABEL = "Policy: date of registration"
INCEPTION_LABEL = "Policy: inception date"
CC_LABEL = "Policy: cc cubic capacity"
GVW_LABEL = "Policy: gvw gross vehicle weight"
TOTAL_OD_LABEL = "Policy: total od"
TP_PREMIUM_LABEL = "Policy: tp premium"
NCB_LABEL = "Policy: no claim bonus"
VALIDATION_PREFIX = "Validation error — "
VALIDATION_SUFFIX = " Correct the source MIS data and re-run mapping for this row."

# ---- policy-file columns the rules read, in the order a failed row lists them ---------------------
POLICY_FILE_COLUMNS = {
    "insurer": "Policy: insurance company",
    "vehproduct": "Policy: vehproduct",
    "sub_product": "Policy: sub product",
    "fuel": "Policy: fuel",
    "vehicle_class": "Policy: vehicle class",
    "cc": "Policy: cc cubic capacity",
    "gvw": "Policy: gvw gross vehicle weight",
    "seating": "Policy: seating capacity",
    "registration": "Policy: date of registration",
    "tariff": "Policy: tariff rate",
    "inception": "Policy: inception date",
    "make": "Policy: vehicle make",
    "model": "Policy: model",
    "rto": "Policy: rto no",
    "ncb": "Policy: no claim bonus",
    "cpa": "Policy: cpa",
    "nil_dep": "Policy: nil dep",
    "product_name": "Policy: product name",
    "policy_category": "Policy: policy category",
    "policy_type": "Policy Type",
    "plan_name": "Policy: plan name",
    "deductible": "Policy: deductible amount",
    "sum_assured": "Policy: sum assured",
    "age": "Customer: age",
    "pin_code": "Customer: pin code",
    "expiry": "Policy: expiry date",
    "total_od": "Policy: total od",
    "tp_premium": "Policy: tp premium",
}
PREMIUM_FILE_COLUMNS = {
    "product": "Product",
    "gwp_net": "Policy: gwp net premium",
    "tp_terrorism": "Policy: tp terrorism premium",
}
SUMMARY_KEYS = ["vehicle make", "model", "policy type", "sub product"]
GAP_SHOWN_CHARS = 60
ALL_IDS_COLUMN = "Matching Group IDs"
SUMMARY_LIMIT = 3

# ---- axes of a conflict and their labels, and the note of a double-rate risk (fixed values) --------
CONFLICT_CATEGORIES = {"product": "Product", "sub_product": "Sub Product", "fuel_type": "Fuel Type"}
CONFLICT_CODES = {"is_ncb": "NCB", "is_cpa": "CPA", "is_zd": "Nil Dep"}
CONFLICT_NUMERIC = {
    ("cc_min", "cc_max"): "CC", ("sc_min", "sc_max"): "Seating Capacity",
    ("vehicle_age_min", "vehicle_age_max"): "Vehicle Age", ("tariff_min", "tariff_max"): "Tariff",
}
CONFLICT_DATES = {("from_date", "to_date"): "Validity"}
CONFLICT_LISTS = {"new_vehicle_makes": "Vehicle Make Cluster", "new_rto_list": "RTO Cluster"}
RISK_NOTE = (
    "These reference different clusters, but a raw code is duplicated across both clusters' entries in RTOMaster / "
    "MakeModelMaster — fix the master table entry (or point one group at a cluster that doesn't share the code), "
    "rather than deactivating either group."
)

# ---- conflict types, most actionable first, and how many pairs of each a scan stores --------------
CONFLICT_SEVERITY = {
    "DOUBLE_RATE_RISK": 1, "EXACT_DUPLICATE": 2, "CONTAINED": 3, "OPEN_ENDED": 4, "PARTIAL": 5,
}
CONFLICT_CAPS = {
    "DOUBLE_RATE_RISK": 20000, "EXACT_DUPLICATE": 20000, "CONTAINED": 20000, "OPEN_ENDED": 20000, "PARTIAL": 2000,
}
PLACEHOLDER_CODES = ["0"]

# ---- log actions ----------------------------------------------------------------------------------
POINTS_SEARCH_ACTIONS = ["MOTOR_POINTS_SEARCH", "HEALTH_POINTS_SEARCH"]
SECURITY_ACTIONS = ["MANUAL EDIT", "BULK UPDATE", "HEALTH RATE EDIT", "HEALTH BULK UPDATE", "OVERLAP DEACTIVATE"]

# ---- fields that make two rate rows the same group, the same content, or the same health rule -----
GROUP_FIELDS = [
    "new_vehicle_makes", "insurer_vertical", "insurance_company", "product", "sub_product", "policy_type",
    "vehicle_age_min", "vehicle_age_max", "make_model_class", "fuel_type", "pi_od_rate", "pi_tp_rate", "pi_tp_2",
    "pi_tp_3", "pi_tp_4", "pi_tp_5", "pi_net_rate", "pi_flat_amount", "pi_vli", "pi_type", "tariff_min", "tariff_max",
    "is_ncb", "is_cpa", "cc_min", "cc_max", "is_zd", "from_date", "to_date", "sc_min", "sc_max", "add_tnc", "status",
    "is_deleted", "upload_batch",
]
CONTENT_FIELDS = [
    "new_vehicle_makes", "new_rto_list", "insurer_vertical", "insurance_company", "product", "sub_product",
    "policy_type", "fuel_type", "make_model_class", "status", "vehicle_age_min", "vehicle_age_max", "pi_od_rate",
    "pi_tp_rate", "pi_tp_2", "pi_tp_3", "pi_tp_4", "pi_tp_5", "pi_net_rate", "pi_flat_amount", "pi_vli", "pi_type",
    "tariff_min", "tariff_max", "is_ncb", "is_cpa", "is_zd", "cc_min", "cc_max", "from_date", "to_date", "user_id",
    "sc_min", "sc_max", "veh_use", "add_tnc", "remarks", "po_type", "po_od_rate", "po_tp_rate", "po_net_rate",
    "po_flat_amount",
]
LIVE_CONTENT_FIELDS = [
    "insurance_company", "insurer_vertical", "new_vehicle_makes", "new_rto_list", "product", "sub_product",
    "policy_type", "fuel_type", "make_model_class", "vehicle_age_min", "vehicle_age_max", "pi_od_rate", "pi_tp_rate",
    "pi_tp_2", "pi_tp_3", "pi_tp_4", "pi_tp_5", "pi_net_rate", "pi_flat_amount", "pi_vli", "pi_type", "tariff_min",
    "tariff_max", "is_ncb", "is_cpa", "is_zd", "cc_min", "cc_max", "from_date", "to_date", "sc_min", "sc_max",
    "add_tnc",
]
HEALTH_HASH_FIELDS = [
    "insurance_company", "product_name", "policy_category", "plan_names", "business_type", "min_deductible",
    "max_deductible", "min_sum_insured", "max_sum_insured", "min_age", "max_age", "pincode_zone", "from_date",
    "to_date",
]

# ---- life grid ------------------------------------------------------------------------------------
LIFE_TYPE_KEYWORDS = [
    ("tulip", "TULIP"), ("ulip", "ULIP"), ("annuity", "Annuity"), ("pension", "Pension"), ("term", "Term"),
    ("non par", "Non-Par"), ("non-par", "Non-Par"), ("non- par", "Non-Par"), ("par", "Par"),
    ("protection", "Protection"), ("trad", "Traditional / Investment"),
]
RENEWAL_SLOTS = ["Renewal_Yr2", "Renewal_Yr3", "Renewal_Yr4", "Renewal_Yr5", "Renewal_Yr6_Plus"]
RENEWAL_YEAR_PATTERNS = [
    r"(?:year|yr)\.?\s*-?\s*(\d+)",
    r"at\s*(\d+)(?:st|nd|rd|th)?\s*year",
    r"\b(\d+)\s*(?:st|nd|rd|th)\s*year",
]
RENEWAL_RANGE_PATTERN = r"(?:year|yr)\.?\s*-?\s*(\d+)\s*to\s*(\d+)"
RENEWAL_ALSO_PATTERN = r"(?:&|and|,)\s*(\d+)"
RENEWAL_OPEN_PATTERN = r"onwards|above|beyond|\+"
PPT_PATTERN = r"(?i)(\d+\s*-\s*\d+|\d+\s*&\s*\d+|\d+\s*to\s*\d+|\d+\+?|SP|RP)\s*Pay\s*>?"
