"""Fixed values. They must stay as they are for results to be comparable."""

# --- Fairness -------------------------------------------------------------

# Default threshold per built-in fairness metric, in report order.
FAIRNESS_THRESHOLDS = {
    "demographic_parity_ratio": 0.8,
    "demographic_parity_difference": 0.1,
    "equalized_odds_ratio": 0.8,
    "equalized_odds_difference": 0.1,
    "equal_opportunity_difference": 0.05,
    "disparate_impact_ratio": 0.8,
}

# Names a custom rule may use.
BASE_METRICS = (
    "accuracy_score",
    "precision_score",
    "recall_score",
    "f1_score",
    "selection_rate",
    "true_positive_rate",
    "false_positive_rate",
    "true_negative_rate",
    "false_negative_rate",
)
RULE_AGGREGATIONS = ("min_ratio", "max_difference")
RULE_COMPARISONS = (">=", "<=")
RULE_DEFAULT_THRESHOLD = 0.8

# --- Personal data --------------------------------------------------------

# Value patterns, tried in this order.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone_us": r"\b(\+?1[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "date_of_birth": r"\b(0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])[-/](19|20)\d{2}\b",
    "zip_code": r"\b[0-9]{5}(?:-[0-9]{4})?\b",
    "name_pattern": r"\b[A-Z][a-z]+\s[A-Z][a-z]+\b",
}

# Column-name tokens that mark personal data.
PII_COLUMN_TOKENS = (
    "email", "emails", "emailaddress", "emailaddresses",
    "phone", "telephone", "mobile", "cell", "phonenumber", "phonenumbers",
    "ssn", "socialsecurity", "socialsecuritynumber",
    "firstname", "lastname", "fullname", "middlename",
    "address", "street", "streetaddress", "homeaddress",
    "dob", "dateofbirth", "birthdate", "birthday",
    "creditcard", "cardnumber", "ccnumber",
    "ipaddress", "ipaddr",
    "passport", "passportnumber",
    "driverlicense", "licensenumber", "dlnumber",
)

# Column-name substrings used when requirements are elicited.
PII_NAME_SIGNALS = (
    "name", "email", "phone", "ssn", "social", "address", "zip", "postcode",
    "dob", "birth", "passport", "license", "credit", "card", "account",
    "ip", "mac", "gender", "race", "religion", "nationality", "ethnicity",
)

# The valid ZIP range and the PII decision limits.
ZIP_RANGE = (501, 99950)
PII_MATCH_RATE = 0.1
PII_UNIQUE_RATIO = 0.9
PII_NAME_CONFIDENCE = 0.9
PII_UNIQUE_CONFIDENCE = 0.6

# Date formats the datetime guard accepts besides ISO text.
DATE_FORMATS = (
    "yyyyMMdd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy", "M-d-yyyy",
    "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
)

# --- Health identifiers ---------------------------------------------------

# The 18 Safe Harbor categories as
# (id, label, column-name patterns, value patterns).
HIPAA_IDENTIFIERS = (
    ("names", "Names",
     (r"\bname\b", r"\bfirst.?name\b", r"\blast.?name\b", r"\bfull.?name\b", r"\bsurname\b", r"\binitial\b"),
     ()),
    ("dates", "Dates (except year)",
     (r"\bdate\b", r"\bbirth\b", r"\bdob\b", r"\badmission\b", r"\bdischarge\b", r"\bdeath\b",
      r"\bdate.?of.?birth\b"),
     (r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}", r"\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}")),
    ("geographic", "Geographic data smaller than state",
     (r"\baddress\b", r"\bstreet\b", r"\bcity\b", r"\bzip\b", r"\bpostal\b", r"\bcounty\b", r"\bgeocode\b",
      r"\blatitude\b", r"\blongitude\b", r"\blat\b", r"\blon\b", r"\blng\b"),
     (r"\b\d{5}(-\d{4})?\b",)),
    ("phone", "Phone numbers",
     (r"\bphone\b", r"\btelephone\b", r"\bmobile\b", r"\bcell\b", r"\btel\b"),
     (r"\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}",)),
    ("fax", "Fax numbers", (r"\bfax\b",), ()),
    ("email", "Email addresses",
     (r"\bemail\b", r"\be.?mail\b"),
     (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",)),
    ("ssn", "Social Security numbers",
     (r"\bssn\b", r"\bsocial.?security\b", r"\bss.?number\b"),
     (r"\b\d{3}[\-\s]?\d{2}[\-\s]?\d{4}\b",)),
    ("medical_record", "Medical record numbers",
     (r"\bmedical.?record\b", r"\bmrn\b", r"\bpatient.?id\b", r"\bmed.?rec\b"),
     ()),
    ("health_plan", "Health plan beneficiary numbers",
     (r"\bhealth.?plan\b", r"\binsurance.?id\b", r"\bpolicy.?number\b", r"\bmember.?id\b", r"\bbeneficiary\b"),
     ()),
    ("account", "Account numbers",
     (r"\baccount\b", r"\bacct\b", r"\bbank.?account\b"),
     ()),
    ("certificate_license", "Certificate/license numbers",
     (r"\bcertificate\b", r"\blicense\b", r"\blicence\b", r"\bpermit\b"),
     ()),
    ("vehicle", "Vehicle identifiers (VIN)",
     (r"\bvin\b", r"\bvehicle\b", r"\blicense.?plate\b", r"\bplate.?number\b"),
     (r"\b[A-HJ-NPR-Z0-9]{17}\b",)),
    ("device", "Device identifiers and serial numbers",
     (r"\bdevice.?id\b", r"\bserial\b", r"\bimei\b", r"\bmac.?address\b", r"\bhardware.?id\b"),
     (r"([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}",)),
    ("url", "Web URLs",
     (r"\burl\b", r"\bwebsite\b", r"\bweb.?address\b", r"\bhomepage\b"),
     (r"https?://[^\s]+",)),
    ("ip_address", "IP addresses",
     (r"\bip\b", r"\bip.?address\b", r"\bipv[46]\b"),
     (r"\b(?:\d{1,3}\.){3}\d{1,3}\b",)),
    ("biometric", "Biometric identifiers",
     (r"\bbiometric\b", r"\bfingerprint\b", r"\bvoice.?print\b", r"\bretina\b", r"\biris\b", r"\bfacial\b"),
     ()),
    ("photo", "Full face photographs",
     (r"\bphoto\b", r"\bimage\b", r"\bpicture\b", r"\bportrait\b", r"\bheadshot\b", r"\bface\b"),
     ()),
    ("unique_id", "Any other unique identifying number",
     (r"\bnational.?id\b", r"\bpassport\b", r"\btax.?id\b", r"\bein\b", r"\bdriver.?license\b"),
     ()),
)

# --- Privacy presets ------------------------------------------------------

# K and l per preset.
PRIVACY_PRESETS = {
    "basic": {"k": 5},
    "healthcare": {"k": 10, "l": 3},
    "financial": {"k": 5},
}

# --- Elicitation ----------------------------------------------------------

# Limits per mode.
ELICITATION_MODES = {
    "strict": {
        "imbalance_threshold": 0.2,
        "disparate_impact_threshold": 0.9,
        "dataset_feature_count_threshold": 10,
        "model_feature_count_threshold": 8,
        "prediction_imbalance_threshold": 0.2,
    },
    "normal": {
        "imbalance_threshold": 0.3,
        "disparate_impact_threshold": 0.8,
        "dataset_feature_count_threshold": 15,
        "model_feature_count_threshold": 10,
        "prediction_imbalance_threshold": 0.3,
    },
    "lenient": {
        "imbalance_threshold": 0.4,
        "disparate_impact_threshold": 0.7,
        "dataset_feature_count_threshold": 20,
        "model_feature_count_threshold": 14,
        "prediction_imbalance_threshold": 0.4,
    },
}

# Default rules per principle as (metric, operator, value).
DEFAULT_SPECS = {
    "fairness": (
        ("demographic_parity_ratio", ">=", 0.8),
        ("equalized_odds_ratio", ">=", 0.8),
        ("disparate_impact_ratio", ">=", 0.8),
    ),
    "transparency": (
        ("shap_explanation_coverage", ">=", 1.0),
        ("model_card_generated", "==", 1.0),
    ),
    "privacy": (
        ("k_anonymity_k", ">=", 5.0),
        ("pii_columns_detected", "==", 0.0),
    ),
    "accountability": (
        ("audit_trail_exists", "==", 1.0),
        ("mlflow_run_logged", "==", 1.0),
    ),
}

# Metrics a stored rule may name, per principle, and its operators.
SUPPORTED_RULE_METRICS = {
    "fairness": (
        "demographic_parity_ratio", "demographic_parity_difference",
        "equalized_odds_ratio", "equalized_odds_difference",
        "equal_opportunity_difference", "disparate_impact_ratio",
    ),
    "transparency": ("shap_explanation_coverage", "model_card_generated"),
    "privacy": ("pii_detection", "pii_columns_detected", "k_anonymity_k", "l_diversity_l"),
    "accountability": ("audit_trail_exists", "mlflow_run_logged"),
}
RULE_OPERATORS = (">=", "<=", ">", "<", "==")
PRINCIPLES = ("fairness", "transparency", "privacy", "accountability")

# --- Benchmark datasets ---------------------------------------------------

# Key, name, file, target, sensitive attributes, key features, domain, reference.
BENCHMARK_DATASETS = (
    ("compas", "COMPAS Recidivism", "compas-scores-raw.csv", "two_year_recid",
     ["race", "sex", "age_cat"], ["age", "priors_count", "c_charge_degree", "decile_score"],
     "criminal_justice", "ProPublica COMPAS Analysis (2016)"),
    ("adult_income", "Adult Income (Census)", "adult.csv", "income",
     ["sex", "race", "native-country"],
     ["age", "education", "occupation", "hours-per-week", "marital-status"],
     "employment", "UCI Machine Learning Repository"),
    ("german_credit", "German Credit", "german_credit_data.csv", "credit_risk",
     ["sex", "age", "foreign_worker"],
     ["duration", "credit_amount", "installment_rate", "property", "existing_credits"],
     "finance", "UCI Machine Learning Repository - Statlog German Credit"),
    ("bank_marketing", "Bank Marketing", "bank_marketing.csv", "y",
     ["age", "marital", "education"], ["job", "balance", "housing", "loan", "campaign"],
     "finance", "UCI Bank Marketing Dataset"),
    ("diabetes_readmission", "Diabetes Readmission", "diabetes_130_us_hospitals.csv", "readmitted",
     ["race", "gender", "age"],
     ["time_in_hospital", "num_lab_procedures", "num_medications", "number_diagnoses"],
     "healthcare", "UCI Diabetes 130-US Hospitals Dataset"),
)

# --- Template configuration -----------------------------------------------

# Metric names a template may use for each validator.
TEMPLATE_K_METRICS = ("k_anonymity", "k_anonymity_k", "k_value")
TEMPLATE_L_METRICS = ("l_diversity", "l_diversity_l", "l_value")
TEMPLATE_TRANSPARENCY_METRICS = ("shap_coverage", "model_card_completeness", "explanation_required")
DEFAULT_FAIRNESS_SELECTION = ("demographic_parity_ratio", "equalized_odds_ratio", "disparate_impact_ratio")
DEFAULT_PRIVACY_SELECTION = ("pii_detection", "k_anonymity")
