"""Code prefixes and keyword banks."""

# Diagnosis code prefixes by code version.
CODE_PREFIXES = {
    9: ["200", "201", "202"],
    10: ["C81", "C82", "C83", "C84", "C85", "C96"],
}

# Variable name -> label keywords, bedside measurements.
VITALS = {
    "heart_rate": ["Heart Rate"],
    "resp_rate": ["Respiratory Rate"],
    "spo2": ["SpO2", "O2 saturation", "SaO2"],
    "temperature": ["Temperature Fahrenheit", "Temperature Celsius", "Temperature"],
    "sbp": ["Non Invasive Blood Pressure systolic", "Invasive BP Systolic", "Arterial Blood Pressure systolic"],
    "dbp": ["Non Invasive Blood Pressure diastolic", "Invasive BP Diastolic", "Arterial Blood Pressure diastolic"],
    "mbp": ["Non Invasive Blood Pressure mean", "Invasive BP Mean", "Arterial Blood Pressure mean"],
    "fio2": ["FiO2"],
    "peep": ["PEEP"],
}

# Variable name -> label keywords, laboratory measurements.
LABS = {
    "lactate": ["Lactate"],
    "ph": ["pH"],
    "paco2": ["pCO2"],
    "pao2": ["pO2"],
    "hco3": ["Bicarbonate"],
    "na": ["Sodium"],
    "k": ["Potassium"],
    "cl": ["Chloride"],
    "ca": ["Calcium"],
    "bun": ["Urea Nitrogen", "BUN"],
    "creatinine": ["Creatinine"],
    "ast": ["AST"],
    "alt": ["ALT"],
    "tbil": ["Bilirubin, Total", "Total Bilirubin"],
    "alb": ["Albumin"],
    "inr": ["INR"],
    "pt": ["PT"],
    "aptt": ["aPTT", "APTT"],
    "wbc": ["WBC"],
    "hgb": ["Hemoglobin"],
    "platelet": ["Platelet", "Platelets"],
}

# Event category -> name -> case-insensitive patterns over label, abbreviation and category.
EVENT_BANKS = {
    "vasopressors": {
        "norepinephrine": ["norepinephrine", "noradren", r"\bnorepi\b", r"\bnor-?epi\b"],
        "epinephrine": ["epinephrine", "adrenalin", r"\bepi\b", r"\bepine\b"],
        "vasopressin": ["vasopressin", r"\bvp\b", r"\bvaso\b"],
        "dopamine": ["dopamine", r"\bdopa\b"],
        "phenylephrine": ["phenylephrine", r"\bneo-?synephrine\b", r"\bneo\b", r"\bphenyl(e)?\b"],
    },
    "imv": {
        "vent_mode": [
            "vent", "ventilator", "mechanical ventilation", r"\bIMV\b", r"\bSIMV\b",
            "assist control", r"\bAC\b(?!\s*node)", "volume control", "pressure control",
            "pcv", "vcv", "aprv", "bilevel", r"\bpeep\b", r"\bfio?2\b",
            "endotracheal", r"\bett\b", "tracheostomy", "trach", "invasive ventilation",
        ],
    },
    "crrt": {
        "crrt": [
            r"\bcrrt\b", r"\bcvvh(d|df)?\b", "continuous veno-venous", "prisma", "prismaflex",
            "dialysis", "hemofiltration", "ultrafiltration", r"\bUF\b", "dialysate",
            "replacement fluid", "effluent", "hemodiafiltration",
        ],
    },
}

# Drug name pattern -> canonical name.
DRUG_NAMES = {
    "(?i)^(norepinephrine|noradrenaline|levophed|levo)$": "norepinephrine",
    "(?i)^(epinephrine|adrenaline)$": "epinephrine",
    "(?i)^(vasopressin|pitressin)$": "vasopressin",
    "(?i)^(phenylephrine|neosynephrine|neo-synephrine)$": "phenylephrine",
    "(?i)^dopamine$": "dopamine",
    "(?i)^dobutamine$": "dobutamine",
}

# What counts as a rise of a running drug.
UPGRADE_RELATIVE = 0.5
UPGRADE_ABSOLUTE = {
    "norepinephrine": 0.02,
    "epinephrine": 0.02,
    "phenylephrine": 25.0,
    "dopamine": 2.0,
    "vasopressin": 0.0005,
}
MIN_POSITIVE_RATE = {"vasopressin": 0.0001}

# Ventilation signals, strong and supportive.
VENT_STRONG = [
    "(?i)endotracheal intubation",
    "(?i)orotracheal intubation",
    "(?i)tracheal intubation",
    "(?i)mechanical ventilation start",
    "(?i)intubation",
    "(?i)^ventilator mode$",
    "(?i)assist.?control",
    "(?i)volume control",
    "(?i)pressure control",
    "(?i)SIMV",
    "(?i)PRVC",
    "(?i)AC/VC",
]
VENT_SUPPORTIVE = ["(?i)^fio2", "(?i)^peep", r"(?i)endotracheal|\bETT\b", "(?i)airway type", "(?i)tidal volume"]

# Renal replacement signals by source.
RENAL_PROCEDURE = [
    "(?i)CRRT",
    "(?i)CVVH(?!D|DF)",
    "(?i)CVVHD",
    "(?i)CVVHDF",
    "(?i)continuous veno.?venous",
    "(?i)renal replacement therapy",
    "(?i)prismaflex",
]
RENAL_INPUT = ["(?i)dialysate", "(?i)replacement fluid", "(?i)citrate", "(?i)anticoagulant.*citrate"]
RENAL_CHART = ["(?i)CRRT effluent rate", "(?i)ultrafiltration rate", "(?i)filter pressure"]

# Feature groups by name pattern, first match wins, the rest is "others".
FEATURE_GROUPS = {
    "vitals": r"^(heart_rate|resp_rate|sbp|dbp|mbp|spo2|temperature)",
    "labs": r"^(bun|creatinine|hgb|platelet|ca|cl|ph|pt)",
    "vent": r"^(peep)",
}

# Extra feature variables that are declared with the banks above.
OUTPUT_VARIABLES = ["urineoutput"]
INTERVENTION_VARIABLES = [
    "norepi_rate", "vasopressin_rate", "epi_rate", "dopa_rate", "phenyl_rate", "fio2", "peep", "is_mech_vent",
]
