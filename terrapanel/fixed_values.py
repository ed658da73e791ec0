"""Fixed values that results must agree on.

FIXED VALUES — these constants define the meaning of the outputs (month and
season codes, the state season calendar, crop varieties, thresholds and advice
texts).  They are data, stated plainly in their natural order; every function
that uses them accepts a replacement as an argument.
"""

# ---------------------------------------------------------------- FIXED VALUES
MONTH_ABBR = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN",
              "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# season name (upper case, '_' read as ' ') -> season number
SEASON_CODES = {
    "WINTER": 1,
    "SUMMER": 2,
    "MONSOON": 3,
    "POST MONSOON": 4,
    "POST-MONSOON": 4,
    "POSTMONSOON": 4,
}

# month-only season used when no state calendar is supplied
# (12,1,2 winter; 3-5 summer; 6-9 monsoon; otherwise post-monsoon)
MONTH_ONLY_SEASON = {12: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 3, 7: 3, 8: 3, 9: 3}
MONTH_ONLY_SEASON_DEFAULT = 4

SEASON_NAMES = ["Winter", "Summer", "Monsoon", "Post-monsoon"]
UNKNOWN_SEASON = "Unknown"

# state -> season -> months
STATE_SEASON_CALENDAR = {
    "ANDHRA PRADESH": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "TELANGANA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "TAMILNADU": {"Winter": ["JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV", "DEC"]},
    "KARNATAKA": {"Winter": ["JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV", "DEC"]},
    "KERALA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "LAKSHDWEEP": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "PONDICHERRY": {"Winter": ["JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV", "DEC"]},
    "DELHI": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "PUNJAB": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "HARYANA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "HIMACHAL PRADESH": {"Winter": ["NOV", "DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT"]},
    "UTTARAKHAND": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "UTTAR PRADESH": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "JAMMU & KASHMIR": {"Winter": ["NOV", "DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT"]},
    "LADAKH": {"Winter": ["OCT", "NOV", "DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG"], "Post-monsoon": ["SEP"]},
    "CHANDIGARH": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "WEST BENGAL": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "BIHAR": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "JHARKHAND": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "ODISHA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "GUJARAT": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "RAJASTHAN": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "MAHARASHTRA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "GOA": {"Winter": ["DEC", "JAN"], "Summer": ["FEB", "MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "DADRA AND NAGAR HAV": {"Winter": ["DEC", "JAN"], "Summer": ["FEB", "MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "DAMAN & DIU": {"Winter": ["DEC", "JAN"], "Summer": ["FEB", "MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "MADHYA PRADESH": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "CHHATTISGARH": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"], "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "ASSAM": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP", "OCT"], "Post-monsoon": ["NOV"]},
    "ARUNACHAL PRADESH": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "MANIPUR": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP", "OCT"], "Post-monsoon": ["NOV"]},
    "MEGHALAYA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP", "OCT"], "Post-monsoon": ["NOV"]},
    "MIZORAM": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP", "OCT"], "Post-monsoon": ["NOV"]},
    "NAGALAND": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP", "OCT"], "Post-monsoon": ["NOV"]},
    "SIKKIM": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "TRIPURA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP", "OCT"], "Post-monsoon": ["NOV"]},
    "ANDAMAN & NICOBAR": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"], "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP", "OCT"], "Post-monsoon": ["NOV"]},
}

# state -> example crop varieties; DEFAULT when the state is not listed
STATE_VARIETIES = {
    "RAJASTHAN": ["Pearl millet (bajra) — local hybrids", "Kodo/little millets (local)"],
    "GUJARAT": ["Pearl millet (bajra) hybrids", "Sorghum (local hybrids)"],
    "MAHARASHTRA": ["Sorghum (jowar) hybrids", "Pearl millet (bajra) hybrids"],
    "KARNATAKA": ["Finger millet (ragi) varieties", "Sorghum (jowar)"],
    "TELANGANA": ["Sorghum (jowar) hybrids", "Pearl millet hybrids"],
    "ANDHRA PRADESH": ["Sorghum, pearl millet hybrids"],
    "HARYANA": ["Pearl millet (bajra) hybrids"],
    "UTTAR PRADESH": ["Pearl millet (bajra) in drier zones"],
    "ODISHA": ["Finger millet (ragi) varieties", "Small millets"],
    "CHHATTISGARH": ["Small millets", "Sorghum"],
    "MADHYA PRADESH": ["Sorghum, pearl millet, small millets"],
    "TAMIL NADU": ["Finger millet (ragi) varieties"],
    "DEFAULT": ["Pearl millet (bajra) hybrids", "Sorghum (jowar) hybrids", "Finger millet (ragi) varieties"],
}

# moisture group cut-offs: < 4 very_low, < 8 low_moderate, < 12 moderate_high, else high
MOISTURE_GROUP_CUTS = [(4.0, "very_low"), (8.0, "low_moderate"), (12.0, "moderate_high")]
MOISTURE_GROUP_TOP = "high"

# crop label and explanation per moisture group; "{v}" = first two varieties joined by ", "
CROP_ADVICE = {
    "very_low": ("Drought-tolerant millets",
                 "{v} — recommended in very low soil moisture conditions."),
    "low_moderate": ("Moderate-moisture crops / millets",
                     "{v}; consider pulses and oilseeds where local practice supports them."),
    "moderate_high": ("Moderate–high moisture crops",
                      "{v}; if irrigation available consider higher-value crops but millets remain safe."),
    "high": ("High moisture crops possible",
             "Conditions may support higher-water crops (paddy/sugarcane) if irrigation is available; "
             "millets/sorghum still safe where rain uncertain."),
}

IRRIGATION_ADVICE = {
    "Severe": "Irrigate urgently",
    "Moderate": "Consider irrigation soon",
    "None": "No immediate irrigation required",
}

STRESS_TEXT = {
    "Severe": "⚠️ Severe water stress likely",
    "Moderate": "⚠️ Moderate water stress likely",
    "None": "No severe water stress predicted",
}

MANUAL_LOW_THRESHOLD = 5.0
MANUAL_HIGH_THRESHOLD = 10.0
STRESS_FALLBACK_RATIO = 0.7
STRESS_MODERATE_DROP = 0.30
AUTO_LOW_PCT = 25
AUTO_HIGH_PCT = 75
UNCERTAINTY_FLOOR = 0.1
UNCERTAINTY_RATIO = 0.3
VOLATILITY_MEAN_FLOOR = 0.1
VOLATILITY_HIGH = 0.5
VOLATILITY_MODERATE = 0.3
SUMMARY_SEPARATOR = " • "
CONFIDENCE_THRESHOLD_PCT = 50.0
CLASS_WEIGHT_EPS = 1e-6

# year-based split of the original data
TRAIN_YEAR = 2018
TEST_YEAR = 2020

# model feature vector, in order
FEATURES = ["Month_num", "month_sin", "month_cos", "Season_num", "state_freq",
            "district_id", "lag_1", "lag_7", "rolling_3", "rolling_6"]
PRIOR_FEATURES = ["state_freq", "district_id", "lag_1", "lag_7", "rolling_3", "rolling_6"]

# class labels of the tercile moisture class
TERCILE_LABELS = ["Low", "Medium", "High"]
# ---------------------------------------------------------------- /FIXED VALUES
