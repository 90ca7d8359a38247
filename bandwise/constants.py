"""Fixed values that must equal the modelled survey data's conventions.

FIXED VALUES (kept as plain text, natural order):
- target scaling: mean 3260, standard deviation 590, softplus scale 1000
- column kinds and missing codes of the 36 survey features
- extra code 888 means "not applicable" for the three interval columns
- the 103 bin labels of the binned-density model (grams)
"""

from __future__ import annotations

# ---- FIXED VALUES: target transforms
Y_MEAN = 3260.0
Y_SD = 590.0
SOFTPLUS_SCALE = 1000.0

# ---- FIXED VALUES: column kind and missing code of each survey feature (name, kind, code)
SURVEY_COLUMNS = [
    ("ATTEND", "categorical", "9"),
    ("BFACIL", "categorical", "9"),
    ("BMI", "continuous", 99.9),
    ("CIG_0", "integer", 99),
    ("DLMP_MM", "integer (cyclic)", 99),
    ("DMAR", "categorical", " "),
    ("DOB_MM", "integer (cyclic)", None),
    ("DOB_TT", "timestamp (cyclic)", 9999),
    ("DOB_WK", "integer (cyclic)", None),
    ("FAGECOMB", "integer", 99),
    ("FEDUC", "categorical (ordinal)", "9"),
    ("ILLB_R", "integer", 999),
    ("ILOP_R", "categorical", "999"),
    ("ILP_R", "categorical", "999"),
    ("LD_INDL", "categorical", None),
    ("MAGER", "integer", None),
    ("MBSTATE_REC", "categorical", "3"),
    ("MEDUC", "categorical (ordinal)", "9"),
    ("M_Ht_In", "integer", 99),
    ("NO_INFEC", "categorical", "9"),
    ("NO_MMORB", "categorical", "9"),
    ("NO_RISKS", "categorical", "9"),
    ("PAY", "categorical", "9"),
    ("PAY_REC", "categorical", "9"),
    ("PRECARE", "integer", 99),
    ("PREVIS", "integer", 99),
    ("PRIORDEAD", "integer", 99),
    ("PRIORLIVE", "integer", 99),
    ("PRIORTERM", "integer", 99),
    ("PWgt_R", "continuous", 999),
    ("RDMETH_REC", "categorical", "9"),
    ("RESTATUS", "categorical", None),
    ("RF_CESAR", "categorical", "U"),
    ("RF_CESARN", "integer", 99),
    ("SEX", "categorical", None),
    ("WTGAIN", "continuous", 99),
]
NOT_APPLICABLE_CODE = 888
LOG_SHIFT_COLUMNS = ["CIG_0", "PRIORDEAD", "PRIORLIVE", "PRIORTERM", "RF_CESARN", "ILLB_R"]
TIME_COLUMN = "DOB_TT"

# ---- FIXED VALUES: bin labels of the binned-density model, ascending
BIN_LABELS = [
    227.0, 700.0, 1250.0, 1750.0, 2005.0, 2155.0, 2270.0, 2360.0, 2430.0, 2495.0,
    2545.0, 2580.0, 2627.0, 2665.0, 2693.0, 2722.0, 2750.0, 2778.0, 2806.0, 2830.0,
    2850.0, 2868.0, 2892.0, 2913.0, 2925.0, 2948.0, 2965.0, 2977.0, 3000.0, 3010.0,
    3030.0, 3040.0, 3060.0, 3070.0, 3090.0, 3095.0, 3117.0, 3120.0, 3140.0, 3150.0,
    3170.0, 3175.0, 3190.0, 3204.0, 3215.0, 3231.0, 3240.0, 3258.0, 3260.0, 3280.0,
    3289.0, 3300.0, 3316.0, 3320.0, 3340.0, 3345.0, 3360.0, 3374.0, 3380.0, 3400.0,
    3405.0, 3420.0, 3430.0, 3446.0, 3459.0, 3470.0, 3487.0, 3495.0, 3515.0, 3520.0,
    3540.0, 3550.0, 3570.0, 3575.0, 3600.0, 3609.0, 3629.0, 3640.0, 3657.0, 3675.0,
    3690.0, 3711.0, 3725.0, 3742.0, 3770.0, 3785.0, 3800.0, 3827.0, 3850.0, 3875.0,
    3900.0, 3930.0, 3960.0, 3991.52, 4026.0, 4070.0, 4115.0, 4170.0, 4250.0, 4338.0,
    4495.0, 5000.0, 6000.0,
]


def categorical_columns() -> list[str]:
    return sorted(c for c, kind, _ in SURVEY_COLUMNS if "categorical" in kind)


def numeric_columns() -> list[str]:
    return sorted(c for c, kind, _ in SURVEY_COLUMNS if "categorical" not in kind)


def missing_codes() -> dict[str, list]:
    return {c: ([] if code is None else [code]) for c, _, code in SURVEY_COLUMNS}
