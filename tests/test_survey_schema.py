"""The six preparation kinds on hand-written rows of the 36-column survey schema (FIXTURES §A)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise import constants as K
from bandwise.plans.prepare_kinds import KINDS, Preparer, survey_spec

# per column: a normal value and an alternative; sentinels are planted row by row below
_NORMAL = {
    "ATTEND": ("1", "2"), "BFACIL": ("1", "3"), "BMI": (24.5, 31.2), "CIG_0": (0, 5), "DLMP_MM": (3, 11),
    "DMAR": ("1", "2"), "DOB_MM": (12, 2), "DOB_TT": (930, 2359), "DOB_WK": (1, 7), "FAGECOMB": (30, 41),
    "FEDUC": ("3", "6"), "ILLB_R": (24, 2), "ILOP_R": (30, 2), "ILP_R": (24, 5), "LD_INDL": ("N", "Y"),
    "MAGER": (28, 35), "MBSTATE_REC": ("1", "2"), "MEDUC": ("4", "7"), "M_Ht_In": (64, 68),
    "NO_INFEC": ("1", "0"), "NO_MMORB": ("1", "0"), "NO_RISKS": ("1", "0"), "PAY": ("1", "2"),
    "PAY_REC": ("1", "2"), "PRECARE": (2, 4), "PREVIS": (12, 9), "PRIORDEAD": (0, 1), "PRIORLIVE": (1, 3),
    "PRIORTERM": (0, 2), "PWgt_R": (150, 190), "RDMETH_REC": ("1", "3"), "RESTATUS": ("1", "2"),
    "RF_CESAR": ("N", "Y"), "RF_CESARN": (0, 1), "SEX": ("F", "M"), "WTGAIN": (30, 12),
}


def _schema():
    fields = [T.StructField("id", T.LongType())]
    for c, kind, _ in K.SURVEY_COLUMNS:
        fields.append(T.StructField(c, T.StringType() if "categorical" in kind else T.DoubleType()))
    fields.append(T.StructField("DBWT", T.DoubleType()))
    return T.StructType(fields)


def _rows(n=24):
    rows = []
    codes = K.missing_codes()
    cols = [c for c, _, _ in K.SURVEY_COLUMNS]
    for i in range(n):
        r = {"id": i, "DBWT": 2500.0 + 37.0 * i}
        for j, c in enumerate(cols):
            a, b = _NORMAL[c]
            v = a if (i + j) % 3 else b
            if codes[c] and i == j % n:          # every sentinel appears at least once
                v = codes[c][0]
            if i == (j + 5) % n and c not in ("DOB_MM", "MAGER"):   # a raw null in each column
                v = None
            r[c] = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v is not None and \
                "categorical" not in dict((k, t) for k, t, _ in K.SURVEY_COLUMNS)[c] else v
        if i == 7:
            r["ILP_R"], r["ILOP_R"], r["ILLB_R"] = "888", "999", 888.0   # not applicable vs missing
        if i == 8:
            r["DOB_TT"] = 2400.0                                           # not a clock time
        if i == 9:
            r["DOB_TT"] = 0.0
        if i == 10:
            r["DBWT"] = (K.BIN_LABELS[40] + K.BIN_LABELS[41]) / 2         # target on a bin edge
        rows.append(r)
    return rows


@pytest.fixture(scope="module")
def survey(spark):
    return spark.createDataFrame(_rows(), _schema())


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_kind_prepares_survey_rows(spark, survey, kind):
    sp = survey_spec()
    train = survey.filter(F.col("id") < 18)
    test = survey.filter(F.col("id") >= 18).withColumn("SEX", F.when(F.col("id") == 20, "X").otherwise(F.col("SEX")))
    p = Preparer(kind, sp).fit(train)
    out = p.transform(test)
    feats = p.feature_columns(out)
    assert out.count() == 6 and "target" in out.columns and len(feats) > 20
    k = KINDS[kind]
    if k.impute:  # imputed kinds leave no null feature
        nulls = out.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in feats]).first()
        assert sum(nulls) == 0
    if k.encoding == "ordinal":  # unseen category -> null code, null input -> -1
        sex = {r["id"]: r["SEX"] for r in out.select("id", "SEX").collect()}
        assert sex[20] is None
    if k.encoding == "onehot_all" and "SEX__F" in out.columns:
        row = out.filter(F.col("id") == 20).select("SEX__F", "SEX__M").first()
        assert (row["SEX__F"], row["SEX__M"]) == (0.0, 0.0)  # unseen -> all zeros
    if k.target == "bin_index":
        assert out.agg(F.min("target"), F.max("target")).first()[0] >= 0


def test_interval_codes_and_time(spark, survey):
    sp = survey_spec()
    p = Preparer("histboost", sp).fit(survey)
    front = p._front(survey).filter(F.col("id").isin(7, 8, 9)).select("id", "ILP_R", "ILOP_R", "ILLB_R", "DOB_TT")
    rows = {r["id"]: r for r in front.collect()}
    assert rows[7]["ILP_R"] == "not applicable" and rows[7]["ILOP_R"] is None   # 888 kept, 999 -> null
    assert rows[8]["DOB_TT"] is None and rows[9]["DOB_TT"] == 0.0
