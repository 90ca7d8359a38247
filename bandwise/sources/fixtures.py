"""Fixture views over the driver tables (see FIXTURES.md §B).

Each view is built in Spark with DataFrame code and exists a second time as DuckDB SQL text, so
that the oracle in ``__spark_entry__.oracle_sql`` can rebuild exactly the same rows. The hash that
assigns folds and the fit/calibration part is the only expression that differs between engines.

Views
-----
obs      one row per event: id, y, fold, part, categorical and numeric columns with planted
         sentinel codes, HHMM time, interval code, two months, group key
preds    obs x 3 models: lo/mid/hi bounds around the per-category mean
binprob  (grp, bin, p): share of a group's rows in each of 10 value bins
shash    per event: four SHASH parameters and the observation on the transformed scale
zgrid    21 fixed standard-normal draws
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.sources.tables import read_table

# Columns of obs as SQL expressions over ``events``; H1 / H9 are the fold and part hashes.
_OBS_EXPRS = [
    "event_id as id",
    "value as y",
    "cast({H1} % 5 as int) as fold",
    "case when {H9} % 10 < 3 then 'cal' else 'fit' end as part",
    "event_type as cat",
    "case when event_id % 11 = 0 then '9' else event_type end as cat_raw",
    "case when event_id % 17 = 0 then cast(99 as double) else cast(user_id % 40 as double) end as num_raw",
    "cast(case when event_id % 23 = 0 then 9999 else hour(ts)*100+minute(ts) end as int) as hhmm",
    "cast(case when event_id % 7 = 0 then 888 when event_id % 13 = 0 then 999 else event_id % 300 end as int) as gap_raw",
    "cast(event_id % 12 + 1 as int) as m_end",
    "cast(case when event_id % 19 = 0 then 99 else user_id % 12 + 1 end as int) as m_start",
    "user_id as grp",
]

SPARK_HASH = "cast(conv(substr(md5(cast(event_id as string)),{a},8),16,10) as bigint)"
DUCK_HASH = "('0x'||substr(md5(cast(event_id as varchar)),{a},8))::bigint"

N_MODELS = 3  # fixture model ids 0, 1, 2
N_BINS = 10   # binprob bins 0..9, width 20
N_DRAWS = 21  # zgrid draws 0..20 on [-2, 2]


def _obs_exprs(hash_tpl: str) -> list[str]:
    h1, h9 = hash_tpl.format(a=1), hash_tpl.format(a=9)
    return [e.replace("{H1}", h1).replace("{H9}", h9) for e in _OBS_EXPRS]


# ----------------------------------------------------------------------------- Spark side

def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(*_obs_exprs(SPARK_HASH))


def preds_from(o: DataFrame, keep: Sequence[str] = ("id", "fold")) -> DataFrame:
    """Three fixed-width interval models around the per-category mean of y, with columns ``keep``.

    The per-category means form a table with one row per category, broadcast under its
    measured size (``join_small``), so the event rows are not shuffled; each event is tripled
    after that join, with the truth columns the caller wants to keep beside its predictions.
    """
    from bandwise.operators.joins import join_small

    q = o.groupBy("cat").agg(F.round(F.avg("y"), 6).alias("mid"))
    m = F.col("model_id").cast("double")
    return (
        join_small(o.select(*keep, "cat"), q, "cat")
        .withColumn("model_id", F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))))
        .select(
            *keep, "model_id",
            (F.col("mid") - (30 + 5 * m)).alias("lo"),
            F.col("mid").alias("mid"),
            (F.col("mid") + (60 + 10 * m)).alias("hi"),
        )
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preds_from(obs(spark, sf_dir))


def binprob_from(o: DataFrame) -> DataFrame:
    """Per-group bin shares: two partial aggregates and a join, no window over a group."""
    b = o.select("grp", F.least(F.lit(9), F.floor(F.col("y") / 20)).cast("int").alias("bin"))
    cnt = b.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"))
    tot = b.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return cnt.join(tot, "grp").select(
        "grp", "bin", (F.col("c").cast("double") / F.col("n")).alias("p")
    )


def binprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binprob_from(obs(spark, sf_dir))


def shash_from(o: DataFrame) -> DataFrame:
    return o.selectExpr(
        "id",
        "y/100 as y1",
        "0.3 + 0.01*cast(grp % 10 as double) as spread",
        "cast(id % 5 - 2 as double)/10 as skew",
        "0.95 + 0.02*cast(id % 6 as double) as tail",
        "0.35 + 0.01*cast(id % 7 as double) as center",
    )


def shash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shash_from(obs(spark, sf_dir))


def zgrid_draws(o: DataFrame) -> list[int]:
    """Draw ids of the zgrid view: distinct ``grp % 21`` (at most 21 values, so they are brought
    to the driver and used as a literal array; no join with the data)."""
    rows = o.select((F.col("grp") % N_DRAWS).cast("int").alias("d")).distinct().collect()
    return sorted(r["d"] for r in rows)


def zgrid_expr(draws=None):
    """The draw grid z = -2 + 4*draw/20 as a row-local array expression."""
    draws = list(range(N_DRAWS)) if draws is None else list(draws)
    return F.array(*[F.lit(-2.0 + 4.0 * d / float(N_DRAWS - 1)) for d in draws])


# ----------------------------------------------------------------------------- DuckDB side

_VIEW_SQL = {
    "obs": "select " + ",\n  ".join(_obs_exprs(DUCK_HASH)) + "\nfrom events",
    "preds": (
        "select o.id, o.fold, m.model_id, q.mid - (30 + 5*m.model_id) as lo, q.mid as mid,\n"
        "  q.mid + (60 + 10*m.model_id) as hi\n"
        "from obs o\n"
        "join (select cat, round(avg(y), 6) as mid from obs group by cat) q on o.cat = q.cat\n"
        "cross join (select 0 as model_id union all select 1 union all select 2) m"
    ),
    "binprob": (
        "select grp, bin, cast(count(*) as double) / max(n) as p\n"
        "from (select grp, cast(least(9, floor(y/20)) as int) as bin,\n"
        "        count(*) over (partition by grp) as n from obs) t\n"
        "group by grp, bin"
    ),
    "shash": (
        "select id, y/100 as y1, 0.3 + 0.01*cast(grp % 10 as double) as spread,\n"
        "  cast(id % 5 - 2 as double)/10 as skew, 0.95 + 0.02*cast(id % 6 as double) as tail,\n"
        "  0.35 + 0.01*cast(id % 7 as double) as center\n"
        "from obs"
    ),
    "zgrid": (
        "select draw, -2 + 4*cast(draw as double)/20 as z\n"
        "from (select distinct cast(grp % 21 as int) as draw from obs) t"
    ),
}
_DEPS = {"obs": [], "preds": ["obs"], "binprob": ["obs"], "shash": ["obs"], "zgrid": ["obs"]}


def duck_with(sql: str, *views: str, extra=()) -> str:
    """Prefix ``sql`` with the CTEs for ``views`` (dependencies first) and ``extra`` CTEs."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in _DEPS[v]:
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    parts = [f"{v} as (\n{_VIEW_SQL[v]}\n)" for v in order] + [e.strip() for e in extra]
    if not parts:
        return sql
    return "with " + ",\n".join(parts) + "\n" + sql
