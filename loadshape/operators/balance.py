"""Covariate balance of matched samples and the love-plot table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape.session import materialize

SMD_THRESHOLD = 0.1


def balance_table(profiles: DataFrame, matches: DataFrame, control_profile: str = "own_adoption",
                  check_nonempty: bool = True) -> DataFrame:
    """``covariate, treated_mean, control_mean, SMD`` per profile feature.

    Treated = profiles of the treated ids in ``matches``; controls = one row
    per match edge (multiplicity kept). ``control_profile='own_adoption'``
    takes the control's own adoption-month profile (controls that never
    adopt have none and drop out, as in the study); ``'at_match'`` uses the
    features stored in the matches. SMD = (m_t - m_c) / sqrt((v_t + v_c)/2)
    with sample variances; missing values are skipped.

    The matches are read once: every unit comes out with its weight (the number
    of edges of a control, 1 for a treated unit), and the moments are weighted
    by it, so edges never meet the profiles.
    """
    if control_profile not in ("own_adoption", "at_match"):
        raise ValueError("control_profile must be 'own_adoption' or 'at_match'")
    feats = [c for c in profiles.columns if c not in ("id", "adoption_month")]
    at_match = control_profile == "at_match"
    values = feats if at_match else []

    def unit(treated: int, id_col: str):
        stored = [(F.lit(None) if treated else F.col(f)).cast("double").alias(f) for f in values]
        month = F.col("adoption_month") if at_match and not treated else F.lit(None)
        return F.struct(F.lit(treated).alias("_t"), F.col(id_col).alias("id"), month.cast("date").alias("_month"), *stored)

    units = matches.select(F.explode(F.array(unit(1, "treated_id"), unit(0, "control_id"))).alias("u")).select("u.*")
    # edges of one month and control carry the same features
    units = materialize(units.groupBy("_t", "id", "_month").agg(
        F.when(F.col("_t") == 1, 1).otherwise(F.count(F.lit(1))).cast("double").alias("_w"), *[F.min(f).alias(f) for f in values]))
    if check_nonempty and units.isEmpty():
        raise ValueError("matches is empty")
    both = units.select("_t", "_w", "id").where(F.lit(not at_match) | (F.col("_t") == 1)).join(profiles, "id").select("_t", "_w", *feats)
    if at_match:
        both = both.unionByName(units.where("_t = 0").select("_t", "_w", *feats))
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in feats)
    long = materialize(both.selectExpr("_t", "_w", f"stack({len(feats)}, {pairs}) AS (covariate, value)"))
    long = long.where(F.col("value").isNotNull())
    mean = long.groupBy("covariate", "_t").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("_mean"))
    # one row per covariate and side; squares about the mean, not of the values
    far = F.col("value") - F.col("_mean")
    side = long.join(F.broadcast(mean), ["covariate", "_t"]).groupBy("covariate", "_t").agg(
        F.first("_mean").alias("_mean"), F.try_divide(F.sum(F.col("_w") * far * far), F.sum("_w") - 1).alias("_var"))
    t, c = F.col("_t") == 1, F.col("_t") == 0
    found = side.groupBy("covariate").agg(
        F.max(F.when(t, F.col("_mean"))).alias("treated_mean"), F.max(F.when(c, F.col("_mean"))).alias("control_mean"),
        F.max(F.when(t, F.col("_var"))).alias("_vt"), F.max(F.when(c, F.col("_var"))).alias("_vc"))
    # a covariate without any value still has its row
    names = F.array(*[F.lit(f) for f in feats])
    g = profiles.sparkSession.range(1).select(F.explode(names).alias("covariate")).join(found, "covariate", "left")
    smd = F.try_divide(F.col("treated_mean") - F.col("control_mean"),
                       F.sqrt((F.col("_vt") + F.col("_vc")) / 2.0))
    return g.select("covariate", "treated_mean", "control_mean", smd.alias("SMD"))


def love_table(balance: DataFrame, threshold: float = SMD_THRESHOLD) -> DataFrame:
    """Covariates ordered by |SMD| with the imbalance flag."""
    return balance.select("covariate", F.abs("SMD").alias("abs_smd"),
                          (F.abs("SMD") > threshold).alias("imbalanced")) \
        .orderBy(F.col("abs_smd").desc(), "covariate")
