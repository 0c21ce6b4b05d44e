"""From measured fits to verdicts, as ordered column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chance_rate(n: Column, span: Column, tol: float = 0.35) -> Column:
    """Share of moments that n others hit by accident over a span."""
    return F.when(span.isNull() | (span <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.lit(2 * tol) * n / span))


def noise_floor(chance: Column, n: Column, z: float = 4.0) -> Column:
    spread = F.sqrt(F.greatest(chance * (1 - chance), F.lit(0.0)) / n)
    return F.when((n <= 0) | chance.isNull() | (chance <= 0), 1.0).otherwise(F.least(F.lit(1.0), chance + z * spread))


def measurable(score: Column, chance: Column, n_ref: Column, n_sub: Column, min_cues: int = 5) -> Column:
    n = F.least(n_ref, n_sub)
    return (n >= min_cues) & (score > noise_floor(chance, n))


def excess(score: Column, chance: Column, n_ref: Column, n_sub: Column) -> Column:
    """How many times chance; zero where it can't be told from chance."""
    return F.when(measurable(score, chance, n_ref, n_sub) & (chance > 0), score / chance).otherwise(0.0)


def band(x: Column, coheres: Column | None = None, accept_at: float = 2.5, refuse_below: float = 1.5) -> Column:
    held = F.coalesce(coheres, F.lit(False)) if coheres is not None else F.lit(False)
    return F.when(x >= accept_at, "accept").when(x < refuse_below, "refuse").when(held, "accept").otherwise("escalate")


def speech_band(x: Column, accept_at: float = 2.2, refuse_below: float = 2.0) -> Column:
    return band(x, None, accept_at, refuse_below)


def word(x: Column) -> Column:
    return F.when(x >= 4.0, "locked").when(x >= 3.0, "strong").when(x >= 2.5, "fair").otherwise("uncertain")


def runtime_check(failing: Column, usable: Column) -> Column:
    """failed, or held, weak or absent by the number of buckets that could be checked."""
    return F.when(failing > 0, "failed").when(usable == 0, "absent").when(usable < 2, "weak").otherwise("held")


def judge(fits: DataFrame, speech: bool = False) -> DataFrame:
    """``outcome, band, word`` of fits.

    Columns: score, chance, n_ref, n_sub, failing, usable, and of the cluster
    coheres and agrees; with ``speech`` also witness (boolean).
    """
    x = excess(F.col("score"), F.col("chance"), F.col("n_ref"), F.col("n_sub"))
    thin = F.least("n_ref", "n_sub") < 5
    vouch = F.col("agrees") & F.col("coheres")
    b = speech_band(x) if speech else band(x, vouch)
    refuse = ~measurable(F.col("score"), F.col("chance"), F.col("n_ref"), F.col("n_sub")) | (F.col("failing") > 0)
    f = fits.withColumn("excess", x).withColumn("runtime_check", runtime_check(F.col("failing"), F.col("usable")))
    f = f.withColumn("band", F.when(thin, "error").when(refuse, "refuse").otherwise(b))
    if speech:
        f = f.withColumn("band", F.when((F.col("band") == "accept") & ~F.coalesce(F.col("witness"), F.lit(False)), "escalate").otherwise(F.col("band")))
        w = F.lit("fair")
    else:
        lifted = vouch & (F.col("excess") < 2.5)
        w = F.when(lifted, "uncertain").otherwise(word(F.col("excess")))
        w = F.when((F.col("runtime_check") == "absent") & w.isin("locked", "strong"), "fair").otherwise(w)
    outcome = F.when(F.col("band") == "error", "ERROR").when(F.col("band") == "accept", "CONFIDENT").otherwise("REFUSED")
    return f.withColumn("outcome", outcome).withColumn("word", F.when(F.col("outcome") == "CONFIDENT", w))


def decide(outcome: Column, force: bool = False) -> Column:
    """Force overrides a refusal, never an error or a missing verdict."""
    return F.when(outcome == "CONFIDENT", "write").when((outcome == "REFUSED") & F.lit(force), "write_forced").when(outcome == "REFUSED", "refuse").otherwise("fault")


def diagnose(failing: DataFrame, keys: list[str], width: float = 120.0, min_break: float = 1.0, max_break: float = 60.0, max_drift: float = 0.75) -> DataFrame:
    """Why buckets fail: ``lo, hi, jump, shape`` per pair of (t0, jump) rows.

    drift: three or more, strictly monotonic, spread beyond ``max_drift``; cut:
    adjoining buckets that all jump as far as a break does; else local.
    """
    w = Window.partitionBy(*keys).orderBy("t0")
    f = failing.select(
        *keys, "t0", "jump", (F.row_number().over(w) - 1).alias("i"), (F.col("t0") - F.lag("t0").over(w)).alias("gap"), (F.col("jump") - F.lag("jump").over(w)).alias("step")
    )
    last = F.max_by("jump", "t0")
    g = f.groupBy(*keys).agg(
        F.min("t0").alias("lo"), (F.max("t0") + width).alias("hi"), F.count("*").alias("n"), last.alias("last"), F.min_by("jump", "t0").alias("first"),
        F.coalesce(F.bool_and(F.abs(F.col("gap") - width) < 1e-6), F.lit(True)).alias("joined"),
        (F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)) | F.coalesce(F.bool_and(F.col("step") < 0), F.lit(True))).alias("monotonic"),
        F.bool_and(F.abs("jump").between(min_break, max_break)).alias("sized"),
        F.array_sort(F.collect_list(F.struct("i", "jump"))).alias("rows"),
    )
    drift = (F.col("n") >= 3) & F.col("monotonic") & (F.abs(F.col("last") - F.col("first")) > max_drift)
    middle = F.element_at("rows", (F.floor(F.col("n") / 2) + 1).cast("int"))["jump"]
    return g.select(
        *keys, "lo", "hi", F.when(drift, F.col("last")).otherwise(middle).alias("jump"),
        F.when(drift, "drift").when(F.col("joined") & F.col("sized"), "cut").otherwise("local").alias("shape"),
    )


def stretches(failing: DataFrame, keys: list[str], width: float = 120.0) -> DataFrame:
    """Adjoining buckets merged into (lo, hi) stretches: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy("t0")
    new = F.coalesce((F.abs(F.col("t0") - F.lag("t0").over(w) - width) >= 1e-6).cast("int"), F.lit(1))
    f = failing.select(*keys, "t0", new.alias("new")).withColumn("island", F.sum("new").over(w))
    return f.groupBy(*keys, "island").agg(F.min("t0").alias("lo"), (F.max("t0") + width).alias("hi")).drop("island")
