"""Score summaries of structures and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles, stepped_quantile


def score_summary(df: DataFrame, by: list[str], value: str, preferred: Column | None = None, hot: int | None = None) -> DataFrame:
    """mean, median, p10, min, max and n_values of ``value``; of the preferred rows where a group has any, else of all.

    One aggregation: the preferred rows' statistics and those of all rows share the shuffle. It keeps a group's values in a buffer, which suits
    groups that are structures. With ``hot``, groups of any size are right: preferred rows are chosen first, and the quantiles of groups with more values are refined.
    """
    v = F.col(value)
    if hot is not None:
        chosen = df
        if preferred is not None:
            some = df.groupBy(*by).agg(F.count(F.when(preferred, v)).alias("n")).where("n > 0").select(*[F.col(c).alias(f"__{c}") for c in by])
            has = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
            chosen = df.where(preferred).select(*by, value).unionByName(df.select(*by, value).join(some, has, "left_anti"))
        plain = chosen.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n_values"))
        middle = quantiles(chosen, by, value, {"median": 0.5, "p10": 0.1}, hot, steps=True).withColumnsRenamed({c: f"__{c}" for c in by})
        out = plain.join(middle, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left")
        return out.select(*by, "mean", "median", "p10", "min", "max", "n_values")
    stats = {"mean": F.avg, "median": F.median, "p10": lambda c: stepped_quantile(c, 0.1), "min": F.min, "max": F.max}
    if preferred is None:
        return df.groupBy(*by).agg(*[f(v).alias(k) for k, f in stats.items()], F.count(v).alias("n_values"))
    own = F.when(preferred, v)
    return df.groupBy(*by).agg(*[F.coalesce(f(own), f(v)).alias(k) for k, f in stats.items()], F.when(F.count(own) > 0, F.count(own)).otherwise(F.count(v)).alias("n_values"))


def region_summary(atoms: DataFrame, by: list[str], residue: list[str], value: str, is_ca: Column, min_mean: float = 90.0, min_p10: float = 80.0, strict: bool = True) -> DataFrame:
    """One value per residue (the CA's, else the mean), then the summary per structure with its verdict."""
    per = atoms.groupBy(*by, *residue).agg(F.coalesce(F.avg(F.when(is_ca, F.col(value))), F.avg(value)).alias("residue_value"))
    s = score_summary(per, by, "residue_value")
    over = (lambda c, t: F.col(c) > t) if strict else (lambda c, t: F.col(c) >= t)
    return s.withColumn("passed", over("mean", min_mean) & over("p10", min_p10))


def split_counts(df: DataFrame, flag: str = "passed") -> DataFrame:
    return df.groupBy(flag).agg(F.count("*").alias("n_structures"))
