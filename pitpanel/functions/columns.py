"""Column functions that panels need and Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A denominator closer to zero than this gives NULL.
TINY = 1e-9

# Coefficients of Wichura's algorithm AS 241 (PPND16) for the normal quantile.
AS241_CENTRE = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
AS241_NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
AS241_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(x: Column, coefficients) -> Column:
    def horner(values):
        out = F.lit(values[-1])
        for v in reversed(values[:-1]):
            out = out * x + F.lit(v)
        return out

    return horner(coefficients[0]) / horner(coefficients[1])


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1), exact to about 1e-15."""
    def let(value, body):  # the value stands as a variable, so that the formula does not repeat what it is made of
        return F.transform(F.array(value), body)[0]

    def far(p):
        return let(F.sqrt(-F.ln(F.least(p, 1 - p))), lambda t: F.when(t <= 5, _ratio(t - 1.6, AS241_NEAR)).otherwise(_ratio(t - 5, AS241_FAR)))

    def centre(p):
        return (p - 0.5) * let(0.180625 - (p - 0.5) * (p - 0.5), lambda x: _ratio(x, AS241_CENTRE))

    return let(p, lambda p: F.when(F.abs(p - 0.5) <= 0.425, centre(p)).otherwise(F.when(p < 0.5, -far(p)).otherwise(far(p))))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function: its series within 7 of zero (to about 1e-15), 0 or 1 beyond."""
    def series(z):
        def step(s, n):
            return F.transform(F.array(s["term"] * z * z / (2 * n + 1)), lambda t: F.struct(t.alias("term"), (s["total"] + t).alias("total")))[0]

        total = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(z.alias("term"), z.alias("total")), step, lambda s: s["total"])
        return 0.5 + total * F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi())

    def value(z):
        return F.when(z >= 7, F.lit(1.0)).when(z <= -7, F.lit(0.0)).otherwise(series(z))

    return F.when(z.isNotNull(), F.transform(F.array(z.cast("double")), value)[0])


def safe_div(a: Column, b: Column) -> Column:
    """a / b; NULL where b is within TINY of zero."""
    return F.when(F.abs(b) > TINY, a / b)


def fixed(v: Column, places: int) -> Column:
    """v to so many places, just under half going up: unlike round, the same in every engine for sums that differ in the last bit."""
    return F.when(F.abs(v) < 9e18 / 10**places, F.floor(v * float(10**places) + 0.501) / float(10**places)).otherwise(v)


def significant(v: Column, digits: int = 6) -> Column:
    """v to so many significant digits (and no finer than 1e-10), just under half going up, as in fixed."""
    k = F.least(F.lit(digits - 1) - F.floor(F.log10(F.abs(v))), F.lit(10))
    power = F.pow(F.lit(10.0), F.abs(k))
    rounded = F.when(k >= 0, F.floor(v * power + 0.501) / power).otherwise(F.floor(v / power + 0.501) * power)
    return F.when((v == 0) | (F.abs(v) > 1e18), v).otherwise(rounded)


def significant_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with `significant` of its doubles; what a value is scaled by is a column first, taken once and not at each mention."""
    doubles = {c: i for i, (c, t) in enumerate(df.dtypes) if t == "double"}
    if not doubles:
        return df
    kept = F.col("*")
    steps = df.select(kept, *[F.when(F.abs(c) <= 1e18, F.least(F.lit(digits - 1) - F.floor(F.log10(F.abs(c))), F.lit(10))).alias(f"__k{i}") for c, i in doubles.items()])
    steps = steps.select(kept, *[F.pow(F.lit(10.0), F.abs(f"__k{i}")).alias(f"__power{i}") for i in doubles.values()])

    def rounded(c: str) -> Column:
        v, k, power = F.col(c), F.col(f"__k{doubles[c]}"), F.col(f"__power{doubles[c]}")
        return F.when((v == 0) | (F.abs(v) > 1e18), v).otherwise(F.when(k >= 0, F.floor(v * power + 0.501) / power).otherwise(F.floor(v / power + 0.501) * power))

    return steps.select(*[rounded(c).alias(c) if c in doubles else F.col(c) for c in df.columns])


def clipped(v: Column, lo: Column, hi: Column) -> Column:
    """v between lo and hi; NULL stays NULL."""
    return F.when(v.isNotNull(), F.greatest(F.least(v, hi), lo))


def average_rank(v: Column, *by: Column | str) -> Column:
    """Rank from 1, ties sharing the mean rank; NULL values have none."""
    real = F.when(v.isNotNull(), 1).otherwise(0)
    order = Window.partitionBy(*by, real).orderBy(v)
    same = Window.partitionBy(*by, real, v)
    return F.when(v.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2)


def percent_rank(v: Column, *by: Column | str) -> Column:
    """average_rank over the number of values."""
    return average_rank(v, *by) / F.count(v).over(Window.partitionBy(*by))
