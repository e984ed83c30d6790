"""Vector expressions over array columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once for ``body``; inside another lambda it would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def is_finite(a: Column) -> Column:
    """Every number is there and finite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF))


def is_embedding(a: Column, least_norm: float = 0.1) -> Column:
    return F.coalesce((F.size(a) > 0) & is_finite(a) & (norm(a) > least_norm), F.lit(False))


def l2(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine clamped to [-1, 1]; infinite for empty, unlike long or zero vectors."""
    n = norm(a) * norm(b)
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0)
    return F.when(ok, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(F.lit(INF))


def plda_score(a: Column, b: Column) -> Column:
    """Cosine, 0 where degenerate."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a).cast("double"), lambda top: top + F.log(_sum(F.transform(a, lambda x: F.exp(x - top)))))


def softmax(a: Column) -> Column:
    return let(log_sum_exp(a), lambda z: F.transform(a, lambda x: F.exp(x - z)))


def log_softmax(a: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(a, lambda x: x.cast("double") / temperature)
    return let(log_sum_exp(scaled), lambda z: F.transform(scaled, lambda x: x - z))


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b), safe for minus infinity."""
    top, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == -INF, top).otherwise(top + F.log1p(F.exp(low - top)))


def log_mean(a: Column, b: Column) -> Column:
    """Mean in probability space of two log-probability vectors."""
    return F.zip_with(a, b, lambda x, y: log_add(x.cast("double"), y.cast("double")) - 0.6931471805599453)


def resample(a: Column, out: Column) -> Column:
    """Linear interpolation at half-pixel centres; unchanged if the length is."""
    n = F.size(a)

    def at(i: Column) -> Column:
        pos = F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), (i + 0.5) / (out.cast("double") / n) - 0.5))
        left = F.floor(pos).cast("int")
        right = F.least(left + 1, n - 1)
        share = pos - left
        return F.element_at(a, left + 1) * (1 - share) + F.element_at(a, right + 1) * share

    return F.when(n == out, F.transform(a, lambda x: x.cast("double"))).when((n > 0) & (out > 0), F.transform(F.sequence(F.lit(0), out - 1), at)).otherwise(F.array().cast("array<double>"))


def rms(a: Column) -> Column:
    return F.when(F.size(a) > 0, norm(a) / F.sqrt(F.size(a))).otherwise(F.lit(0.0))


def quality(a: Column) -> Column:
    return F.least(F.lit(1.0), norm(a) / 10)


def is_silent(a: Column, least: float = 1e-10) -> Column:
    return F.forall(a, lambda x: F.abs(x) <= least)


def audio_issues(a: Column, rate: int = 16_000, seconds: float = 1.0, energy: float = 0.01) -> Column:
    """Names of what is wrong with samples; empty if nothing is."""
    return F.array_compact(F.array(
        F.when(F.size(a) == 0, F.lit("empty")), F.when(F.size(a) < rate * seconds, F.lit("short")), F.when(rms(a) < energy, F.lit("quiet"))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def exclusive_scores(p: Column, floor: float) -> Column:
    """How much each speaker has a frame alone, in logs, from its probabilities."""
    rest = _sum(F.transform(p, lambda x: F.log1p(-F.least(x.cast("double"), F.lit(1 - floor)))))
    return let(rest, lambda r: F.transform(p, lambda x: F.log(F.greatest(x.cast("double"), F.lit(floor))) - F.log1p(-F.least(x.cast("double"), F.lit(1 - floor))) + 0.6931471805599453 + r))


def sanitized(x: Column) -> Column:
    """NaN and infinity become 0."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), F.lit(0.0)).otherwise(x)


def masked(n: Column, valid: Column) -> Column:
    """1 up to the valid length, 0 after."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: (i <= valid).cast("int"))).otherwise(F.array().cast("array<int>"))


def power_schedule(steps: int, low: float, high: float, rho: float) -> Column:
    """Noise levels from high to low on a rho-power scale, then 0."""
    a, b = high ** (1 / rho), low ** (1 / rho)
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.pow(a + i / max(1, steps - 1) * (b - a), F.lit(float(rho)))), F.array(F.lit(0.0)))
