"""Costs, moments and the normal distribution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_cost(change: Column, bps: float) -> Column:
    return F.abs(change) * bps / 1e4


def equity_cost(change: Column, commission_bps: float, fee_bps: float, stamp_bps: float) -> Column:
    """Fees on both sides, and a stamp duty on what is bought."""
    return F.abs(change) * (commission_bps + fee_bps) / 1e4 + F.greatest(change, F.lit(0.0)) * stamp_bps / 1e4


def futures_cost(change: Column, taker_bps: float, slippage_bps: float) -> Column:
    return F.abs(change) * (taker_bps + slippage_bps) / 1e4


def sample_sd(x: str) -> Column:
    """0 for one value, as an aggregate."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def sharpe(x: str, per_year: int = 252) -> Column:
    """Annualised, 0 without variation, as an aggregate."""
    sd = sample_sd(x)
    return F.when(sd > 0, F.avg(x) / sd * F.sqrt(F.lit(float(per_year)))).otherwise(0.0)


#: The coefficients of the published approximation 7.1.26 of the error function.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    p, *a = ERF
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * z)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


#: The coefficients of Acklam's published approximation of the inverse normal distribution, and where its tails begin.
CENTRE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
CENTRE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425
EULER_GAMMA = 0.5772156649015329


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal_cdf(p: Column) -> Column:
    """Null unless 0 < p < 1."""
    q, far = p - 0.5, F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _polynomial(far, TAIL_TOP) / _polynomial(far, TAIL_BELOW)
    centre = q * _polynomial(q * q, CENTRE_TOP) / _polynomial(q * q, CENTRE_BELOW)
    return F.when((p > 0) & (p < 1), F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre))


def sharpe_variance(sharpe_: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """Of the estimate of a (not annualised) Sharpe ratio from n returns; moments are by the sample sd, over n."""
    return F.greatest(F.lit(2.0**-52), (1 - skew * sharpe_ + (kurt - 1) / 4 * sharpe_ * sharpe_) / (n - 1))


def best_of_trials(variance: Column, trials: Column) -> Column:
    """The Sharpe ratio that the best of so many trials without skill is expected to have."""
    z = (1 - EULER_GAMMA) * inverse_normal_cdf(1 - 1 / trials) + EULER_GAMMA * inverse_normal_cdf(1 - 1 / (trials * F.e()))
    return F.when(trials <= 1, 0.0).otherwise(F.sqrt(variance) * z)


def deflated_sharpe(sharpe_: Column, variance: Column, trials: Column) -> Column:
    """The probability that the true ratio exceeds what the best of the trials would have by luck."""
    return normal_cdf((sharpe_ - best_of_trials(variance, trials)) / F.sqrt(variance))
