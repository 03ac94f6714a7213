"""Row-level column expressions: labels, thresholds, losses, errors.

All of them are built-in Catalyst expressions, so they stay inside whole-stage
codegen and also work on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- labels -----------------------------------------------------------------

def label_regex(sample, signal: str) -> Column:
    """L1: label 1 when the sample name contains ``{signal}`` followed by any
    non-digits (unanchored search, so it behaves as "contains")."""
    return _c(sample).rlike(f".*{signal}[^0-9]*").cast("int")


def label_exact(sample, signal: str) -> Column:
    """L3: label 1 only for the exact sample name."""
    return (_c(sample) == F.lit(signal)).cast("int")


def label_contains(sample, text: str) -> Column:
    """Label 1 when the sample name contains the text."""
    return _c(sample).contains(text).cast("int")


def label_by_file(file_name, signal: str, fakes_sample="fakes", sample=None) -> Column:
    """L4: 1 for rows read from the signal file, except its fake-background rows."""
    is_sig = _c(file_name).contains(signal)
    if sample is not None:
        is_sig = is_sig & (_c(sample) != F.lit(fakes_sample))
    return is_sig.cast("int")


def file_stem(path) -> Column:
    """The file name without folder and extension."""
    return F.regexp_extract(_c(path), r"([^/]+)\.[^./]+$", 1)


def mass_from_sample(sample) -> Column:
    """The mass encoded in a signal sample name (first run of digits)."""
    return F.regexp_extract(_c(sample), r"([0-9]+)", 1).cast("int")


def to_bytes(c) -> Column:
    """String column as bytes."""
    return _c(c).cast("binary")


# --- thresholds ---------------------------------------------------------------

def predict_class(score, th, inclusive: bool = False) -> Column:
    """L7 (strict ``>``) and L8 (``>=``)."""
    s = _c(score)
    th = th if isinstance(th, Column) else F.lit(float(th))
    return (s >= th if inclusive else s > th).cast("int")


def anomaly_class(err, th, anomaly_label: int = 1) -> Column:
    """With class 1 anomalous a large error predicts 1, else a small one does."""
    e = _c(err)
    th = th if isinstance(th, Column) else F.lit(float(th))
    return (e > th).cast("int") if anomaly_label == 1 else (e <= th).cast("int")


def reconstruction_error(x, xhat) -> Column:
    """Mean over positions of the squared difference of two arrays."""
    sq = F.zip_with(_c(x), _c(xhat), lambda a, b: (a - b) * (a - b))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(_c(x))


def additive_decision(base, contributions) -> Column:
    """Base value plus the sum of attributions, positive → class 1."""
    total = F.aggregate(_c(contributions), _c(base).cast("double"), lambda acc, v: acc + v)
    return (total > 0).cast("int")


# --- weights and losses --------------------------------------------------------

def class_weighted(weight, label, w_background: float, w_signal: float) -> Column:
    """Sample weight times the weight of the row's class."""
    return _c(weight) * F.when(_c(label) == 1, F.lit(float(w_signal))).otherwise(F.lit(float(w_background)))


def binary_crossentropy(label, p, eps: float = 1e-7) -> Column:
    """Per-row cross-entropy with the prediction clipped to [eps, 1-eps] and
    eps added again inside both logarithms."""
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    t = _c(label).cast("double")
    return -(t * F.log(q + eps) + (F.lit(1.0) - t) * F.log(F.lit(1.0) - q + eps))


def focal_loss(label, p, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-7) -> Column:
    """−α[t·log(p+ε)(1−p)^γ + (1−t)·log(1−p+ε)·p^γ] with p clipped."""
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    t = _c(label).cast("double")
    g = F.lit(float(gamma))
    return -F.lit(float(alpha)) * (t * F.log(q + eps) * F.pow(F.lit(1.0) - q, g)
                                  + (F.lit(1.0) - t) * F.log(F.lit(1.0) - q + eps) * F.pow(q, g))


def logit_crossentropy(label, p, eps: float = 1e-7) -> Column:
    """Cross-entropy through the log-odds z, in the stable form
    max(z,0) − z·t + log(1+exp(−|z|))."""
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    z = F.log(q / (F.lit(1.0) - q))
    t = _c(label).cast("double")
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
