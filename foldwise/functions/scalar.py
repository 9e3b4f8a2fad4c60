"""Scalar column functions; all built-in expressions, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability clip bounds of the modelled toolkit.
LOGIT_EPS = 1e-6
BLEND_EPS = 1e-7
LOGLOSS_EPS = 2.220446049250313e-16  # float64 machine epsilon


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(key, tag: str) -> Column:
    """Deterministic number in [0, 1) from a key and a tag (md5 based).

    Same value in any engine with md5: first 8 hex digits / 2^32.
    """
    h = F.substring(F.md5(F.concat(_c(key).cast("string"), F.lit(f":{tag}"))), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)


def clip(p, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(p), F.lit(lo)), F.lit(hi))


def logit(p, eps: float = LOGIT_EPS) -> Column:
    c = clip(p, eps, 1 - eps)
    return F.ln(c / (F.lit(1.0) - c))


def hard_label(p) -> Column:
    """Binary hard label: strictly above 0.5."""
    return (_c(p) > F.lit(0.5)).cast("int")


def argmax_code(probs) -> Column:
    """0-based position of the first maximum of an array column."""
    a = _c(probs)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")


def parse_regime(label) -> tuple[Column, Column]:
    """Split ``<strategy>_<n>`` from the right; partial labels give ''."""
    lab = _c(label)
    strategy = F.regexp_extract(lab, r"^(.*)_(\d+)$", 1)
    n = F.regexp_extract(lab, r"^(.*)_(\d+)$", 2)
    return strategy, n
