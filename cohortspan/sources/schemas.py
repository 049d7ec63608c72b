"""Declared schemas of the derived tables that other steps rely on."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


_DBL, _STR = T.DoubleType(), T.StringType()

GLM_TABLE = _struct(
    ("term", _STR),
    ("estimate", _DBL),
    ("std_error", _DBL),
    ("statistic", _DBL),
    ("p_value", _DBL),
    ("conf_low", _DBL),
    ("conf_high", _DBL),
    ("conf_method", _STR),
)

COX_TABLE = _struct(
    ("covariate", _STR),
    ("coef", _DBL),
    ("exp_coef", _DBL),
    ("se_coef", _DBL),
    ("coef_lower95", _DBL),
    ("coef_upper95", _DBL),
    ("exp_coef_lower95", _DBL),
    ("exp_coef_upper95", _DBL),
    ("z", _DBL),
    ("p", _DBL),
    ("neg_log2_p", _DBL),
)

IMPORTANCE = _struct(("feature", _STR), ("importance", _DBL))
