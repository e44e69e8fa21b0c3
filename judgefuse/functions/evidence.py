"""Column expressions that normalise raw evidence.

All functions return ``Column`` objects; nothing here touches data.
NaN is turned into NULL first because Spark orders NaN above every number
(``NaN >= 0.5`` is TRUE in Spark, FALSE in NumPy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = _c(c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def binarize(c, thresh: float = 0.5) -> Column:
    """Clip to [0, 1] then ``>= thresh``; NULL/NaN -> 0.

    Clipping does not change the comparison for 0 < thresh <= 1 and on data
    already in {0, 1} both branches of the reference agree, so no column scan.
    """
    v = nan_to_null(c)
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.when(v >= F.lit(float(thresh)), F.lit(1.0)).otherwise(F.lit(0.0))


def mask(c) -> Column:
    """Mask >= 0.5 -> 1 (ignore channel), else 0; NULL/NaN -> 0."""
    if c is None:
        return F.lit(0)
    return F.when(nan_to_null(c) >= F.lit(0.5), F.lit(1)).otherwise(F.lit(0))


def clip_weight(c, lo: float = 0.0, hi: float = 10.0) -> Column:
    """Sample weight clipped to [0, 10]; missing column -> 1; a NULL or NaN
    weight stays NULL (``least``/``greatest`` would turn it into a bound)."""
    if c is None:
        return F.lit(1.0)
    v = nan_to_null(c)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def agent_score(c) -> Column:
    """C4: NULL stays NULL, otherwise ``>= 0.5`` -> 1.0 else 0.0."""
    v = nan_to_null(c)
    return F.when(v.isNull(), F.lit(None).cast("double")) \
        .when(v >= F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))


def delta_label(c, dtype: T.DataType) -> Column:
    """Numeric 0/1 kept; strings starting with env/agent (trimmed, lower
    case) -> 0/1; everything else (incl. the string "1") -> NULL."""
    c = _c(c)
    if isinstance(dtype, T.StringType):
        s = F.lower(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")))
        return (F.when(s.startswith("env"), F.lit(0.0))
                 .when(s.startswith("agent"), F.lit(1.0))
                 .otherwise(F.lit(None).cast("double")))
    v = nan_to_null(c)
    return F.when(v.isin(0.0, 1.0), v).otherwise(F.lit(None).cast("double"))


def gui_evidence_code(analysis, accuracy) -> Column:
    """No analysis -> -1; analysis without accuracy -> 0; else accuracy."""
    a = _c(analysis)
    return (F.when(a.isNull(), F.lit(-1))
             .otherwise(F.coalesce(_c(accuracy).cast("int"), F.lit(0))))


def has_col(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}


def col_type(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f.dataType
    raise KeyError(name)
