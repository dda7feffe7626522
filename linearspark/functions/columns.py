"""Column-expression building blocks (all JVM-side, no Python UDFs).

These are the scalar operators of the engine: predictions, hinge, the
logistic factor, stable hash keys, and the text formats of the run logs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of every reported double.
OUT_DIGITS = 6


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in plain IEEE double arithmetic.

    Unlike ``round`` (decimal HALF_UP on the exact binary value) this gives
    bit-identical results in any engine that does IEEE arithmetic."""
    scale = float(10 ** digits)
    x = col(c) * F.lit(scale)
    # from 2^52 on a double is whole, and floor() would saturate at the range of BIGINT
    return F.when(F.abs(x) < float(2 ** 52), F.floor(x + F.lit(0.5)).cast("double") / F.lit(scale)).otherwise(col(c))


def out(c, digits: int = OUT_DIGITS) -> Column:
    """Round a reported double and turn -0.0 into 0.0 (inf and NaN pass)."""
    x = col(c)
    r = round_half_up(x, digits)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(r) + F.lit(0.0)


def stable_margin(c, digits: int | None = None) -> Column:
    """The margin that feeds a comparison (support test, sign): raw, or rounded
    to ``digits`` places where two engines that sum in different orders must
    agree on margins that are mathematically 0 or 1."""
    x = col(c)
    if digits is None:
        return x
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(round_half_up(x, digits))


def predict_sign(m) -> Column:
    """1, -1, or 0 for a zero (or NaN) margin -- counted wrong against +-1."""
    return F.when(col(m) > 0, F.lit(1)).when(col(m) < 0, F.lit(-1)).otherwise(F.lit(0))


def predict_threshold(m) -> Column:
    """1 if the margin is positive, else -1 (zero margin gives -1)."""
    return F.when(col(m) > 0, F.lit(1)).otherwise(F.lit(-1))


def is_support(y, m) -> Column:
    """A row violates the margin when y*m < 1 (exactly 1 is not support)."""
    return (col(y) * col(m)) < 1


def hinge(y, m) -> Column:
    """max(1 - y*m, 0); a NaN margin gives +Infinity (Spark orders NaN above
    every number, so ``greatest`` alone would keep the NaN)."""
    z = F.lit(1.0) - col(y) * col(m)
    return F.when(F.isnan(z), F.lit(float("inf"))).otherwise(F.greatest(z, F.lit(0.0)))


def logistic_factor(y, m) -> Column:
    """(1/(1+exp(-y*m)) - 1) * y, the per-row logistic gradient factor."""
    return (F.lit(1.0) / (F.lit(1.0) + F.exp(-col(y) * col(m))) - F.lit(1.0)) * col(y)


def hash_text(*parts) -> Column:
    """md5 hex text of the parts joined by ':' -- identical in every engine."""
    pieces = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(":"))
        pieces.append(F.lit(str(p)) if isinstance(p, int) else col(p).cast("string"))
    return F.md5(F.concat(*pieces))


def hash_prefix(h, bits: int) -> Column:
    """Leading ``bits`` bits (<= 32) of an md5 hex string as a bucket number."""
    nhex = (bits + 3) // 4
    v = F.conv(F.substring(col(h), 1, nhex), 16, 10).cast("long")
    return F.shiftright(v, nhex * 4 - bits) if nhex * 4 != bits else v


def _wall(ts) -> Column:
    """Wall-clock text of a timestamp without time-zone conversion (a
    TIMESTAMP_NTZ casts to text as is; the fraction has no trailing zeros)."""
    return col(ts).cast("timestamp_ntz").cast("string")


def ts_text(ts) -> Column:
    """'YYYY-MM-DD HH:MM:SS.ffffff' of the wall clock, whatever the session
    time zone (date_format would shift times inside a DST gap)."""
    w = _wall(ts)
    frac = F.coalesce(F.try_element_at(F.split(w, "[.]"), F.lit(2)), F.lit(""))
    return F.concat(F.substring(w, 1, 19), F.lit("."), F.rpad(frac, 6, "0"))


def utc_micros(ts) -> Column:
    """Microseconds since the epoch of the wall clock read as UTC -- no
    dependence on the session time zone."""
    return F.unix_micros(F.concat(_wall(ts), F.lit("Z")).cast("timestamp"))


def micros_between(start, end) -> Column:
    return utc_micros(end) - utc_micros(start)


def pct_text(x) -> Column:
    """'{int(x*100)}%' -- truncating, like Python's int()."""
    return F.concat((col(x) * 100).cast("long").cast("string"), F.lit("%"))


def secs_text(x) -> Column:
    """'{int(x)} s' -- truncating."""
    return F.concat(col(x).cast("long").cast("string"), F.lit(" s"))


def fixed_weight(k) -> Column:
    """Deterministic test weights w_k = ((k*37) % 11 - 5) / 10."""
    return (F.pmod(col(k) * 37, F.lit(11)) - 5).cast("double") / 10.0


def uniform(seed: int, index) -> Column:
    """Random number ``index`` of stream ``seed``, in [0, 1): the leading 52 bits of
    the md5 of both.  No state, so it is the same in any task, order and engine."""
    bits = F.conv(F.substring(hash_text(seed, index), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(2 ** 52))
