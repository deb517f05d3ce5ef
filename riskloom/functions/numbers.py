"""Number rounding and number text that agree with IEEE doubles exactly.

Spark's ``round`` works half-up on the shortest decimal text of a double.  The reports need the
double's exact value rounded half-even, which differs only where that text ends in a 5 right after
the kept digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: Column, digits: int) -> Column:
    """``x`` rounded to ``digits`` decimals by its exact binary value, ties to even."""
    scale = 10.0**digits
    halves = F.rint(x * (2 * scale))
    odd = F.pmod(halves, F.lit(2.0)) == 1.0
    looks_tied = odd & (halves / (2 * scale) == x)
    # Split x into a 24-bit head and the rest, so that every product below is exact.
    head = x.cast("float").cast("double")
    excess = (head * (2 * scale) - halves) + (x - head) * (2 * scale)
    below, above = (halves - 1) / 2, (halves + 1) / 2
    even = F.when(F.pmod(below, F.lit(2.0)) == 0.0, below).otherwise(above)
    picked = F.when(excess > 0, above).when(excess < 0, below).otherwise(even)
    return F.when(looks_tied, picked / scale).otherwise(F.round(x, digits))


def fixed_text(x: Column, digits: int) -> Column:
    """``x`` with exactly ``digits`` decimals, rounded by its exact value."""
    x = x.cast("double")
    # The sign survives even where nothing but zeros is left of the number.
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(x.isNotNull(), F.concat(sign, F.format_string(f"%.{digits}f", F.abs(round_exact(x, digits)))))


def double_text(x: Column) -> Column:
    """Shortest decimal text of a double: positional from 1e-4 to 1e16, else with an exponent.

    The digits are the JVM's, which are always the shortest ones from Java 19 on.
    """
    x = x.cast("double")
    java = x.cast("string")
    mantissa = F.regexp_extract(java, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).cast("int")
    sign = F.when(x < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    rest = F.substring(digits, exponent + 2, F.lit(32))
    large = F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    tiny = F.concat(sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e-"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    size = F.abs(x)
    return (
        F.when(~java.contains("E"), java)
        .when((size >= 1e7) & (size < 1e16), large)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(size < 1e-4, tiny)
        .when(size >= 1e16, F.concat(sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e+"), exponent.cast("string")))
    )


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))
