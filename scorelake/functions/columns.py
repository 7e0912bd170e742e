"""Column-expression helpers.

All return ``Column`` objects built from ``pyspark.sql.functions`` so they stay
inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- P16 policy
def policy_column(p, field: str, policy=None) -> Column:
    """Credit policy as a generated ``when`` chain with strict ``<``.

    ``field`` is one of ``estado``, ``tramo``, ``monto``.  NaN compares above
    every number in Spark and null never satisfies ``<``, so both fall to the
    last (denied) rule.
    """
    policy = policy or fixed.POLICY
    idx = {"estado": 1, "tramo": 2, "monto": 3}[field]
    p = _c(p)
    expr = None
    for rule in policy[:-1]:
        value = F.lit(rule[idx])
        cond = p < F.lit(rule[0])
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    last = F.lit(policy[-1][idx])
    return last if expr is None else expr.otherwise(last)


def with_policy(df, p_col: str = "p_default", policy=None):
    return df.withColumns({
        "estado": policy_column(p_col, "estado", policy),
        "tramo": policy_column(p_col, "tramo", policy),
        "monto": policy_column(p_col, "monto", policy),
    })


# ------------------------------------------------------------ P6 target code
def target_code(col) -> Column:
    """"Sí" -> 1, anything else (including null) -> 0."""
    return F.when(_c(col) == F.lit(fixed.TARGET_POSITIVE), F.lit(1)).otherwise(F.lit(0))


# --------------------------------------------------------- P5 prefix strip
def strip_likert_prefix(col) -> Column:
    """Anchored greedy prefix strip; strings without the prefix are trimmed."""
    s = F.trim(_c(col))
    pat = fixed.LIKERT_PREFIX_PATTERN
    return F.when(s.rlike(pat), F.trim(F.regexp_extract(s, pat, 1))).otherwise(s)


def first_bracket(col) -> Column:
    """Non-greedy first ``[...]`` content, null when there is no bracket pair."""
    c = _c(col)
    pat = fixed.BRACKET_PATTERN
    return F.when(c.rlike(pat), F.regexp_extract(c, pat, 1))


# ------------------------------------------------------------ F1 label clean
def label_clean(col) -> Column:
    c = _c(col)
    return (
        F.when(c.rlike(fixed.BRACKET_PATTERN), F.regexp_extract(c, fixed.BRACKET_PATTERN, 1))
        .when(c.contains(fixed.PAYMENT_FRAGMENT), F.lit(fixed.LABEL_PAYMENT))
        .when(c.contains("DISTRITO"), F.lit(fixed.LABEL_DISTRICT))
        .when(c.contains("NIVEL EDUCATIVO"), F.lit(fixed.LABEL_EDUCATION))
        .otherwise(c)
    )


# ------------------------------------------------------------ F2 truncation
def truncate(col, limit: int, keep: int) -> Column:
    """Above ``limit`` characters keep ``keep`` and append ``...``."""
    c = _c(col)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


# ------------------------------------------------------------ F3 first word
def first_word(col) -> Column:
    return F.split(_c(col), " ").getItem(0)


# -------------------------------------------------------- F4 number formats
def fmt_fixed(col, decimals: int) -> Column:
    """Fixed decimals of an already rounded value (ties then cannot differ)."""
    return F.format_string(f"%.{decimals}f", F.round(_c(col), decimals))


def fmt_signed(col, decimals: int) -> Column:
    return F.format_string(f"%+.{decimals}f", F.round(_c(col), decimals))


def fmt_percent(col, decimals: int = 1) -> Column:
    """Probability 0..1 as ``xx.x%``."""
    return F.concat(fmt_fixed(_c(col) * F.lit(100.0), decimals), F.lit("%"))


# ------------------------------------------------------------ F5 to level
def to_level_index(col) -> Column:
    """Clip to 1..5 and round half-to-even (as NumPy)."""
    return F.bround(F.least(F.greatest(_c(col), F.lit(1.0)), F.lit(5.0)), 0).cast("int")


def level_name(idx) -> Column:
    levels = F.array(*[F.lit(x) for x in fixed.LIKERT_LEVELS])
    return F.get(levels, _c(idx) - F.lit(1))


def level_index(name) -> Column:
    """Answer text -> 1..5, null for anything outside the scale."""
    levels = F.array(*[F.lit(x) for x in fixed.LIKERT_LEVELS])
    pos = F.array_position(levels, _c(name))
    return F.when(pos > 0, pos.cast("int"))


# ----------------------------------------------------------- F6 timestamps
def fmt_iso(col) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss")


def fmt_clock(col) -> Column:
    return F.date_format(_c(col), "yyyy/MM/dd HH:mm:ss")


def fmt_local(col) -> Column:
    return F.date_format(_c(col), "dd/MM/yyyy, HH:mm")


# -------------------------------------------------------------- F7 JSON
def json_or_null(col, schema: str) -> Column:
    """Decode JSON; malformed text gives null (not a struct of nulls)."""
    c = _c(col)
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))


# ---------------------------------------------------------- F10 stability
def stability_marker(n) -> Column:
    n = _c(n)
    return F.when(n == 0, F.lit("estable")).otherwise(F.concat(F.lit("+"), n.cast("string")))


# -------------------------------------------------------------- F11 money
def fmt_money(col) -> Column:
    """``S/ 1,234.50``; a dash when the amount is not positive."""
    c = _c(col)
    return F.when(c > 0, F.concat(F.lit("S/ "), F.format_number(c, 2))).otherwise(F.lit("—"))


# ----------------------------------------------------------- F8 logistic
def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


# ------------------------------------------------------------- F12 round
def r6(col) -> Column:
    return F.round(_c(col), 6)
