"""Column-expression helpers.

All are built from native Spark functions, so they stay inside whole-stage
codegen; none of them calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# JS String.prototype.trim whitespace (ASCII part plus no-break space and BOM)
_WS = "[ \\t\\n\\r\\f\\u000b\\u00a0\\ufeff]"


def ts_lit(value) -> Column:
    """A wall-clock TIMESTAMP_NTZ literal from a Python datetime, independent
    of the session and process time zones (a datetime literal would be
    converted through the local zone first)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def lookup(col: Column, mapping: dict, default=None) -> Column:
    """Fixed small lookup as a CASE expression (no join, stays in codegen)."""
    out = None
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


# ---------------------------------------------------------------------------
# Stock bands
# ---------------------------------------------------------------------------

def stock_etat(q: Column) -> Column:
    return (F.when(q < C.CRITICAL_STOCK, F.lit(C.STATE_CRITICAL))
            .when(q < C.LOW_STOCK, F.lit(C.STATE_LOW))
            .otherwise(F.lit(C.STATE_OK)))


def stock_alerte(q: Column) -> Column:
    return F.when(q < C.CRITICAL_STOCK, F.lit(1)).otherwise(F.lit(0))


def fill_pct(q: Column) -> Column:
    """``min(100, Math.round(q / 200 * 100))`` (q >= 0, so floor(x + 0.5))."""
    return F.least(F.lit(100), F.floor(q / F.lit(C.FILL_REFERENCE) * 100 + 0.5).cast("int"))


def fill_level(q: Column) -> Column:
    return (F.when(q < C.CRITICAL_STOCK, F.lit(C.LEVEL_LOW))
            .when(q < C.LOW_STOCK, F.lit(C.LEVEL_MEDIUM))
            .otherwise(F.lit(C.LEVEL_HIGH)))


def band_colour(q: Column) -> Column:
    return (F.when(q < C.CRITICAL_STOCK, F.lit(C.COLOUR_CRITICAL))
            .when(q < C.LOW_STOCK, F.lit(C.COLOUR_LOW))
            .otherwise(F.lit(C.COLOUR_OK)))


def status_class(statut: Column) -> Column:
    return lookup(statut, C.STATUS_CLASSES, C.STATUS_CLASS_DEFAULT)


def role_label(role: Column, default: str = C.ROLE_LABEL_DEFAULT) -> Column:
    return lookup(role, C.ROLE_LABELS, default)


# ---------------------------------------------------------------------------
# formatting
# ---------------------------------------------------------------------------

def format_date_fr(d: Column) -> Column:
    """``dd/MM/yyyy``; an em dash for null."""
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.lit(C.MISSING_TEXT))


def _fr_number(n: Column, decimals: int, group: str) -> Column:
    # format_number gives "1,234.50"; swap marks to the French ones
    return F.translate(F.format_number(n, decimals), ",.", group + C.FR_DECIMAL)


def format_mad(n: Column) -> Column:
    """Two decimals, French marks, `` MAD`` suffix; em dash for null."""
    return F.coalesce(F.concat(_fr_number(n, 2, C.FR_GROUP), F.lit(" " + C.CURRENCY)),
                      F.lit(C.MISSING_TEXT))


def format_mad0(n: Column, group: str = C.FR_GROUP) -> Column:
    """No decimals (half away from zero, as Intl does), then the suffix."""
    return F.coalesce(F.concat(_fr_number(F.round(n, 0), 0, group), F.lit(" " + C.CURRENCY)),
                      F.lit(C.MISSING_TEXT))


def iso_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


# ---------------------------------------------------------------------------
# Lenient parsing of form text
# ---------------------------------------------------------------------------

def lenient_int(s: Column, default: int | Column = 0) -> Column:
    """``parseInt(s) || default``: leading integer, NaN and 0 give the default; a
    number beyond int is null, not the default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(~int_overflow(s), F.coalesce(F.nullif(parse_int_or_null(s), F.lit(0)), d))


def _int_text(s: Column) -> Column:
    return F.coalesce(F.regexp_extract(s, "^" + _WS + "*([+-]?[0-9]+)", 1), F.lit(""))


def int_overflow(s: Column) -> Column:
    """The text starts with an integer that does not fit int."""
    return (_int_text(s) != "") & _int_text(s).try_cast("int").isNull()


def parse_int_or_null(s: Column) -> Column:
    """``parseInt(s)`` with NaN as null (0 stays 0)."""
    return _int_text(s).try_cast("int")


def lenient_decimal(s: Column) -> Column:
    """``parseFloat(s) || 0`` as decimal(12,2); a number beyond it is null."""
    lead = F.coalesce(F.regexp_extract(
        s, "^" + _WS + "*([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?)", 1), F.lit(""))
    return F.when(lead == "", F.lit(0).cast("decimal(12,2)")).otherwise(lead.try_cast("decimal(12,2)"))


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, "^" + _WS + "+|" + _WS + "+$", "")


def clean_text(s: Column) -> Column:
    """Trimmed text; blank and null are both missing (null)."""
    return F.nullif(js_trim(s), F.lit(""))


# ---------------------------------------------------------------------------
# F8: audit JSON
# ---------------------------------------------------------------------------

def audit_json(*cols: str) -> Column:
    """Row to a JSON object, null fields left out (``FOR JSON PATH``)."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def div_half_up(total: Column, n: Column, scale: int) -> Column:
    """``total / n`` rounded half up to ``scale`` decimals (``total`` a
    decimal with 2 decimals, ``n`` > 0), in exact integer arithmetic: one
    rounding step only, so no double rounding through an intermediate scale."""
    cents = (total * 100).cast("decimal(38,0)")
    shift = 10 ** (scale - 2) if scale >= 2 else 1
    q = F.floor((cents * (2 * shift) + n) / (n * 2))
    return (q.cast("decimal(38,0)") * F.lit(10 ** -scale).cast(f"decimal({scale + 1},{scale})")) \
        .cast(f"decimal(20,{scale})")
