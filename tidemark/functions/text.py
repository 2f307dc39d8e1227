"""How numbers, times and names are shown. All built-in expressions.

Decimals are written with format_number and a pattern: it rounds halves to even like C's
printf, which format_string does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ["K", "M", "G", "T", "P"]


def _number(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def hms(seconds: Column) -> Column:
    """H:MM:SS with unbounded hours; "-" below zero."""
    shown = F.format_string(
        "%d:%02d:%02d", _div(seconds, 3600), _div(seconds % 3600, 60), seconds % 60
    )
    return F.when(seconds < 0, "-").otherwise(shown)


def legacy_hms(seconds: Column) -> Column:
    """Rounded seconds, days apart: "1 day, 1:02:03"."""
    whole = F.bround(seconds, 0).cast("bigint")
    days = _div(whole, 86400)
    prefix = F.when(days == 0, "").otherwise(
        F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "))
    )
    return F.when(seconds < 0, "-").otherwise(F.concat(prefix, hms(whole % 86400)))


def _scaled(value: Column) -> Column:
    """1000 and more, three significant digits and a unit."""
    result, scaled = None, value.cast("double")
    for unit in _UNITS:
        scaled = scaled / 1000
        shown = (
            F.when(scaled >= 100, _number(scaled, "0"))
            .when(scaled >= 10, _number(scaled, "0.0"))
            .otherwise(_number(scaled, "0.00"))
        )
        shown = F.concat(shown, F.lit(unit))
        # Not below 1000 at the last unit: it takes whatever is left.
        fits = scaled < 1000 if unit != _UNITS[-1] else F.lit(True)
        result = F.when(fits, shown) if result is None else result.when(fits, shown)
    return result


def si_integer(value: Column, plain: bool = False) -> Column:
    """1234 -> "1.23K"; plain shows every digit."""
    if plain:
        return value.cast("string")
    size = F.abs(value)
    shown = F.when(size < 1000, size.cast("string")).otherwise(_scaled(size))
    return F.concat(F.when(value < 0, "-").otherwise(""), shown)


def si_rate(value: Column, plain: bool = False) -> Column:
    """Like si_integer for a rate: whole numbers without, others with one decimal."""
    small = F.when(value == F.floor(value), _number(value, "0")).otherwise(
        _number(value, "0.0")
    )
    shown = F.when(value < 0, "-").when(value == 0, "0")
    if plain:
        return shown.otherwise(small)
    return shown.when(value < 1000, small).otherwise(_scaled(value))


def decimals(value: Column, places: int) -> Column:
    return _number(value, "0." + "0" * places)


def ratio_text(value: Column) -> Column:
    """Two decimals, "-" for zero."""
    return F.when(value > 0, _number(value, "0.00")).otherwise("-")


def config_text(key: Column, value: Column) -> Column:
    """A setting in milliseconds also in days, hours or minutes."""
    ms = value.try_cast("bigint")
    days, hours, minutes = ms / 86400000, ms / 3600000, ms / 60000
    # try_cast trims spaces and takes "1.5"; only an optional sign and digits count.
    is_ms = key.endswith(".ms") & value.rlike("^[+-]?[0-9]+$") & ms.isNotNull()
    longer = (
        F.when(days >= 1, F.concat(F.floor(days).cast("string"), F.lit(" days")))
        .when(hours >= 1, F.concat(_number(hours, "0.0"), F.lit(" hours")))
        .otherwise(F.concat(_number(minutes, "0.0"), F.lit(" min")))
    )
    return F.when(is_ms, F.concat(value, F.lit(" ("), longer, F.lit(")"))).otherwise(value)


def id_list(ids: Column) -> Column:
    """(1,2,3), or "-" if there is no list."""
    joined = F.array_join(ids.cast("array<string>"), ",")
    return F.when(ids.isNotNull(), F.concat(F.lit("("), joined, F.lit(")"))).otherwise("-")


def of_total(part: Column, total: Column) -> Column:
    return F.concat_ws("/", part.cast("string"), total.cast("string"))


def percent(part: Column, total: Column) -> Column:
    """Whole percent, cut and never above 100."""
    return F.least((part / total * 100).cast("int"), F.lit(100))


# Fixed values of the 32-bit FNV-1a hash.
_FNV_BASIS = 2166136261
_FNV_PRIME = 16777619
_MASK32 = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, of the UTF-8 bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.when(
        F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    ).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        F.transform(
            places, lambda at: F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("bigint")
        ),
        F.lit(_FNV_BASIS).cast("bigint"),
        lambda h, byte: (h.bitwiseXOR(byte) * _FNV_PRIME).bitwiseAND(F.lit(_MASK32)),
    )


def anonymous(kind: str, name: Column) -> Column:
    """Such as "group 012345": six digits of the hash. Names can collide, so this comes last,
    after everything that groups or sorts by name."""
    return F.format_string(kind + " %06d", fnv1a(name) % 1000000)
