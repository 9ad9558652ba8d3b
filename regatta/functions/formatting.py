"""Text and number formatting as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def model_id(model: Column, exp: Column, score: Column, iteration: Column) -> Column:
    """``{model}_Exp{n}_{score}_{iteration}``."""
    return F.concat(
        model, F.lit("_Exp"), exp.cast("string"), F.lit("_"), score, F.lit("_"),
        iteration.cast("string"),
    )


def model_family(identifier: Column) -> Column:
    """Family of a saved model: the text before the first underscore."""
    return F.split(identifier, "_").getItem(0)


def elapsed(seconds: Column) -> Column:
    """``1h 2m 3.00s``, leaving out leading zero units."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600.0)) / 60)
    rest = F.pmod(seconds, F.lit(60.0))
    return (
        F.when(hours > 0, F.format_string("%dh %dm %.2fs", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm %.2fs", minutes, rest))
        .otherwise(F.format_string("%.2fs", rest))
    )


def hms(seconds: Column) -> Column:
    """Seconds to ``H:MM:SS``; anything that is not a number gives a dash."""
    number = seconds.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(8.64e13))
    micros = F.round(F.when(usable, number) * 1e6).cast("bigint")
    whole = (F.signum(micros) * F.floor(F.abs(micros) / 1000000)).cast("bigint")
    text = F.format_string(
        "%d:%02d:%02d",
        F.floor(whole / 3600),
        F.floor(F.pmod(whole, F.lit(3600)) / 60),
        F.pmod(whole, F.lit(60)),
    )
    return F.when(usable, text).otherwise(F.lit(DASH))


def number(value: Column, digits: int = 4) -> Column:
    """``1,234.5678``; missing gives a dash."""
    return F.coalesce(F.format_number(F.nanvl(value, F.lit(None)), digits), F.lit(DASH))


def safe_name(text: Column) -> Column:
    """File-safe name: other than word characters, ``-``, ``.`` and space become ``_``."""
    kept = F.regexp_replace(text, r"(?U)[^\w\-. ]", "_")
    return F.regexp_replace(F.trim(kept), " ", "_")


def _at(time: Column | None, form: str) -> Column:
    return F.date_format(F.current_timestamp() if time is None else time, form)


def today(time: Column | None = None) -> Column:
    return _at(time, "dd/MM/yyyy")


def clock(time: Column | None = None) -> Column:
    return _at(time, "HH:mm:ss")


def stamp(time: Column | None = None) -> Column:
    return _at(time, "yyyy-MM-dd HH:mm:ss")
