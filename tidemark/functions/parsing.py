"""Text to typed columns under ANSI mode: what cannot be parsed becomes null, never an error.

The strict variants raise instead, as a wrong declared format should stop a load.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: delivery-month letters of futures codes
MONTH_LETTERS = {
    "F": 1, "G": 2, "H": 3, "J": 4, "K": 5, "M": 6,
    "N": 7, "Q": 8, "U": 9, "V": 10, "X": 11, "Z": 12,
}

_STRPTIME = {"%Y": "yyyy", "%b": "MMM", "%H": "HH", "%M": "mm", "%S": "ss"}


def spark_pattern(fmt: str) -> str:
    """A ``%Y/%m/%d`` style format as a Spark datetime pattern.

    Next to a separator, day and month may have one digit; in packed digits they have two.
    """
    out, i = "", 0
    packed = not any(ch in fmt for ch in "/-. ")
    while i < len(fmt):
        token = fmt[i : i + 2]
        if token == "%m":
            out += "MM" if packed else "M"
        elif token == "%d":
            out += "dd" if packed else "d"
        elif token in _STRPTIME:
            out += _STRPTIME[token]
        elif token.startswith("%"):
            raise ValueError(f"unsupported directive {token!r} in {fmt!r}")
        else:
            out += fmt[i] if not fmt[i].isalpha() else f"'{fmt[i]}'"
            i += 1
            continue
        i += 2
    return out


def _double(text: Column) -> Column:
    trimmed = F.trim(text)
    value = trimmed.try_cast("double")
    # the JVM also reads "1d" and "1f" as numbers, and NaN must not pass as a value
    suffixed = F.lower(F.right(trimmed, F.lit(1))).isin("d", "f")
    return F.when(~suffixed & ~F.isnan(value), value)


def number(col: Column) -> Column:
    """Thousands commas stripped, parsed to double."""
    return _double(F.replace(col.cast("string"), F.lit(","), F.lit("")))


def percent(col: Column) -> Column:
    """Percent sign and commas stripped, parsed to double (12.5% gives 12.5)."""
    return _double(F.translate(col.cast("string"), "%,", ""))


def to_month(col: Column, fmt: str, strict: bool = False) -> Column:
    """Month start of a period string in a declared format."""
    text, pattern = F.trim(col.cast("string")), spark_pattern(fmt)
    parsed = F.to_timestamp(text, pattern) if strict else F.try_to_timestamp(text, F.lit(pattern))
    return F.trunc(parsed, "month")


def month_from_parts(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def to_trade_date(col: Column, fmt: str) -> Column:
    """Day of a date string; invalid text gives null."""
    text = F.trim(F.trim(col.cast("string")), F.lit('"'))
    return F.try_to_timestamp(text, F.lit(spark_pattern(fmt))).cast("date")


def from_filename(name: Column, regex: str = r"\((\d{4})\)", strict: bool = True) -> Column:
    """First capture group of a file name; a name without it is an error unless lenient."""
    found = F.regexp_extract(name, regex, 1)
    if not strict:
        return F.nullif(found, F.lit(""))
    message = F.concat(name, F.lit(f" does not match {regex}"))
    return F.when(found != "", found).otherwise(F.raise_error(message))


def lookup(key: Column, mapping: Mapping[str, object]) -> Column:
    """Value of a configured mapping, null where the key is unknown.

    The mapping comes from source configuration, so it travels as a literal in the plan.
    """
    if not mapping:
        raise ValueError("mapping is empty")
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def hier_key(level1: Column, level2: Column, sep: str = "|") -> Column:
    return F.when(F.coalesce(level2, F.lit("")) == "", level1).otherwise(
        F.concat(level1, F.lit(sep), level2)
    )


def lookup_hier(level1: Column, level2: Column, mapping: Mapping[str, str], sep: str = "|") -> Column:
    """Mapping of ``level1|level2`` if it is known, else of ``level1`` alone."""
    return F.coalesce(lookup(hier_key(level1, level2, sep), mapping), lookup(level1, mapping))


def interval_end(date: Column, hour: Column) -> Column:
    """End of trade hour 1 to 24 of a date; hour 24 is the next midnight."""
    valid = hour.between(1, 24)
    message = F.concat(F.lit("trade_hour out of 1..24: "), hour.cast("string"))
    checked = F.when(valid | hour.isNull(), hour.cast("int")).otherwise(F.raise_error(message).cast("int"))
    return F.timestamp_add("HOUR", checked, date.cast("date").cast("timestamp_ntz"))


def interval_start(date: Column, hour: Column) -> Column:
    return interval_end(date, hour) - F.expr("interval 1 hour")


def contract_month(label: Column, code: Column, quote_date: Column, root: str = "JKM") -> Column:
    """Delivery month: a ``MMM yyyy`` label if there is one, else letter and year digit of the code.

    The single digit belongs to the decade of the quote; a result more than 30 days before
    the quote rolls on by ten years.
    """

    def bare(col: Column) -> Column:
        return F.trim(F.trim(F.coalesce(col, F.lit(""))), F.lit('"'))

    named = F.trunc(F.try_to_timestamp(F.initcap(bare(label)), F.lit("MMM yyyy")), "month")
    text = bare(code)
    letter = F.upper(F.substring(text, len(root) + 1, 1))
    digit = F.substring(text, len(root) + 2, 1).try_cast("int")
    month = lookup(letter, MONTH_LETTERS)
    decade = (F.floor(F.year(quote_date) / 10) * 10).cast("int")
    this_decade = F.make_date(decade + digit, month, F.lit(1))
    next_decade = F.make_date(decade + 10 + digit, month, F.lit(1))
    decoded = F.when(
        text.startswith(root),
        F.when(this_decade < F.date_sub(quote_date.cast("date"), 30), next_decade).otherwise(this_decade),
    )
    return F.coalesce(named, decoded)


def latest_slot(ts: Column, slots: Sequence[str], delay_minutes: int) -> tuple[Column, Column]:
    """Date and HHMM of the newest publish slot that is callable at ``ts``.

    Before the first slot of a day it is the last slot of the day before.
    """
    ordered = sorted(slots)
    cutoff = ts - F.expr(f"interval {delay_minutes} minutes")
    now = F.date_format(cutoff, "HHmm")
    past = F.array_max(F.filter(F.array(*[F.lit(s) for s in ordered]), lambda s: s <= now))
    day = cutoff.cast("date")
    return F.when(past.isNotNull(), day).otherwise(F.date_sub(day, 1)), F.coalesce(past, F.lit(ordered[-1]))
