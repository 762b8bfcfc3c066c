"""Column functions with the rounding, null and text rules that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column | str, places: int = 0) -> Column:
    """Round to ``places`` digits; halves go towards plus infinity (so -2.5 becomes -2)."""
    k = float(10**places)
    return F.floor(col(x) * k + 0.5) / F.lit(k)


def exact_sum(x: Column | str, scale: int = 4) -> Column:
    """A sum that does not depend on the order of its terms: added as decimals, given back as a double."""
    return F.sum(col(x).cast(f"decimal(24,{scale})")).cast("double")


def exact_avg(x: Column | str, scale: int = 4) -> Column:
    return exact_sum(x, scale) / F.count(col(x))


def pct_change(now: Column | str, before: Column | str, zero: float | None = None, places: int = 1) -> Column:
    """Change in percent; ``zero`` (0 for trends, null for arrivals) where the base is 0; null if a side is null."""
    a, b = col(now), col(before)
    change = half_up((a - b) / F.nullif(b, F.lit(0.0)) * 100.0, places)
    return F.when(b == 0, F.lit(zero).cast("double")).otherwise(change)


def share_pct(part: Column | str, total: Column | str, places: int = 1) -> Column:
    """Share in percent, 0 if the total is not positive."""
    return F.when(col(total) > 0, half_up(col(part) / F.nullif(col(total), F.lit(0.0)) * 100.0, places)).otherwise(0.0)


def clamp(x: Column | str, low: float, high: float) -> Column:
    """``x`` kept between two bounds; null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def lerp(t: Column | str, a: float, b: float) -> Column:
    return F.lit(a) + (F.lit(b) - F.lit(a)) * col(t)


def turkish_lower(s: Column | str) -> Column:
    """Lower case with dotted and dotless i, for words compared across scripts of names."""
    return F.lower(F.translate(col(s), "İI", "iı"))


def turkish_upper(s: Column | str) -> Column:
    return F.upper(F.translate(col(s), "iı", "İI"))


def cache_key(name: Column | str, code: Column | str | None = None) -> Column:
    """Normalised key of a name, with an upper-case code after ``::`` if one is given."""
    base = turkish_lower(F.trim(col(name)))
    return base if code is None else F.concat_ws("::", base, F.upper(col(code)))


def truthy_or(first: Column | str, second: Column | str) -> Column:
    """The first unless it is null or empty."""
    return F.coalesce(F.nullif(col(first), F.lit("")), col(second))


def braces(s: Column | str) -> Column:
    """From the first opening to the last closing brace, null if there is no such part."""
    return F.nullif(F.regexp_extract(col(s), r"(?s)(\{.*\})", 1), F.lit(""))


def parse_votes(s: Column | str) -> Column:
    """``1,234`` as 1234; null for anything that is no number."""
    return F.replace(col(s), F.lit(","), F.lit("")).try_cast("bigint")


def parse_rating(s: Column | str) -> Column:
    """A finite number, else null."""
    x = col(s).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def split_names(s: Column | str, sep: str = ",") -> Column:
    """Trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(col(s), sep, -1), lambda x: F.trim(x)), lambda x: x != "")


def null_if_na(s: Column | str) -> Column:
    r"""Null for ``\N`` and empty text."""
    return F.nullif(F.nullif(col(s), F.lit("\\N")), F.lit(""))


def iso_date(s: Column | str) -> Column:
    """The date that a text begins with, null if it begins with none."""
    return F.left(col(s), F.lit(10)).try_cast("date")


def confidence(x: Column | str) -> Column:
    """A whole number from 0 to 100; null for what is no number."""
    return clamp(half_up(col(x).try_cast("double")), 0.0, 100.0).cast("int")


def backoff_ms(failures: Column | str, base: int = 300_000, most: int = 21_600_000) -> Column:
    """Wait before the next try: doubled with each failure, up to ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), col(failures) - 1)).cast("bigint")


def compact_number(n: Column | str) -> Column:
    """``1.2k`` from 1000 on, the number itself below."""
    x = col(n)
    k = half_up(x / 1000.0, 1)
    text = F.when(k == F.floor(k), F.floor(k).cast("string")).otherwise(k.cast("string"))
    return F.when(x >= 1000, F.concat(text, F.lit("k"))).otherwise(x.cast("bigint").cast("string"))


def fingerprint(parts: Column, length: int = 16) -> Column:
    """Prefix of the SHA-1 of texts joined by ``|``."""
    return F.left(F.sha1(F.concat_ws("|", parts)), F.lit(length))


def log_distance_score(a: Column | str, b: Column | str) -> Column:
    """2 minus the distance of the logarithms, at least 0; null unless both are positive."""
    x, y = col(a), col(b)
    return F.when((x > 0) & (y > 0), F.greatest(F.lit(0.0), 2 - F.abs(F.ln(x) - F.ln(y))))


def day_difference(later_ms: Column, earlier_ms: Column) -> Column:
    """Elapsed days, rounded (not calendar days)."""
    return F.floor((later_ms - earlier_ms) / float(DAY_MS) + 0.5).cast("int")


def millis(ts: Column | str) -> Column:
    """Epoch milliseconds of a timestamp with or without a zone, in the session's zone (UTC)."""
    return F.unix_millis(col(ts).cast("timestamp"))


def period(year: Column | str, month: Column | str) -> Column:
    return F.concat_ws("-", F.lpad(col(year).cast("string"), 4, "0"), F.lpad(col(month).cast("string"), 2, "0"))


def effective(override: Column | str, value: Column | str) -> Column:
    """The override unless it is null; an empty array is an override."""
    return F.coalesce(col(override), col(value))


def toggled(items: Column | str, item: Column | str) -> Column:
    """Add an item that is absent, remove one that is present."""
    a, x = col(items), col(item)
    return F.when(F.array_contains(a, x), F.array_remove(a, x)).otherwise(F.array_append(a, x))


def trend_label(direction: Column | str, change: Column | str, days: Column | str, insufficient: str = "insufficient") -> Column:
    """Readable trend: an arrow, the signed change and the window."""
    d, c = col(direction), col(change)
    sign = F.when(c > 0, "+").otherwise("")
    arrow = F.when(d == "rising", "up").when(d == "falling", "down").otherwise("flat")
    text = F.concat(arrow, F.lit(" "), sign, c.cast("string"), F.lit("% / "), col(days).cast("string"), F.lit(" d"))
    return F.when(d.isNull() | (d == insufficient), "not enough data").otherwise(text)


def hex_channels(colour: Column | str) -> Column:
    """``#rrggbb`` as three numbers."""
    part = lambda at: F.conv(F.substring(col(colour), at, 2), 16, 10).cast("int")
    return F.array(part(2), part(4), part(6))


def colour_scale(t: Column | str, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """``rgb(r,g,b)`` on a piecewise linear scale through ``stops``, which ascend."""
    x = clamp(t, stops[0][0], stops[-1][0])
    made = None
    for (p, a), (q, b) in reversed(list(zip(stops, stops[1:], strict=False))):
        u = (x - p) / (q - p)
        text = F.concat(F.lit("rgb("), F.concat_ws(",", *[half_up(lerp(u, i, j)).cast("int").cast("string") for i, j in zip(a, b, strict=True)]), F.lit(")"))
        made = text if made is None else F.when(x <= q, text).otherwise(made)
    return made


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Texts whose condition holds, in order, joined by a comma; empty if none does."""
    return F.concat_ws(", ", *[F.when(when, text) for when, text in pairs])


def all_of(*conditions: Column | None) -> Column:
    """Those conditions that are given, and-ed; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def email_key(address: Column | str) -> Column:
    """An e-mail address as it is compared: trimmed, lower case."""
    return F.lower(F.trim(col(address)))


def turkish_number(n: Column | str) -> Column:
    """A whole number with points between groups of three digits."""
    return F.replace(F.format_number(col(n), 0), F.lit(","), F.lit("."))


def year_of(date: Column | str) -> Column:
    """The year that a date's text begins with; null if it does not begin with four digits."""
    return F.left(col(date), F.lit(4)).try_cast("int")


def truncated(s: Column | str, most: int) -> Column:
    """The first ``most`` characters."""
    return F.left(col(s), F.lit(most))


def cookie_map(header: Column | str) -> Column:
    """A cookie header as a map: parts by ``;``, trimmed names and values, values percent-decoded; of equal names the last.

    Parts without ``=`` and without a name go; a value that is no valid encoding is null. Null and empty headers give an empty map.
    """
    pairs = F.filter(F.split(F.coalesce(col(header), F.lit("")), ";", -1), lambda p: F.contains(p, F.lit("=")))
    name = lambda p: F.trim(F.substring_index(p, "=", 1))
    value = lambda p: F.try_url_decode(F.replace(F.trim(F.substr(p, F.instr(p, "=") + 1)), F.lit("+"), F.lit("%2B")))
    named = F.filter(pairs, lambda p: name(p) != "")
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: name(q) == name(p)))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(name(p).alias("name"), value(p).alias("value"))))
