"""Reading timestamps as they are written: one pattern per family of formats, all JVM-side.

Each pattern rewrites a value into ``year|month|day|hour|minute|second|fraction|half|zone``;
the first that matches holds. Figures-only dates whose order is open carry a ``?``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import fold

# fixed values: month names in French and English and their abbreviations, without accents
MONTHS = {
    1: "janvier janv jan january",
    2: "fevrier fevr fev feb february",
    3: "mars mar march",
    4: "avril avr april apr",
    5: "mai may",
    6: "juin june jun",
    7: "juillet juil july jul",
    8: "aout august aug",
    9: "septembre sept september sep",
    10: "octobre oct october",
    11: "novembre nov november",
    12: "decembre dec december",
}
# fixed values: words that may stand before a date
LEAD = (
    r"^(?:(?:publie|mis a jour|modifie|mise a jour|published|updated|posted|modified|on|le|the|date)[ :]+|"
    r"(?:lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|monday|tuesday|wednesday|thursday|friday|saturday|sunday|"
    r"mon|tue|wed|thu|fri|sat|sun)[,.]? )+"
)

_Z = r"(z|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?(?:\[[a-z_+\-/0-9]+\])?|[a-z]{2,5})"
_T = r"(\d{1,2})(?::| ?h ?)(\d{2})?(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_H = r"(a\.?m\.?|p\.?m\.?)?"
_NAME = r"([a-z]{3,9})\.?"
#: (pattern, rewriting) in order of trial
FORMATS = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[t ]{_T} ?{_Z}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}) {_T} ?{_Z}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))? ?{_Z}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^d:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?(?:z'?|([+-]\d{2})'?(\d{2})'?)$", "$1|$2|$3|$4|$5|$6|||z$7$8"),
    (r"^d:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?$", "$1|$2|$3|$4|$5|$6|||"),
    (rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}}),? (?:a |at |- )?{_T} ?{_H} ?{_Z}?$", "$3|$1|$2?|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})(?:er|st|nd|rd|th)? {_NAME} (\d{{4}}),? (?:a |at |- )?{_T} ?{_H} ?{_Z}?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_NAME} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),? (?:a |at |- )?{_T} ?{_H} ?{_Z}?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)


def parts(value: Column) -> Column:
    """The nine parts as an array of strings, or null if no pattern matches."""
    v = F.regexp_replace(fold(value), LEAD, "")
    out = F.lit(None).cast("string")
    for pattern, rewriting in reversed(FORMATS):
        out = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, rewriting)).otherwise(out)
    return F.split(out, r"\|", -1)


def epoch_micros(value: Column) -> Column:
    """Microseconds of an epoch count in seconds, milli- or microseconds, told by its length."""
    v = F.trim(value)
    n = F.expr("try_cast(NULL as bigint)")
    for digits, factor in ((10, 1_000_000), (13, 1_000), (16, 1)):
        n = F.when(v.rlike(rf"^\d{{{digits}}}$"), v.try_cast("bigint") * factor).otherwise(n)
    return n


def _month() -> Column:
    names = [x for m, words in MONTHS.items() for w in words.split() for x in (F.lit(w), F.lit(m))]
    return F.create_map(*names)


def local_micros(p: Column, day_order: Column) -> Column:
    """Microseconds of the clock time in ``p`` read as UTC; null if it isn't a date and time.

    ``day_order`` (DMY or MDY) orders figures-only dates; where it is null only
    figures that allow one order are read.
    """
    num = lambda i: p[i].try_cast("int")
    open_order = p[2].endswith("?")
    a, b = num(1), F.regexp_replace(p[2], r"\?$", "").try_cast("int")
    order = F.coalesce(day_order, F.when((a > 12) & (b <= 12), "DMY").when((b > 12) & (a <= 12), "MDY").when(a == b, "DMY"))
    month = F.when(open_order, F.when(order == "DMY", b).when(order == "MDY", a)).otherwise(
        F.coalesce(a, F.try_element_at(_month(), p[1]))
    )
    day = F.when(open_order, F.when(order == "DMY", a).when(order == "MDY", b)).otherwise(b)
    year = F.when(F.length(p[0]) == 2, num(0) + 2000).otherwise(num(0))
    half = F.substring(p[7], 1, 1)
    h = num(3)
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    minute = F.when(p[4] == "", 0).otherwise(num(4))
    second = F.when(p[5] == "", 0).otherwise(num(5))
    fraction = F.coalesce(F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("int"), F.lit(0))
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    known = year.isNotNull() & month.isNotNull() & day.isNotNull()
    clock = (hour * 3600 + minute * 60 + second).cast("bigint") * 1_000_000 + fraction
    return F.when(known & ok, F.unix_date(date).cast("bigint") * 86_400_000_000 + clock)


def offset_micros(zone: Column) -> Column:
    """Microseconds of an explicit offset (``z``, ``utc``, ``gmt``, ``+02:00``, ``utc-4``, ``z+0530``); null otherwise."""
    z = F.regexp_replace(zone, r"\[.*\]$", "")
    pattern = r"^(?:z|utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    sign = F.when(F.regexp_extract(z, pattern, 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(z, pattern, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(z, pattern, 3).try_cast("int"), F.lit(0))
    there = F.when((hours <= 18) & (minutes < 60), (sign * (hours * 60 + minutes)).cast("bigint") * 60_000_000)
    return F.when(z.isin("z", "utc", "gmt", "ut"), F.lit(0).cast("bigint")).when(z.rlike(pattern), there)
