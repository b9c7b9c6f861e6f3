"""Date and time columns. The current day is always a parameter (``as_of``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polish names of days and months.
DAYS = ["Poniedziałek", "Wtorek", "Środa", "Czwartek", "Piątek", "Sobota", "Niedziela"]
MONTHS = ["styczeń", "luty", "marzec", "kwiecień", "maj", "czerwiec", "lipiec", "sierpień", "wrzesień", "październik", "listopad", "grudzień"]
MONTHS_OF = ["stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia"]
MONTHS_SHORT = ["STY", "LUT", "MAR", "KWI", "MAJ", "CZE", "LIP", "SIE", "WRZ", "PAŹ", "LIS", "GRU"]
WORD_CLASS = "a-ząćęłńóśźżA-ZĄĆĘŁŃÓŚŹŻ"
ALL_DAY = "Całodniowe"
SCHEDULED = "Według harmonogramu"


def _month_map() -> Column:
    pairs = [x for i, names in enumerate(zip(MONTHS, MONTHS_OF, (m.lower() for m in MONTHS_SHORT), strict=True), 1) for n in dict.fromkeys(names) for x in (F.lit(n), F.lit(i))]
    return F.create_map(*pairs)


def month_number(word: Column) -> Column:
    """1..12 for a Polish month name, genitive or three-letter short form; null for anything else."""
    return F.element_at(_month_map(), F.lower(F.trim(word, F.lit(" ."))))


def make(y: Column, m: Column, d: Column) -> Column:
    """Date of three numbers; null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.try_cast("int"), m.try_cast("int"), d.try_cast("int")))


def part(c: Column, pattern: str, group: int) -> Column:
    """A group of a match; null without a match or if the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def dotted(c: Column) -> Column:
    """First DD.MM.YYYY in the text."""
    p = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    return make(part(c, p, 3), part(c, p, 2), part(c, p, 1))


def worded(c: Column, unknown_month: int | None = None) -> Column:
    """First 'D month YYYY' in the text; an unknown month gives null or the number given."""
    p = rf"(\d{{1,2}})\s+([{WORD_CLASS}]+)\s+(\d{{4}})"
    m = month_number(part(c, p, 2))
    if unknown_month:
        m = F.coalesce(m, F.lit(unknown_month))
    return make(part(c, p, 3), m, part(c, p, 1))


def infer_year(month: Column, as_of: Column, rule: str) -> Column:
    """Year of a date without one.

    'next': months before the current one belong to next year. 'winter': only January and February, seen from
    November on. 'season': earlier months, seen from August on.
    """
    y, m = F.year(as_of), F.month(as_of)
    later = {"next": month < m, "winter": (m >= 11) & (month <= 2), "season": (month < m) & (m >= 8)}[rule]
    return F.when(later, y + 1).otherwise(y)


def worded_no_year(c: Column, as_of: Column, rule: str) -> Column:
    """First 'D month' in the text, the year inferred."""
    p = rf"(\d{{1,2}})\s+([{WORD_CLASS}]+)"
    m = month_number(part(c, p, 2))
    return make(infer_year(m, as_of, rule), m, part(c, p, 1))


def date_range(c: Column, as_of: Column) -> Column:
    """Start and end as struct: 'd.m - d.m.y', 'd-d month [y]', 'do d.m[.y]' (under way: starts today), else one day."""
    p1 = r"(\d{1,2})\.(\d{1,2})(?:\.(\d{4}))?\s*[-–]\s*(\d{1,2})\.(\d{1,2})\.(\d{4})"
    p2 = rf"(\d{{1,2}})\s*[-–]\s*(\d{{1,2}})\s+([{WORD_CLASS}]+)(?:\s+(\d{{4}}))?"
    p3 = r"(?iu)\bdo\s+(\d{1,2})\.(\d{1,2})(?:\.(\d{4}))?"
    made = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    m2, m3 = month_number(part(c, p2, 3)), part(c, p3, 2).try_cast("int")
    y2 = F.coalesce(part(c, p2, 4).try_cast("int"), infer_year(m2, as_of, "winter"))
    end3 = make(F.coalesce(part(c, p3, 3).try_cast("int"), infer_year(m3, as_of, "next")), m3, part(c, p3, 1))
    one = F.coalesce(dotted(c), worded(c))
    return (
        F.when(c.rlike(p1), made(make(F.coalesce(part(c, p1, 3), part(c, p1, 6)), part(c, p1, 2), part(c, p1, 1)), make(part(c, p1, 6), part(c, p1, 5), part(c, p1, 4))))
        .when(m2.isNotNull(), made(make(y2, m2, part(c, p2, 1)), make(y2, m2, part(c, p2, 2)))).when(end3.isNotNull(), made(F.least(as_of, end3), end3)).otherwise(made(one, one))
    )


def month_range(c: Column, as_of: Column) -> Column:
    """A bare month name covers the whole month; February always has 28 days."""
    m = month_number(part(c, rf"([{WORD_CLASS}]+)", 1))
    y = F.coalesce(part(c, r"(\d{4})", 1).try_cast("int"), infer_year(m, as_of, "winter"))
    last = F.when(m == 2, 28).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.struct(make(y, m, F.lit(1)).alias("start"), make(y, m, last).alias("end"))


def compact_timestamp(c: Column) -> Column:
    """YYYYMMDD or YYYY-MM-DD HH:MM:SS, whichever fits."""
    digits = F.regexp_extract(c, r"^\s*(\d{8})\s*$", 1)
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")))


def zoned(c: Column, zone: str = "Europe/Warsaw") -> Column:
    """ISO text as struct(day, time): with Z or an offset it is shown in the zone, else sliced as it stands."""
    has_zone = c.rlike(r"(?i)T\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm:ss")))
    day = F.when(has_zone, F.to_date(local)).otherwise(F.try_to_date(F.substring(c, 1, 10)))
    return F.struct(day.alias("day"), F.when(has_zone, F.date_format(local, "HH:mm")).otherwise(part(c, r"[T ](\d{2}:\d{2})", 1)).alias("time"))


def time_of(c: Column, default: str) -> Column:
    """First HH:MM or HH.MM (after 'godz.' if there), padded; the default if there is none."""
    p = r"(?iu)(?:godz\.?\s*)?\b([01]?\d|2[0-3])[:.]([0-5]\d)\b(?![.\d])"
    return F.when(c.rlike(p), F.concat(F.lpad(F.regexp_extract(c, p, 1), 2, "0"), F.lit(":"), F.regexp_extract(c, p, 2))).otherwise(F.lit(default))


def time_block(c: Column) -> Column:
    """struct(start, end, all_day) of a block with one or two times."""
    times = F.regexp_extract_all(c, F.lit(r"\b(\d{1,2}:\d{2})\b"), 1)
    whole = F.coalesce(F.lower(c).contains("całodzienne"), F.lit(False))
    return F.struct(F.when(whole, ALL_DAY).otherwise(F.get(times, F.lit(0))).alias("start"), F.get(times, F.lit(1)).alias("end"), whole.alias("all_day"))


def long_date(c: Column) -> Column:
    """'Sobota, 10 października' of an ISO date; other text passes through."""
    d = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c))
    return F.coalesce(F.concat(F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(d) + 1), F.lit(", "), F.dayofmonth(d).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS_OF)), F.month(d))), c)


def month_badge(d: Column) -> Column:
    """Three-letter month of a date."""
    return F.element_at(F.array(*map(F.lit, MONTHS_SHORT)), F.month(d))


def minute_of_day(c: Column) -> Column:
    """Minutes of HH:MM; null for other text."""
    p = r"^(\d{1,2}):(\d{2})"
    return part(c, p, 1).try_cast("int") * 60 + part(c, p, 2).try_cast("int")


def times_apart(a: Column, b: Column, minutes: int = 45) -> Column:
    """Do two known times differ by ``minutes`` or more? False if either is unknown."""
    return F.coalesce(F.abs(minute_of_day(a) - minute_of_day(b)) >= minutes, F.lit(False))


def weekend(as_of: Column) -> Column:
    """Friday to Sunday that hold the day, or come next: struct(first, last)."""
    w = F.weekday(as_of)
    friday = F.when(w >= 4, F.date_sub(as_of, w - 4)).otherwise(F.date_add(as_of, 4 - w))
    return F.struct(friday.alias("first"), F.date_add(friday, 2).alias("last"))
