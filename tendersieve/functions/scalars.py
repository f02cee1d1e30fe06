"""Column functions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters with marks and their plain twins; fixed values.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
#: Legal forms at a company name's end: initials, which may have dots and blanks between, and words; fixed values.
FORM_INITIALS = ("SAU", "SLU", "SAS", "SLP", "SLNE", "SCP", "SA", "SL", "SC", "NV", "UTE")
FORM_WORDS = ("SOCIEDAD ANONIMA UNIPERSONAL", "SOCIEDAD ANONIMA", "SOCIEDAD LIMITADA UNIPERSONAL", "SOCIEDAD LIMITADA", "SOCIEDAD COOPERATIVA", "COMPANIA", "S\\.?\\s?COOP\\.?", "GMBH", "LTD", "LLC", "INC", "AG", "BV")
LEGAL_FORM = r"(^|[\s,.\-])(" + "|".join([*(r"\.?\s?".join(x) + r"\.?" for x in FORM_INITIALS), *(x.replace(" ", r"\s+") for x in FORM_WORDS)]) + r")\s*$"
#: How many legal forms one name may end in.
FORMS = 4
#: Months in one unit of a contract's duration, and how units are written out; fixed values.
MONTHS_PER_UNIT = {"ANN": 12.0, "MON": 1.0, "WEK": 7 / 30.4375, "DAY": 1 / 30.4375, "HUR": 1 / 730}
UNIT_WORDS = {"mes": "MON", "ano": "ANN", "year": "ANN", "sem": "WEK", "dia": "DAY", "day": "DAY", "hor": "HUR"}
#: Statuses after which a tender takes no more bids; fixed values.
CLOSED = ("RES", "ADJ", "ANUL", "AGR", "EJEC")
#: Control letters of tax ids, and which organisations' control is a letter or a digit; fixed values.
PERSON_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
COMPANY_LETTERS = "JABCDEFGHI"
LETTER_ONLY, DIGIT_ONLY = "KPQSNW", "ABEH"


def fold(c: Column) -> Column:
    """Without accents, lower case."""
    return F.lower(F.translate(c, MARKED, PLAIN))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def iso_guard(c: Column) -> Column:
    """ISO text in a plausible range; compares as text, so malformed dates fall out."""
    return (c >= "1900") & (c < "3000")


def next_day(c: Column) -> Column:
    """Exclusive upper bound that keeps a whole last day."""
    return F.date_add(F.to_date(c), 1)


def is_open(status: Column, closed: tuple[str, ...] = CLOSED) -> Column:
    """An unknown status counts as open."""
    return status.isNull() | ~status.isin(*closed)


def code_key(c: Column) -> Column:
    """Code without blanks and leading zeros; a lone zero stays."""
    bare = F.regexp_replace(F.trim(c), "^0+", "")
    return F.when(F.trim(c) == "", None).when(bare == "", "0").otherwise(bare)


def tax_id(c: Column) -> Column:
    return blank_to_null(F.upper(F.regexp_replace(c, r"[\s\-.]", "")))


def tax_id_class(c: Column) -> Column:
    """dni, nie or cif with a right control character, invalid with a wrong one or none at all, foreign for any other shape."""
    s = tax_id(c)
    letter = lambda number: F.substring(F.lit(PERSON_LETTERS), (number.cast("long") % 23 + 1).cast("int"), F.lit(1))
    digit = lambda i: F.substring(s, i + 1, 1).cast("int")
    doubled = lambda i: F.floor(digit(i) * 2 / 10) + digit(i) * 2 % 10
    control = (10 - (digit(2) + digit(4) + digit(6) + doubled(1) + doubled(3) + doubled(5) + doubled(7)) % 10) % 10
    as_letter = F.substring(F.lit(COMPANY_LETTERS), (control + 1).cast("int"), F.lit(1))
    kind, last = F.substring(s, 1, 1), F.substring(s, 9, 1)
    right = F.when(F.contains(F.lit(LETTER_ONLY), kind), last == as_letter).when(F.contains(F.lit(DIGIT_ONLY), kind), last == control.cast("string")).otherwise((last == as_letter) | (last == control.cast("string")))
    nie = F.concat(F.translate(kind, "XYZ", "012"), F.substring(s, 2, 7))
    judged = F.when(s.rlike("^[0-9]{8}[A-Z]$"), F.when(letter(F.substring(s, 1, 8)) == last, "dni").otherwise("invalid"))
    judged = judged.when(s.rlike("^[XYZ][0-9]{7}[A-Z]$"), F.when(letter(nie) == last, "nie").otherwise("invalid"))
    judged = judged.when(s.rlike("^[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]$"), F.when(right, "cif").otherwise("invalid"))
    return F.when(s.isNull(), "invalid").otherwise(judged.otherwise("foreign"))


def company_name(c: Column) -> Column:
    """Upper case, no accents, no legal forms at the end (up to ``FORMS``, before and after punctuation goes), blanks collapsed."""
    name = F.btrim(F.upper(F.translate(c, MARKED, PLAIN)))
    for _ in range(FORMS):
        name = F.btrim(F.regexp_replace(name, LEGAL_FORM, ""), F.lit(" ,.-"))
    name = F.btrim(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    for _ in range(FORMS):
        name = F.btrim(F.regexp_replace(name, LEGAL_FORM, ""))
    return blank_to_null(name)


#: How names of joint ventures begin or end, and what stands between their members.
VENTURE_HEAD = r"(?i)^\s*U\.?\s*T\.?\s*E(?:\.[\s:\-]*|[\s:\-]+|$)"
VENTURE_TAIL = r"(?i)\bU\.?T\.?E\.?\s*$"
BETWEEN_MEMBERS = r"(?i)\s*(?:\s[-–—]\s|/|[,;]\s|\s(?:Y|AND)\s)\s*"


def joint_venture_members(c: Column) -> Column:
    """The normalised, distinct names of a joint venture's members in order; empty for any other name."""
    raw = F.btrim(c)
    marks = F.lit(" ,.-")
    body = F.when(raw.rlike(VENTURE_HEAD), F.regexp_replace(raw, VENTURE_HEAD, "")).when(raw.rlike(VENTURE_TAIL), F.regexp_replace(raw, VENTURE_TAIL, ""))
    body = F.btrim(F.regexp_replace(F.btrim(body), r"\s*\([^)]*\)\s*$", ""), marks)
    names = F.transform(F.split(body, BETWEEN_MEMBERS), lambda x: company_name(F.btrim(x, marks)))
    return F.coalesce(F.array_distinct(F.filter(names, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def words(c: Column, least: int = 1) -> Column:
    """Distinct folded words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"([a-z0-9]{%d,})" % least), F.lit(1)))


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def csv_values(c: Column) -> Column:
    """Trimmed, distinct, non-blank values of a comma-separated text."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != ""))


def pct_delta(before: Column, after: Column) -> Column:
    """Change in percent; 0.0 where there was nothing before."""
    return F.when(before == 0, 0.0).otherwise((after - before) / F.abs(before) * 100)


def variation(current: Column, previous: Column) -> Column:
    """Change in percent, one decimal; 0 if both are 0, null if only the previous one is."""
    return F.when((current == 0) & (previous == 0), 0.0).when(previous != 0, F.round((current - previous) / previous * 100, 1))


def discount(budget: Column, awarded: Column) -> Column:
    """Share of the budget that the award saves; null without a budget."""
    return F.when((budget > 0) & awarded.isNotNull(), (budget - awarded) / budget)


def valid_pair(budget: Column, awarded: Column, tolerance: float = 1.5) -> Column:
    """A budget and an award that can belong together."""
    return (budget > 0) & (awarded > 0) & (awarded <= tolerance * budget)


def nearly_equal(a: Column, b: Column, rel: float = 1e-5, least: float = 1e-9) -> Column:
    """Equal but for float noise; nulls equal each other."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(least)))


def unit_code(unit: Column) -> Column:
    """The code of a duration's unit, given as the code or written out; null if it is neither."""
    bare = F.trim(unit)
    out = F.when(F.upper(bare).isin(*MONTHS_PER_UNIT), F.upper(bare))
    for word, code in UNIT_WORDS.items():
        out = out.when(F.startswith(fold(bare), F.lit(word)), code)
    return out


def months(value: Column, unit: Column) -> Column:
    """A duration in months; null for an unknown unit."""
    known = F.create_map(*[F.lit(x) for pair in MONTHS_PER_UNIT.items() for x in pair])
    return value * F.try_element_at(known, unit_code(unit))


def utc_instant(c: Column) -> Column:
    """ISO text as an instant; without an offset it means UTC, a date alone its midnight. Null for anything else.

    The session's time zone must be UTC, as everywhere in this library.
    """
    return F.try_to_timestamp(F.trim(c))


def local_deadline_hour(c: Column, zone: str = "Europe/Madrid") -> Column:
    """HH:mm in ``zone`` of a deadline kept in UTC; null for a date alone, or where the local day is another one."""
    local = F.from_utc_timestamp(utc_instant(c), zone)
    same_day = F.date_format(local, "yyyy-MM-dd") == F.substring(F.trim(c), 1, 10)
    return F.when((F.length(F.trim(c)) > 10) & same_day, F.date_format(local, "HH:mm"))


def utc_deadline(day: Column, time: Column, zone: str = "Europe/Madrid") -> Column:
    """ISO text in UTC of a day and a local time (one with an offset keeps it); the day alone if the time can't be read."""
    date, hour = iso_date(day), F.trim(time)
    fixed = hour.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    stamp = F.try_to_timestamp(F.concat(date, F.lit("T"), hour))
    instant = F.when(fixed, stamp).otherwise(F.to_utc_timestamp(stamp, zone))
    return F.coalesce(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), date)


def easter(year: Column) -> Column:
    """Easter Sunday of a year (Gregorian computus)."""
    div = lambda x, n: F.floor(x / n)
    century = div(year, 100)
    moon = (19 * (year % 19) + century - div(century, 4) - div(8 * century + 13, 25) + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * div(year % 100, 4) - moon - year % 100 % 4) % 7
    shift = moon + week - 7 * div(year % 19 + 11 * moon + 22 * week, 451) + 114
    return F.make_date(year, div(shift, 31).cast("int"), (shift % 31 + 1).cast("int"))


#: (month, day) of holidays of the whole country; fixed values.
HOLIDAYS = ((1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25))


def is_business_day(day: Column) -> Column:
    """No weekend, national holiday or Good Friday."""
    fixed = F.struct(F.month(day), F.day(day)).isin(*[F.struct(F.lit(m), F.lit(d)) for m, d in HOLIDAYS])
    return (F.weekday(day) < 5) & ~fixed & (day != F.date_sub(easter(F.year(day)), 2))


def proportional_points(cut: Column, best: Column, most: Column) -> Column:
    """Points in proportion to the price cut, against the best cut; all get the most if nobody cuts."""
    return F.when(best <= 0, most).otherwise(most * F.least(cut / best, F.lit(1.0)))


def inverse_price_points(cut: Column, best: Column, most: Column) -> Column:
    """Points by lowest price over own price, written in cuts."""
    return F.when((cut >= 1) | (cut >= best), most).otherwise(most * (1 - best) / (1 - cut))


def stepped_points(cut: Column, steps: list[tuple[float, float]], most: Column) -> Column:
    """The highest points of the steps (least cut, points) that a cut reaches, at most ``most``; 0 below all."""
    return F.least(most, F.greatest(F.lit(0.0), *[F.when(cut >= least, points).otherwise(0.0) for least, points in steps]))


def code_similarity(code: Column, codes: tuple[str, ...]) -> Column:
    """1 for one of the codes, 0.8 for the first four characters of one, else 0."""
    bare = F.trim(code)
    heads = [x[:4] for x in codes if len(x) >= 4]
    return F.when(bare.isin(*codes), 1.0).when((F.length(bare) >= 4) & F.substring(bare, 1, 4).isin(*heads), 0.8).otherwise(0.0)


def keyword_affinity(text: Column, keywords: tuple[str, ...]) -> Column:
    """A third for each different keyword that stands as a word, at most 1."""
    padded = F.concat(F.lit(" "), F.regexp_replace(fold(text), "[^a-z0-9]+", " "), F.lit(" "))
    hits = sum((F.when(F.contains(padded, F.lit(f" {k} ")), 1).otherwise(0) for k in keywords), F.lit(0))
    return F.coalesce(F.least(hits / 3, F.lit(1.0)), F.lit(0.0))


def urgency(days_left: Column, horizon: int) -> Column:
    """From 1 today to 0 at the horizon."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days_left / horizon))


def band(value: Column, edges: list[tuple[float, str]], above: str) -> Column:
    """The name of the first edge that the value is below."""
    out = None
    for edge, name in edges:
        out = F.when(value < edge, name) if out is None else out.when(value < edge, name)
    return F.when(value.isNotNull(), out.otherwise(above))


def competition_band(bids: Column) -> Column:
    return band(bids, [(2, "1"), (5, "2-4")], "5+")


def money(c: Column) -> Column:
    """1.234,56 and 1234.56 to a number; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[€\s]", ""), r"\.(?=\d{3}(\D|$))", "")
    return F.regexp_replace(plain, ",", ".").try_cast("double")


def iso_date(c: Column) -> Column:
    """ISO text of YYYY-MM-DD, DD/MM/YYYY or DD-MM-YYYY (time cut off); anything else is passed through."""
    day = F.coalesce(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), F.try_to_date(c, "dd/MM/yyyy"), F.try_to_date(c, "dd-MM-yyyy"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), c)


def iso_week(day: Column) -> Column:
    """The Monday of the day's week, as text."""
    return F.date_format(F.date_trunc("week", day), "yyyy-MM-dd")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
