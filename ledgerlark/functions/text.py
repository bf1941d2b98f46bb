"""Text, date and currency expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CHARS_PER_TOKEN, CURRENCIES, CURRENCY_SYMBOLS, TEXT_BUDGET_TOKENS, TRUNCATION_MARK

_EDGE = r"[\p{IsWhite_Space}\x1C-\x1F]+"


def strip(c: Column) -> Column:
    """Without Unicode white space (and the separators U+001C to U+001F) at either end."""
    return F.regexp_replace(c, f"^{_EDGE}|{_EDGE}$", "")


def clean_text(c: Column) -> Column:
    """Stripped text; null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def parse_iso_date(c: Column) -> Column:
    """Date of a calendar or week date in ISO 8601, extended or basic; null for anything else.

    Forms: YYYY-MM-DD, YYYYMMDD, YYYY-Www, YYYY-Www-D, YYYYWww, YYYYWwwD.
    """
    s = strip(c)
    year, basic = F.substring(s, 1, 4), F.regexp_replace(s, "-", "")
    calendar = F.concat_ws("-", F.substring(basic, 1, 4), F.substring(basic, 5, 2), F.substring(basic, 7, 2)).try_cast("date")
    week, day = F.substring(basic, 6, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(basic, 8, 1), F.lit("")).try_cast("int"), F.lit(1))
    y = year.try_cast("int")
    monday = F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date")
    weeks = F.weekofyear(F.make_date(y, F.lit(12), F.lit(28)))
    by_week = F.when(week.between(1, weeks), F.date_add(monday, (week - 1) * 7 + day - 1))
    found = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{8}$"), calendar).when(s.rlike(r"^[0-9]{4}-W[0-9]{2}(-[1-7])?$|^[0-9]{4}W[0-9]{2}[1-7]?$") & (y > 0), by_week)
    return F.when((y > 0) & (found <= F.lit("9999-12-31").cast("date")), found)


def currency_code(c: Column) -> Column:
    """Symbol to code, else the upper-cased text; null where empty. Unknown codes are kept."""
    cleaned = clean_text(c)
    symbols = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    return F.coalesce(symbols[cleaned], F.upper(cleaned))


def known_currency(code: Column) -> Column:
    return code.isin(*CURRENCIES)


def char_count(c: Column) -> Column:
    """What ``F.length`` gives, without its walk from character to character where all are ASCII and bytes are as many.

    Latin-1 reads every byte as a character and each but ASCII takes two bytes again, so only ASCII keeps its size.
    """
    octets = F.octet_length(c)
    ascii_only = F.octet_length(F.decode(c.cast("binary"), "ISO-8859-1")) == octets
    return F.when(ascii_only, octets).otherwise(F.length(c))


def first_chars(c: Column, n: int, chars: Column) -> Column:
    """The first n characters of a text of ``chars`` characters: cut by bytes where these are as many."""
    return F.when(F.octet_length(c) == chars, F.substring(c.cast("binary"), 1, n).cast("string")).otherwise(F.substring(c, 1, n))


def fit_budget(c: Column, tokens: int = TEXT_BUDGET_TOKENS, chars: Column | None = None) -> Column:
    """Struct of the text cut to the budget with a mark at its end, and whether it was cut; ``chars``: its length, where known."""
    limit = tokens * CHARS_PER_TOKEN
    known = char_count(c) if chars is None else chars
    over = known > limit
    cut = F.concat(first_chars(c, limit - len(TRUNCATION_MARK), known), F.lit(TRUNCATION_MARK))
    return F.struct(F.when(over, cut).otherwise(c).alias("text"), F.coalesce(over, F.lit(False)).alias("truncated"))


def mime_base(c: Column) -> Column:
    return F.lower(strip(F.split_part(c, F.lit(";"), F.lit(1))))


def file_stem(invoice_number: Column, invoice_id: Column) -> Column:
    """Safe stem of an export's file name."""
    short = F.substring(invoice_id, 1, 8)
    stem = F.coalesce(F.nullif(invoice_number, F.lit("")), short)
    cleaned = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.concat(F.lit("invoice_"), F.coalesce(F.nullif(cleaned, F.lit("")), short))


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def spaced(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("_"), F.lit(" ")))


def money(c: Column, currency: Column | None = None) -> Column:
    shown = F.format_number(c, 2)
    if currency is not None:
        shown = F.when(F.coalesce(currency, F.lit("")) != "", F.concat_ws(" ", shown, currency)).otherwise(shown)
    return F.coalesce(shown, F.lit("—"))


def fixed(x: Column, digits: int, even: bool = False) -> Column:
    """A double with so many decimals (one or two), rounded by its exact binary value, ties away from zero or to even."""
    size = F.abs(x.cast("double"))
    whole, one = F.floor(size), F.lit(2**60).cast("decimal(20,0)")
    part = ((size - whole) * F.lit(float(2**60))).cast("bigint").cast("decimal(20,0)")
    scaled, half = part * F.lit(10**digits).cast("decimal(4,0)"), F.lit(2**59).cast("decimal(20,0)")
    units = F.call_function("div", scaled + half, one)
    if even:
        units = units - F.when((scaled % one == half) & (units % 2 == 1), 1).otherwise(0)
    total, unit = whole.cast("bigint") * 10**digits + units, F.lit(10**digits).cast("bigint")
    shown = F.format_string(f"%d.%0{digits}d", F.call_function("div", total, unit), total % unit)
    shown = F.when(size < 1e15, shown).otherwise(F.format_string(f"%.{digits}f", size))
    return F.when(x < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def percent(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull(), F.lit("—")).otherwise(F.concat(fixed(c * 100, digits), F.lit("%")))


def duration(ms: Column) -> Column:
    shown = F.when(ms >= 60000, F.concat(fixed(ms / 60000, 1), F.lit(" min"))).when(ms >= 1000, F.concat(fixed(ms / 1000, 1), F.lit(" s")))
    return F.when(ms.isNull(), "—").otherwise(F.coalesce(shown, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))))


def tokens(n: Column) -> Column:
    return F.when(n >= 1000000, F.concat(fixed(n / 1000000, 2), F.lit("M"))).when(n >= 1000, F.concat(fixed(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))


def day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd MMM yyyy"), F.lit("—"))


def moment(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd MMM yyyy, HH:mm"), F.lit("—"))
