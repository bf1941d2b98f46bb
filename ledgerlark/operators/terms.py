"""Payment terms as dated instalments, and the cash they need by week.

A text of terms has parts divided by ``;``, ``,``, ``+`` or "and", each an instalment. A part may begin with its share
in per cent and with a discount for early payment ("2/10": 2 % within 10 days). It is due

* at once: "due on receipt", "upon receipt", "immediate", "cash on delivery", "COD", "prepaid";
* n days on: "net 30", "n/30", "n30", "30 days", "in 30 days";
* at the end of the month, or n days after it: "EOM", "end of month", "net 30 EOM";
* on a day of the next month, the last one if it has fewer: "15 MFI", "15th of the following month".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bound

DEFAULT_DAYS = 30
_AT_ONCE = r"\b(due (on|upon) receipt|upon receipt|on receipt|immediate(ly)?|cash on delivery|c\.?o\.?d\b|prepaid|in advance)"
_MONTH_END = r"\b(eom|e\.o\.m\.?|end of (the )?month)"
_NEXT_MONTH = r"\b([0-9]{1,2})(st|nd|rd|th)? *(mfi|(of )?(the )?(following|next) month)"
_DAYS = r"(?:\bnet *|\bn */? *|\bin *|\bwithin *)([0-9]{1,4})\b|\b([0-9]{1,4}) *days?\b"
_SHARE = r"^([0-9]{1,3}(?:\.[0-9]+)?) *%(?! */)"
_DISCOUNT = r"\b([0-9]{1,2}(?:\.[0-9]+)?) *%? */ *([0-9]{1,3})\b"


def _number(text: Column, pattern: str, group: int, kind: str) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast(kind)


def _part(text: Column, date: Column) -> Column:
    """due, share, discount and discount_until of one part; a part that says no date has due null."""

    def found(rest: Column) -> Column:
        days = F.coalesce(_number(rest, _DAYS, 1, "int"), _number(rest, _DAYS, 2, "int"))
        return F.struct(rest.alias("rest"), days.alias("days"), _number(rest, _NEXT_MONTH, 1, "int").alias("day"))

    def dated(v: Column) -> Column:
        end = F.last_day(date)
        following = F.least(F.date_add(end, v["day"]), F.last_day(F.date_add(end, 1)))
        due = F.when(v["day"] > 0, following).when(v["rest"].rlike(_MONTH_END), F.date_add(end, F.coalesce(v["days"], F.lit(0)))).when(v["days"].isNotNull(), F.date_add(date, v["days"])).when(v["rest"].rlike(_AT_ONCE), date)
        within = _number(text, _DISCOUNT, 2, "int")
        return F.struct(due.alias("due"), _number(text, _SHARE, 1, "decimal(9,4)").alias("share"), _number(text, _DISCOUNT, 1, "decimal(5,2)").alias("discount"), F.date_add(date, within).alias("discount_until"))

    return bound(bound(F.regexp_replace(text, _DISCOUNT, " "), found), dated)


def instalments(terms: Column, date: Column) -> Column:
    """An array of structs part, due, share (of 100), discount, discount_until; null where the date is.

    Parts without a share divide what is left of 100. Terms that are null, say no date in some part, or whose shares are
    not 100 together are one instalment due in ``DEFAULT_DAYS`` days.
    """
    text = F.trim(F.regexp_replace(F.lower(terms), r"\s+", " "))
    parts = F.filter(F.split(text, r" *(?:[;,+]|\band\b) *"), lambda p: p != "")

    def shared(read: Column) -> Column:
        zero = F.lit(0).cast("decimal(18,4)")
        given = F.aggregate(read, zero, lambda n, p: (n + F.coalesce(p["share"], zero)).cast("decimal(18,4)"))
        return bound(F.struct(read.alias("read"), given.alias("given"), F.size(F.filter(read, lambda p: p["share"].isNull())).alias("open")), divided)

    def divided(v: Column) -> Column:
        """The parts with their shares, null where they don't make a plan."""
        each = ((F.lit(100) - v["given"]) / F.nullif(v["open"], F.lit(0))).cast("decimal(9,4)")
        fit = (F.size(v["read"]) > 0) & F.forall(v["read"], lambda p: p["due"].isNotNull()) & F.when(v["open"] > 0, v["given"] < 100).otherwise(v["given"] == 100)
        return F.when(fit, F.transform(v["read"], lambda p, k: F.struct((k + 1).alias("part"), p["due"].alias("due"), F.coalesce(p["share"], each).alias("share"), p["discount"].alias("discount"), p["discount_until"].alias("discount_until"))))

    one = F.array(F.struct(F.lit(1).alias("part"), F.date_add(date, DEFAULT_DAYS).alias("due"), F.lit(100).cast("decimal(9,4)").alias("share"), F.lit(None).cast("decimal(5,2)").alias("discount"), F.lit(None).cast("date").alias("discount_until")))
    return F.when(date.isNotNull(), F.coalesce(bound(F.transform(parts, lambda p: _part(p, date)), shared), one))


def payment_plan(invoices: DataFrame) -> DataFrame:
    """id, part, due, amount, discount_until, discounted: a row for each instalment of ``invoices(id, invoice_date, payment_terms, grand_total)``.

    Amounts are rounded to cents so that they add up to the total: each is the part of the total up to it less that before.
    discounted is what is enough until discount_until. Invoices without a date or a total have no rows.
    """
    rows = invoices.where("grand_total is not null and invoice_date is not null").select("id", "grand_total", instalments(F.col("payment_terms"), F.col("invoice_date")).alias("_all"))
    rows = rows.select("*", F.posexplode_outer("_all").alias("_k", "i"))  # outer: an inner one tests the array's size first, which reads the terms once more
    upto = lambda n: F.aggregate(F.slice("_all", F.lit(1), n), F.lit(0).cast("decimal(18,4)"), lambda s, p: (s + p["share"]).cast("decimal(18,4)"))
    whole = F.size("_all")
    part = lambda n: F.when(n == whole, F.col("grand_total").cast("decimal(18,2)")).otherwise(F.round(F.col("grand_total") * upto(n) / 100, 2).cast("decimal(18,2)"))
    before = F.when(F.col("_k") == 0, F.lit(0).cast("decimal(18,2)")).otherwise(part(F.col("_k")))
    amount = (part(F.col("_k") + 1) - before).cast("decimal(18,2)")
    discounted = F.round(amount * (100 - F.col("i.discount")) / 100, 2).cast("decimal(18,2)")
    return rows.select("id", "i.part", "i.due", amount.alias("amount"), "i.discount_until", discounted.alias("discounted"))


def cash_flow(plan: DataFrame, early: bool = False) -> DataFrame:
    """week, due, payments: the cash that a payment plan needs by week; ``early`` takes every discount on its last day."""
    day = F.coalesce("discount_until", "due") if early else F.col("due")
    amount = F.coalesce("discounted", "amount") if early else F.col("amount")
    return plan.groupBy(F.date_trunc("week", day).cast("date").alias("week")).agg(F.sum(amount).alias("due"), F.count("*").alias("payments"))
