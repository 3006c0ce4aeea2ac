"""Numbers written in text: parsing, formatting, nearest number, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltion.functions.text import clean, let, squeeze

MONEY = "decimal(24,6)"


def parse_locale_number(c: Column, dtype: str = MONEY) -> Column:
    """Number written with either separator convention; null when it is none.

    The rightmost separator is the decimal one when both occur; a lone comma is decimal; dots
    that only group triplets are thousands separators; a trailing `*` is ignored.
    """
    bare = F.regexp_replace(squeeze(c), r"\*+$", "")
    return let(bare, _decimal_text).try_cast(dtype)


def _decimal_text(t: Column) -> Column:
    """A bare number with the decimal point where it belongs and no thousands separators."""
    no_dots = F.replace(t, F.lit("."), F.lit(""))
    comma_decimal = F.replace(no_dots, F.lit(","), F.lit("."))
    has_comma, has_dot = t.contains(","), t.contains(".")
    return (
        F.when(has_comma & has_dot & t.rlike(r"\.[^.,]*$"), F.replace(t, F.lit(","), F.lit("")))
        .when(has_comma, comma_decimal)
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), no_dots)
        .when(
            t.rlike(r"\..*\."),
            F.concat(F.replace(F.regexp_extract(t, r"^(.*)\.", 1), F.lit("."), F.lit("")), F.lit("."), F.regexp_extract(t, r"\.([^.]*)$", 1)),
        )
        .otherwise(t)
    )


def parse_plain_number(c: Column) -> Column:
    """Number inside running text: comma is decimal, dots group only when a comma follows."""
    return let(clean(c), _plain_text).try_cast("double")


def _plain_text(t: Column) -> Column:
    return F.when(t.contains(","), F.replace(F.when(t.contains("."), F.replace(t, F.lit("."), F.lit(""))).otherwise(t), F.lit(","), F.lit("."))).otherwise(t)


def format_budget(c: Column) -> Column:
    """I4: `1.234,56 EUR`; empty for null."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(" EUR")))


def budget_value(c: Column) -> Column:
    """Sortable budget from a string that may carry a currency suffix."""
    return parse_locale_number(F.regexp_replace(c, r"(?i)\s*(€|eur)\s*$", ""))


def number_near(context: Column, anchor_pos: Column) -> Column:
    """From the anchor on, the smallest decimal in (0, 1000), else the smallest number there."""
    tail = F.when(anchor_pos > 0, F.substr(context, anchor_pos)).otherwise(context)

    def smallest(pattern: str) -> Column:
        values = F.transform(F.regexp_extract_all(tail, F.lit(pattern), F.lit(0)), parse_plain_number)
        return F.array_min(F.filter(values, lambda x: (x > 0) & (x < 1000)))

    return F.coalesce(smallest(r"\d+[,.]\d+"), smallest(r"\d+(?:[.,]\d+)*"))


AMOUNT = r"\d{1,3}(?:\.\d{3})*,\d{2}"


def budget_from_row_text(c: Column) -> Column:
    """Last amount written before the first date of a listing row."""
    head = F.split(c, r"\d{2}-\d{2}-\d{4}", 2)[0]
    return parse_locale_number(F.try_element_at(F.regexp_extract_all(head, F.lit(AMOUNT), F.lit(0)), F.lit(-1)))


def first_amount(c: Column) -> Column:
    """First amount of a text, as written."""
    return F.nullif(F.regexp_extract(c, rf"\b{AMOUNT}\b", 0), F.lit(""))


def compare_op(left: Column, op: Column, right: Column) -> Column:
    """C14: comparison whose operator is data; false for an unknown operator."""
    return (
        F.when(op == ">", left > right)
        .when(op == ">=", left >= right)
        .when(op == "<", left < right)
        .when(op == "<=", left <= right)
        .when(op.isin("=", "=="), left == right)
        .otherwise(F.lit(False))
    )
