"""Deadlines and dates in text. Local times are Europe/Athens; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltion.functions.text import any_term, clean, let, match_positions, norm_text

ZONE = "Europe/Athens"
NO_DEADLINE = "9999"

_LOCAL_FORMATS = ["d-M-yyyy[ H:m[:s]]", "d/M/yyyy[ H:m[:s]]", "yyyy-M-d[ H:m[:s]]", "yyyy-M-d'T'H:m[:s]"]


def _try_formats(c: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def parse_local(c: Column, zone: str = ZONE) -> Column:
    """Local date-time text in any accepted format -> UTC instant."""
    return F.to_utc_timestamp(_try_formats(F.trim(c), _LOCAL_FORMATS), zone)


def deadline_instant(c: Column, zone: str = ZONE) -> Column:
    """The instant a deadline passes: a date without a time lasts to the end of its day."""
    t = F.trim(c)
    local = _try_formats(t, _LOCAL_FORMATS)
    whole_day = ~t.rlike(r"\d[ T]+\d")
    end = F.when(whole_day, local + F.expr("interval 1 day") - F.expr("interval 1 microsecond")).otherwise(local)
    offset = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t.try_cast("timestamp"))
    return F.coalesce(offset, F.to_utc_timestamp(end, zone))


def parse_registry_time(c: Column) -> Column:
    """Act-registry time: epoch seconds or milliseconds, ISO with or without offset, or dd/MM/yyyy."""
    t = F.trim(c)
    number = F.when(t.rlike(r"^\d+$"), t.try_cast("double"))
    epoch = F.timestamp_micros((F.when(number > 1e10, number * 1000).otherwise(number * 1000000)).cast("long"))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))
    return F.coalesce(epoch, iso, F.try_to_timestamp(t, F.lit("d/M/yyyy")))


def sort_key(c: Column) -> Column:
    """Text key that sorts by date: year first; `9999` for text that is no date."""
    local = r"^(\d{2})-(\d{2})-(\d{4})(.*)"
    iso = r"^(\d{4})-(\d{2})-(\d{2})T?(.*)"
    return (
        F.when(c.rlike(local), F.regexp_replace(c, local, "$3-$2-$1$4"))
        .when(c.rlike(iso), F.trim(F.regexp_replace(c, iso, "$1-$2-$3 $4")))
        .otherwise(F.lit(NO_DEADLINE))
    )


def display(c: Column) -> Column:
    """ISO date-time shown as dd-MM-yyyy HH:mm, other text unchanged."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}:\d{2})(?::\d{2}(?:\.\d+)?)?.*$"
    return F.when(c.rlike(iso), F.regexp_replace(c, iso, "$3-$2-$1 $4")).otherwise(F.coalesce(c, F.lit("")))


def audit_time(c: Column) -> Column:
    """10- or 13-digit epoch text to ISO text; empty for missing."""
    t = F.trim(F.coalesce(c, F.lit("")))
    iso = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
    return (
        F.when(t.isin("", NO_DEADLINE), F.lit(""))
        .when(t.rlike(r"^\d{13}$"), F.date_format(F.timestamp_millis(t.try_cast("long")), iso))
        .when(t.rlike(r"^\d{10}$"), F.date_format(F.timestamp_seconds(t.try_cast("long")), iso))
        .otherwise(t)
    )


# How a date is written, day first and year first, with a time or without.
DAY_FIRST = r"(?iu)(\d{1,2})[/-](\d{1,2})[/-](20\d{2})(?:\s*(?:και\s*)?(?:ώρα|ωρα)?\s*(\d{1,2})[:.](\d{2})(?::\d{2})?)?"
YEAR_FIRST = r"(?iu)(20\d{2})-(\d{1,2})-(\d{1,2})(?:[T\s]+(\d{1,2})[:.](\d{2})(?::\d{2}(?:\.\d+)?)?)?"


def extract_dates(text: Column) -> Column:
    """Valid dates in a text: array<struct<m, pos, deadline_at>>, day-first forms before year-first."""

    def read(pattern: str, year: int, month: int, day: int) -> Column:
        def one(hit: Column) -> Column:
            def group(i: int) -> Column:
                return F.regexp_extract(hit["m"], pattern, i)

            def timed(date: Column) -> Column:
                stamp = let(group(4), lambda hour: F.when(hour != "", F.concat(date, F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(group(5), 2, "0"))).otherwise(date))
                return F.when(date.try_cast("date").isNotNull(), stamp)

            # The expression is tried once for each part of a hit; the parts are bound.
            date = F.concat_ws("-", group(year), F.lpad(group(month), 2, "0"), F.lpad(group(day), 2, "0"))
            return F.struct(hit["m"].alias("m"), hit["pos"].alias("pos"), let(date, timed).alias("deadline_at"))

        return F.filter(F.transform(match_positions(text, pattern), one), lambda x: x["deadline_at"].isNotNull())

    return F.concat(read(DAY_FIRST, 3, 2, 1), read(YEAR_FIRST, 1, 2, 3))


def listing_dates(text: Column) -> Column:
    """Dates with optional time as written in a listing row."""
    return F.regexp_extract_all(text, F.lit(r"\b\d{2}[-/]\d{2}[-/]\d{4}(?:\s+\d{2}:\d{2}(?::\d{2})?)?\b"), F.lit(0))


# Wording around a date that makes it a submission deadline, or speaks against it.
DEADLINE_GROUPS = [
    ["προθεσμια", "καταληκτικ", "ληξη"],
    ["υποβολ", "προσφορ"],
    ["διαγωνισμ", "συμβαση"],
    ["παραταση", "παρατειν"],
]
NOT_DEADLINE = ["ημερομηνια δημοσιευση", "ημερομηνια συνεδριαση", "αποσφραγιση", "υπογραφη", "πρωτοκολλ", "φεκ"]
EXTENSION = ["παραταση", "παρατειν", "νεα καταληκτικ"]


def deadline_score(context: Column, groups=DEADLINE_GROUPS, negative=NOT_DEADLINE) -> Column:
    """One point per wording group present, minus one for any speaking against."""

    def count(folded: Column) -> Column:
        score = F.lit(0)
        for group in groups:
            score = score + any_term(folded, group).cast("int")
        return score - any_term(folded, negative).cast("int")

    return let(norm_text(context), count)


def is_extension(context: Column, terms=EXTENSION) -> Column:
    return let(norm_text(context), lambda folded: any_term(folded, terms))


def deadline_evidence(text: Column, radius: int = 260, groups=DEADLINE_GROUPS, negative=NOT_DEADLINE, extension=EXTENSION) -> Column:
    """The best dated deadline statement of a text, or null.

    Best = latest date, then an extension, then confidence min(.98, .55 + .1 score).
    """
    return let(clean(text), lambda flat: _best_statement(flat, radius, groups, negative, extension))


def _best_statement(flat: Column, radius: int, groups, negative, extension) -> Column:
    def weigh(hit: Column) -> Column:
        start = F.greatest(hit["pos"] - radius, F.lit(1))
        context = F.substr(flat, start, hit["pos"] + F.length(hit["m"]) + radius - start)
        return F.struct(hit["deadline_at"].alias("deadline_at"), context.alias("context"), hit["m"].alias("m"))

    def grade(hit: Column) -> Column:
        return let(deadline_score(hit["context"], groups, negative), lambda score: scored(hit, score))

    def scored(hit: Column, score: Column) -> Column:
        return F.struct(
            sort_key(hit["deadline_at"]).alias("key"),
            is_extension(hit["context"], extension).alias("is_extension"),
            F.least(F.lit(0.98), F.lit(0.55) + score * F.lit(0.1)).alias("confidence"),
            score.alias("score"),
            hit["deadline_at"].alias("deadline_at"),
            hit["m"].alias("matched_text"),
            F.substring(hit["context"], 1, 900).alias("snippet"),
        )

    graded = F.filter(F.transform(F.transform(extract_dates(flat), weigh), grade), lambda g: g["score"] > 0)
    return F.array_max(graded)
