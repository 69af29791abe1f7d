"""Header and URL text: link targets, retry delays, query encoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def header(headers: Column, name: str) -> Column:
    """Header value whatever the case it was landed in."""
    wanted = name.lower()
    return F.coalesce(
        headers[name],
        F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == wanted), F.lit(0))[
            "value"
        ],
    )


def next_link(link: Column) -> Column:
    """Target of the first ``rel=next`` link, NULL when there is none."""
    parts = F.transform(
        F.split(link, ","), lambda p: F.transform(F.split(p, ";"), lambda s: F.trim(s))
    )
    hits = F.filter(
        parts,
        lambda p: p[0].rlike("(?s)^<.*>$")
        & F.exists(
            F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
            lambda s: F.replace(s, F.lit('"'), F.lit("")) == "rel=next",
        ),
    )
    return F.nullif(F.regexp_replace(F.try_element_at(hits, F.lit(1))[0], "^[<>]+|[<>]+$", ""), F.lit(""))


def retry_after_seconds(value: Column, answered_at: Column) -> Column:
    """Seconds asked for by ``Retry-After``; NULL when absent, past, zero or unreadable.

    A date may be in any of the three forms of HTTP; one without a zone is UTC.
    """
    seconds = F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("int"))
    spaced = F.regexp_replace(value, " +", " ")
    when = F.coalesce(
        F.try_to_timestamp(F.substring(value, 6, 64), F.lit("dd MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(F.regexp_extract(value, "^[A-Za-z]+day, (.*)$", 1), F.lit("dd-MMM-yy HH:mm:ss z")),
        F.try_to_timestamp(F.substring(spaced, 5, 64), F.lit("MMM d HH:mm:ss yyyy")),
    )
    dated = (F.unix_micros(when) - F.unix_micros(answered_at)) / F.lit(1e6)
    asked = F.when(seconds >= 0, seconds.cast("double")).otherwise(dated)
    return F.when(asked > 0, asked)


def doubling_backoff(attempt: Column, cap: int) -> Column:
    """Seconds before an attempt when upstream named no delay: 1, 2, 4, ... up to the cap."""
    return F.least(F.pow(F.lit(2.0), F.greatest(attempt - 2, F.lit(0))), F.lit(float(cap)))


def query_escape(text: Column) -> Column:
    """Percent-encode one query key or value, space as plus."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
