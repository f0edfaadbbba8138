"""Ages, decays, cadences and foreign time formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK_DAYS = 0.25


def days_between(later: Column, earlier: Column) -> Column:
    """Days with their fraction, of two timestamps of one kind."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def release_freshness(age_years: Column) -> Column:
    """1 for unknown ages, then falling in three lines to .1."""
    return F.when(age_years.isNull(), 1.0).when(age_years <= 5, 1 - 0.06 * age_years).when(age_years <= 20, 0.70 - 0.20 / 15 * (age_years - 5)).otherwise(F.greatest(0.50 - 0.01 * (age_years - 20), F.lit(0.10)))


def timespan_ms(span: Column) -> Column:
    """Milliseconds of ``[d.]HH:MM:SS[.fffffff]``; null if it isn't one."""
    p = r"^(?:(\d+)\.)?(\d+):(\d+):(\d+)(?:\.(\d{1,7})\d*)?$"
    s = F.trim(span)
    part = [F.coalesce(F.nullif(F.regexp_extract(s, p, i), F.lit("")), F.lit("0")).try_cast("long") for i in (1, 2, 3, 4)]
    ticks = F.rpad(F.coalesce(F.nullif(F.regexp_extract(s, p, 5), F.lit("")), F.lit("0")), 7, "0").try_cast("long")
    whole = part[0] * 86_400_000 + part[1] * 3_600_000 + part[2] * 60_000 + part[3] * 1000
    return F.when(s.rlike(p), whole + F.floor(ticks / 10_000))


def iso_date(text: Column) -> Column:
    """UTC timestamp of an ISO text; year 1 stands for none."""
    s = F.trim(text)
    return F.when(~F.startswith(s, F.lit("0001-01-01")), F.try_to_timestamp(F.regexp_replace(s, "Z+$", "")))


def crawl_decision(now: Column, followed: Column, changed: Column, created: Column, crawled: Column) -> Column:
    """``crawl`` or ``wait`` of a playlist: daily if followed, else the longer it is stable the rarer."""
    stable = days_between(now, F.coalesce(changed, created))
    least = F.when(followed, 1.0).when(stable > 60, 30.0).when(stable > 14, 7.0).otherwise(1.0)
    due = crawled.isNull() | (~followed & changed.isNull() & created.isNull()) | (days_between(now, crawled) > least - SLACK_DAYS)
    return F.when(due, "crawl").otherwise("wait")


def recrawl_decision(now: Column, created: Column, reference: Column) -> Column:
    """``crawl``, ``wait`` or ``final`` of a set, by its age."""
    age = F.coalesce(days_between(now, created), F.lit(0.0))
    least = F.when(age > 30, 30.0).when(age > 7, 7.0).otherwise(1.0)
    due = reference.isNull() | (days_between(now, reference) > least - SLACK_DAYS)
    return F.when(age > 90, "final").when(due, "crawl").otherwise("wait")


def completion(total: Column, unidentified: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise((total - unidentified) / F.nullif(total, F.lit(0)))


def set_unreliable(total: Column, unidentified: Column, source_url: Column, placeholder: Column, ratio: float = 0.8) -> Column:
    """No tracks, too many unidentified, or neither source nor artwork of its own."""
    nowhere = (F.coalesce(F.trim(source_url), F.lit("")) == "") & F.coalesce(placeholder, F.lit(False))
    return (total <= 0) | (unidentified / F.greatest(total, F.lit(1)) >= ratio) | nowhere
