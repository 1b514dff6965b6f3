"""Identifiers of papers and the dates that they carry.

The patterns of identifiers and URLs, and the year from which two digits mean
the last century, are fixed values: results must match them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(arxiv_id: Column) -> Column:
    """struct(year, month) of a new-style (yymm.n) or old-style (archive/yymmn) id, else null."""
    new = F.regexp_extract(arxiv_id, r"^(\d{2})(\d{2})\.", 0) != ""
    digits = F.when(new, F.substring(arxiv_id, 1, 4)).otherwise(F.regexp_extract(arxiv_id, r"^[a-z\-]+/(\d{4})", 1))
    year, month = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    full = year + F.when(year < 90, 2000).otherwise(1900)
    return F.when(month.between(1, 12), F.struct(full.alias("year"), month.alias("month")))


def month_start(arxiv_id: Column) -> Column:
    """'YYYY-MM-01', or empty."""
    ym = year_month(arxiv_id)
    return F.coalesce(F.format_string("%04d-%02d-01", ym["year"], ym["month"]).substr(F.lit(1), F.when(ym.isNotNull(), 10)), F.lit(""))


def strip_version(arxiv_id: Column) -> Column:
    return F.regexp_replace(F.trim(arxiv_id), r"v\d+$", "")


def id_from_url(url: Column) -> Column:
    new, old = (F.regexp_extract(url, rf"(?i)arxiv\.org/(?:abs|pdf)/({p})", 1) for p in (r"\d+\.\d+", r"[a-z-]+/\d+"))
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def pdf_url(arxiv_id: Column) -> Column:
    return F.concat(F.lit("http://arxiv.org/pdf/"), arxiv_id)


def mapped_id(external: Column, urls: Column) -> Column:
    """The external id, else the first id-like digits in any of the URLs."""
    found = F.filter(F.transform(urls, lambda u: F.regexp_extract(u, r"\d{4}\.\d{4,5}", 0)), lambda x: x != "")
    return F.coalesce(F.nullif(external, F.lit("")), F.get(found, F.lit(0)))


def month_ok(date: Column, before: Column, keep_missing: bool) -> Column:
    """Month cutoff by the first seven characters.

    With ``keep_missing`` an empty date passes and an empty cutoff is none;
    without it an empty date fails whenever a cutoff is given, an empty one
    included.
    """
    within = F.substring(date, 1, 7) <= F.substring(before, 1, 7)
    if keep_missing:
        return before.isNull() | (before == "") | date.isNull() | (date == "") | within
    return before.isNull() | F.coalesce((date != "") & within, F.lit(False))
