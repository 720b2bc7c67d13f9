"""Reading urls as they are typed: host and site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The lower-case host of a url; user, port, path, query and fragment dropped. Null if there is none.

    Works on urls that aren't valid for a parser (spaces, accents, no scheme).
    """
    rest = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    name = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#\\]*)", 1), r"^.*@|:\d*$", "")
    return F.nullif(F.regexp_replace(F.lower(name), r"\.+$", ""), F.lit(""))


def site(url: Column) -> Column:
    """The host without a leading ``www.`` or ``m.``: one name for one site."""
    return F.regexp_replace(host(url), r"^(?:(?:www|m)\.)+", "")
