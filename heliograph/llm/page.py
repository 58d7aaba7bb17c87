"""One spelling per page: the form under which two SURT keys mean the same page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

# Query parameters that only name a session or a campaign.
SESSION_PARAMETERS = ("sid", "phpsessid", "jsessionid")
CAMPAIGN_PREFIX = "utm_"


def _decoded(text: F.Column) -> F.Column:
    """Decodes percent escapes of ASCII letters, digits and ``-._~``; others stay."""
    parts = F.split(text, "%")

    def piece(part: F.Column, index: F.Column) -> F.Column:
        code = F.conv(F.substring(part, 1, 2), 16, 10).cast("int")
        plain = part.rlike("^(?:[46][1-9a-fA-F]|[57][0-9aA]|3[0-9]|2[dDeE]|5[fF]|7[eE])")
        return F.when(index == 0, part).when(plain, F.concat(F.chr(code), F.substring(part, F.lit(3), F.length(part)))).otherwise(F.concat(F.lit("%"), part))

    return F.array_join(F.transform(parts, piece), "")


def page_key(surt) -> F.Column:
    """Canonical form of a SURT key; null stays null.

    Lower case; in the part before ``)`` a final ``:80`` or ``:443`` goes, then a last label
    ``www`` or ``www`` and digits; percent escapes of unreserved characters are decoded, and
    letters that come out of them are lower-cased like all others; session and campaign
    parameters go and the others are sorted; one ``/`` at the end of the path goes, and a
    ``?`` with nothing behind it.  A key without ``)`` is all host part.
    """
    low = F.lower(surt)
    # Guards keep the costly steps to the few keys that need them.
    low = F.when(low.contains("%"), F.lower(_decoded(low))).otherwise(low)
    host, rest = F.substring_index(low, ")", 1), F.when(low.contains(")"), F.substring(low, F.length(F.substring_index(low, ")", 1)) + 1, F.length(low))).otherwise("")
    host = F.when(host.contains(":"), F.regexp_replace(host, r":(?:80|443)$", "")).otherwise(host)
    host = F.when(host.contains("www"), F.regexp_replace(host, r"(^|,)www[0-9]*$", "")).otherwise(host)

    def shorter(path: F.Column) -> F.Column:
        return F.when(path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)

    def kept(parameter: F.Column) -> F.Column:
        name = F.substring_index(parameter, "=", 1)
        return ~(name.isin(*SESSION_PARAMETERS) | name.startswith(CAMPAIGN_PREFIX))

    path = F.substring_index(rest, "?", 1)
    query = F.substring(rest, F.length(path) + 2, F.length(rest))
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), kept)), "&")
    # A query of no parameters leaves nothing, so its question mark goes too.
    asked = F.regexp_replace(F.concat(shorter(path), F.lit("?"), ordered), r"\?$", "")
    return F.concat(host, F.when(rest.contains("?"), asked).otherwise(shorter(rest)))


def seconds(ts) -> F.Column:
    """A 14-digit timestamp as seconds; null if it is no real time.

    Built from the calendar date, so it does not depend on the session's time zone.
    """
    day = F.try_to_date(F.substring(ts, 1, 8), "yyyyMMdd")
    clock = [F.substring(ts, p, 2).try_cast("int") for p in (9, 11, 13)]
    valid = ts.rlike("^[0-9]{14}$") & (clock[0] < 24) & (clock[1] < 60) & (clock[2] < 60)
    whole = reduce(lambda a, b: a * 60 + b, clock)
    return F.when(valid, F.unix_date(day).cast("long") * 86400 + whole)
