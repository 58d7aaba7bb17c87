"""URLs as sort-friendly keys: ``http://www.a.example/x?b&a`` is ``example,a)/x?a&b``."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions.binding import let

# Session parameters that do not belong to a page's identity.
SESSION = r"(?i)^(?:jsessionid|phpsessid|sid|aspsessionid[a-z]{8}|cfid|cftoken)="


def url_to_surt(url, strip_www: bool = True) -> F.Column:
    """The key of a URL column; null for null and for text without a host.

    Scheme, user, default port, fragment and session parameters go, the host is
    lower-cased and its labels reversed (an address of digits stays as it is), ``www`` and
    ``www`` plus digits go if ``strip_www``, the path is lower-cased and loses one final
    ``/`` (the root keeps it), query parameters are sorted and an empty query goes.
    """
    def host_key(host: F.Column) -> F.Column:
        numeric = host.contains(":") | host.rlike(r"^[0-9.]+$")
        labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
        return F.when(host != "", F.when(numeric, host).otherwise(labels))

    def bare(host: F.Column) -> F.Column:
        host = F.rtrim(host, F.lit("."))
        return F.when(host.startswith("www"), F.regexp_replace(host, r"^www[0-9]*\.(?=.)", "")).otherwise(host) if strip_www else host

    def host_part(authority: F.Column, scheme: F.Column) -> F.Column:
        """Labels and port; few hosts have one."""
        port = F.substring_index(authority, ":", -1)
        usual = (port == "") | ((port == "80") & scheme.isin("http", "")) | ((port == "443") & (scheme == "https"))
        with_port = F.concat(let(bare(F.regexp_replace(authority, r":[0-9]*$", "")), host_key), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))
        return F.when(authority.contains(":") & authority.rlike(r":[0-9]*$"), with_port).otherwise(let(bare(authority), host_key))

    def local_part(tail: F.Column) -> F.Column:
        def short(path: F.Column) -> F.Column:
            return F.when(path.isin("", "/"), "/").when(path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)

        def clean(path: F.Column) -> F.Column:
            return let(F.when(path.contains(";"), F.regexp_replace(path, r";jsessionid=[0-9a-z]*$", "")).otherwise(path), short)

        def asked(path: F.Column) -> F.Column:
            query = F.substring(tail, F.length(path) + 2, F.length(tail))
            kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(SESSION))), "&")
            return F.regexp_replace(F.concat(let(path, clean), F.lit("?"), kept), r"\?$", "")

        return F.when(tail.contains("?"), let(F.substring_index(tail, "?", 1), asked)).otherwise(clean(tail))

    def of_rest(rest: F.Column, scheme: F.Column) -> F.Column:
        def split(raw: F.Column) -> F.Column:
            tail = F.lower(F.substring(rest, F.length(raw) + 1, F.length(rest)))
            return F.concat(let(F.lower(F.substring_index(raw, "@", -1)), lambda a: host_part(a, scheme)), F.lit(")"), let(tail, local_part))

        return let(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), split)

    def whole(text: F.Column) -> F.Column:
        def named(scheme: F.Column) -> F.Column:
            rest = F.substring(text, F.length(scheme) + 4, F.length(text))
            return let(F.substring_index(rest, "#", 1), lambda r: of_rest(r, F.lower(scheme)))

        # Text such as urn:a:b or mailto:a@b names no host; host:port does.
        opaque = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?![0-9]+(?:[/?#]|$))")
        plain = let(F.substring_index(text, "#", 1), lambda r: of_rest(r, F.lit("")))
        with_scheme = let(F.substring_index(text, "://", 1), named)
        return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), with_scheme).when(~opaque, plain)

    return let(F.trim(url), whole)


def surt_parts(surt) -> dict[str, F.Column]:
    """Top-level domain, domain and the labels below it, of the host part of a key."""
    labels = F.split(F.regexp_replace(F.substring_index(surt, ")", 1), r":[0-9]+$", ""), ",")
    below = F.when(F.size(labels) > 2, F.array_join(F.reverse(F.slice(labels, 3, F.greatest(F.size(labels) - 2, F.lit(0)))), "."))
    return {"tld": F.get(labels, F.lit(0)), "domain": F.get(labels, F.lit(1)), "subdomain": below}
