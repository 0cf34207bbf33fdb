"""Parts of URLs as column expressions. The patterns run alike in Java's and RE2's syntax; they follow RFC 3986, appendix B."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment. Every string matches.
REFERENCE = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"
#: Groups of an authority: 1 host (an address in brackets whole), 2 port.
AUTHORITY = r"(?s)^(?:.*@)?(\[[^\]]*\]|[^:@]*)(?::([0-9]{0,5}))?$"
#: The last two names of a host that isn't an address.
SITE = r"([^.]+[.][^.\]0-9][^.\]]*)$"


def _given(part: Column) -> Column:
    return F.nullif(part, F.lit(""))


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host, port, site, path, query, fragment, depth, n_parameters.

    A part that is absent or empty is null, and so are all parts of a null URL; depth (path segments that hold something)
    and n_parameters (of the query, between ampersands) are 0 where there are none. Scheme and host are in lower case. A
    string without a scheme is a path, as the standard has it. site is the last two names of
    the host. An authority of another form (letters for a port) gives no host.
    """
    part = lambda i: F.regexp_extract(url, REFERENCE, i)
    host = F.lower(F.regexp_extract(part(2), AUTHORITY, 1))
    filled = lambda text, at: F.size(F.filter(F.split(text, at), lambda x: x != "")).cast("long")
    return {
        "scheme": _given(F.lower(part(1))),
        "host": _given(host),
        "port": _given(F.regexp_extract(part(2), AUTHORITY, 2)).cast("int"),
        "site": _given(F.regexp_extract(host, SITE, 1)),
        "path": _given(part(3)),
        "query": _given(part(4)),
        "fragment": _given(part(5)),
        "depth": F.when(url.isNotNull(), filled(part(3), "/")),
        "n_parameters": F.when(url.isNotNull(), filled(part(4), "&")),
    }
