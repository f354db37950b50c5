"""Links and hosts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without port, user or trailing dots; empty when there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.rtrim(F.lower(found), F.lit("."))


def labels(h: Column) -> Column:
    return F.split(h, r"\.")


def last_labels(h: Column, n: int) -> Column:
    parts = labels(h)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")


def suffixes(h: Column) -> Column:
    """The host and everything it is under, longest first."""
    parts = labels(h)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def registrable(h: Column) -> Column:
    """The domain one label below the public suffix by rules of two labels; empty for a suffix itself.
    ``query_urls.domains`` joins the whole rule table instead, wildcards and exceptions included."""
    long_suffix = last_labels(h, 2).isin(*(r for r in lexicon.SUFFIX_RULES if r.count(".") == 1 and r[0] not in "*!"))
    n = F.size(labels(h))
    return F.when(long_suffix & (n >= 3), last_labels(h, 3)).when(~long_suffix & (n >= 2), last_labels(h, 2)).otherwise("")


def registrable_label(h: Column) -> Column:
    return F.get(labels(registrable(h)), F.lit(0))


def host_hash(h: Column) -> Column:
    """The first 16 hexadecimal digits of the host's SHA-256."""
    return F.substring(F.sha2(h, 256), 1, 16)


def without_tracking(url: Column) -> Column:
    """The link without its tracking parameters; other parameters and the fragment stay in order."""
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    bare = F.regexp_replace(url, r"#.*$", "")
    before = F.regexp_extract(bare, r"^([^?]*)", 1)
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*lexicon.TRACKING_PARAMETERS))
    return F.concat(before, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment)


def under_any(h: Column, domains: tuple[str, ...]) -> Column:
    return F.arrays_overlap(suffixes(h), F.array(*map(F.lit, domains)))


#: Rows of a QWERTY keyboard and how far each is set off to the right, in keys.
KEY_ROWS = (("qwertyuiop", 0.0), ("asdfghjkl", 0.25), ("zxcvbnm", 0.75))


def _neighbours() -> dict[str, str]:
    """Keys that touch: next to each other in a row, or less than a key apart in rows one above the other."""
    at = {c: (row, i + off) for row, (keys, off) in enumerate(KEY_ROWS) for i, c in enumerate(keys)}
    touch = lambda a, b: (a[0] == b[0] and abs(a[1] - b[1]) == 1) or (abs(a[0] - b[0]) == 1 and abs(a[1] - b[1]) < 1)
    return {c: "".join(d for d in at if d != c and touch(at[c], at[d])) for c in at}


NEIGHBOURS = _neighbours()


def typos(brand: str) -> list[str]:
    """Every slip of one key in a brand: a neighbour instead, two swapped, one doubled."""
    out: dict[str, None] = {}
    for i, c in enumerate(brand):
        for n in NEIGHBOURS.get(c, ""):
            out[brand[:i] + n + brand[i + 1 :]] = None
        out[brand[: i + 1] + brand[i:]] = None
        if i + 1 < len(brand):
            out[brand[:i] + brand[i + 1] + c + brand[i + 2 :]] = None
    out.pop(brand, None)
    return list(out)
