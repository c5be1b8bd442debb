"""Links of pages, and what they point to, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of an address (scheme, authority, path, query, fragment), as RFC 3986 has them.
PARTS = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
#: An anchor's address: in double or single quotes, or without.
LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def links(html: Column) -> Column:
    """The addresses of a page's anchors in order, with repeats, without white space at the ends, &amp; as &. Null for null."""
    raw = F.regexp_extract_all(html, F.lit(LINK), F.lit(1))
    bare = F.transform(raw, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    return F.transform(bare, lambda x: F.replace(F.regexp_replace(x, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", ""), F.lit("&amp;"), F.lit("&")))


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    segments = F.split(path, "/")

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.slice(segments, 1, 1), step)
    last = F.element_at(segments, -1)
    kept = F.when(last.isin(".", "..") & (F.size(segments) > 1), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(kept, "/")
    return F.when(joined == "", F.when(F.startswith(path, F.lit("/")), "/").otherwise("")).otherwise(joined)


def resolved(base: Column, reference: Column) -> Column:
    """The address that a reference on a page with this (absolute) address points to, without its fragment: RFC 3986, 5.2. Null where one of them is null."""
    path, query = _part(reference, 5), _part(reference, 6)
    authority = _part(base, 3)
    base_path = _part(base, 5)
    merged = F.when((authority != "") & (base_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(base_path, "(?s)^(.*/)?", 0), path))
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(merged)
    same = F.concat(base_path, F.when(query != "", query).otherwise(_part(base, 6)))
    relative = F.concat(_part(base, 1), authority, F.when(path == "", same).otherwise(F.concat(without_dots(full), query)))
    to_authority = F.concat(F.when(_part(reference, 1) != "", _part(reference, 1)).otherwise(_part(base, 1)), _part(reference, 3), without_dots(path), query)
    return F.when((_part(reference, 1) != "") | (_part(reference, 3) != ""), to_authority).otherwise(relative)


def without_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^#]*", 0)
