"""Column functions on text. White space is Unicode's, as one shared character class; offsets are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that count as white space.
SPACE_SET = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, TOKEN = f"[{SPACE_SET}]", f"[^{SPACE_SET}]+"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLOCK = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+", -1), lambda w: w != "")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.array_join(words(c), " ")


def normalize(c: Column) -> Column:
    return F.array_join(words(F.lower(c)), " ")


def round4(c: Column) -> Column:
    return F.rint(c * 10000) / 10000


def two_digits(c: Column) -> Column:
    """A score (not negative, rounded to four digits) with two: rounded by the exact value that the double has, and only
    a true tie to the even digit. The sign of the rest is exact, as both parts of the double times 10000 are."""

    def of(x: Column, high: Column) -> Column:
        k = F.rint(x * 10000)
        rest = (high * 10000 - k) + (x - high) * 10000
        up = F.signum(rest) + 0.5 * (F.floor(k / 100) % 2) > 0  # where the last two of the four digits are 50
        return F.format_string("%.2f", F.floor((k + 49 + up.cast("int")) / 100) / 100)

    return let(c, lambda x: let(x * 134217729.0 - (x * 134217729.0 - x), lambda high: of(x, high)))


def short_id(*parts: Column, separator: str = ":") -> Column:
    return F.substring(F.sha2(F.concat_ws(separator, *[p.cast("string") for p in parts]), 256), 1, 16)


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters; 0 or less means all."""
    return c if most <= 0 else F.substring(c, 1, most)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("")), F.lit('"'))


def shingles(c: Column, n: int) -> Column:
    """Word n-grams in order, repeats kept; fewer words than n are one shingle."""

    def grams(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(long)

    return let(words(F.lower(c)), grams)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _earlier(a: Column, levels: int) -> Column:
    """Sums of all earlier elements: within blocks element by element, and of the blocks by the same rule, so that an
    element costs about half a block at each level."""
    if not levels:
        return F.transform(a, lambda x, i: _total(F.slice(a, F.lit(1), i)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))

    def joined(blocks: Column, before: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda block, j: let(F.get(before, j), lambda n: F.transform(block, lambda x, i: n + _total(F.slice(block, F.lit(1), i))))))

    return let(blocks, lambda of: let(_earlier(F.transform(of, _total), levels - 1), lambda before: joined(of, before)))


def starts(sizes: Column) -> Column:
    """Sums of all earlier elements of an array of whole numbers, in linear time up to ``_BLOCK ** 3`` elements."""
    return let(sizes, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(_earlier(a, 2)))


def abstract_text(positions: Column) -> Column:
    """The text of an inverted index (map of word to positions); of words at one position the last wins."""
    placed = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))

    def last(ordered: Column) -> Column:
        kept = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["p"] != x["p"], F.lit(True)))
        return F.array_join(F.transform(kept, lambda x: x["w"]), " ")

    return F.coalesce(let(F.array_sort(placed), last), F.lit(""))


def result_url(href: Column) -> Column:
    """The target of a search result's link, or null: redirects (``/l/?uddg=`` of the search site) are decoded twice, as
    a query's value and as a quoted address; the search site itself and other schemes than http are refused. What
    can't be decoded is null."""
    site = "duckduckgo.com"
    whole = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(f"https://{site}"), href)).otherwise(href)

    def part(url: Column, which: str) -> Column:  # of an address: scheme, host with port, path, query
        return F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", ("scheme", "host", "path", "query").index(which) + 1)

    decode = F.try_url_decode
    plus_kept = lambda c: decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    redirect = part(whole, "host").endswith(site) & part(whole, "path").startswith("/l/")
    target = F.regexp_extract(part(whole, "query"), "(?:^|&)uddg=([^&]+)", 1)
    out = F.when(redirect, plus_kept(decode(target))).otherwise(whole)
    good = F.lower(part(out, "scheme")).isin("http", "https") & ~part(out, "host").endswith(site)
    return F.when(good, out)
