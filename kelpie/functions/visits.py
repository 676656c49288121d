"""Where a visit came from, where it landed, and on what device: tables of names, and one way of looking each up.

The tables are parameters with small defaults; a deployment brings its own. Hosts are looked up by their suffixes, paths by
their first segments and user agents by their product tokens, so a table's size does not lengthen the expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Campaign words and the channel each stands for.
CHANNELS = {"letter": "mailing", "bulletin": "mailing", "alert": "mailing", "poster": "print", "fair": "print", "ads": "paid", "banner": "paid", "feed": "syndication"}
#: Host suffixes and the channel each stands for; of several, the longest decides.
REFERRERS = {
    "example.com": "partner", "blog.example.com": "press", "m.example.com": "mobile site", "example.net": "portal", "blog.example.net": "press",
    "example.org": "community", "search.example.org": "search", "ask.search.example.org": "assistant",
}
#: Beginnings of a path, segment by segment, and the kind of page each stands for; of several, the longest decides.
SECTIONS = {"": "front", "en": "english", "de": "german", "fr": "french", "es": "spanish", "en/terms": "terms", "board": "board", "board/archive": "archive", "account": "account"}
#: Words of a user agent's comment, and product tokens: the first of each table that occurs names the system or the browser.
SYSTEMS = {"harmony": "HarmonyOS", "cros": "ChromeOS", "android": "Android", "ipad": "iPadOS", "iphone": "iOS", "windows": "Windows", "macintosh": "macOS", "freebsd": "BSD", "linux": "Linux"}
BROWSERS = {"samsungbrowser": "Samsung Internet", "vivaldi": "Vivaldi", "yabrowser": "Yandex", "edg": "Edge", "edga": "Edge", "opr": "Opera", "fxios": "Firefox", "firefox": "Firefox", "crios": "Chrome", "chrome": "Chrome", "safari": "Safari"}
SHOWN = 32


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _longest(parts: Column, joint: str, from_end: bool, table: dict[str, str]) -> Column:
    """The table's value for the longest run of parts, from one end, that it names; null where it names none."""
    n = F.size(parts)
    most = max(len(k.split(joint)) for k in table)
    runs = [F.array_join(F.slice(parts, n - k + 1 if from_end else F.lit(1), F.lit(k)), joint) for k in range(most, 0, -1)]
    return F.coalesce(*[F.when(n >= k, F.element_at(_map(table), run)) for k, run in zip(range(most, 0, -1), runs, strict=True)])


def channel_of_host(host: Column, referrers: dict[str, str] = REFERRERS) -> Column:
    """The channel of a host by its longest known suffix of whole labels; null for an unknown or null host."""
    return _longest(F.split(F.rtrim(F.lower(host), F.lit(".")), r"\."), ".", True, referrers)


def traffic_source(entry: Column, tag: Column, host: Column, in_app: Column, channels: dict[str, str] = CHANNELS, referrers: dict[str, str] = REFERRERS) -> Column:
    """The source of a visit: of a campaign word, a referring host and an app, the first that is there tells it.

    An unknown word is `campaign`, an unknown host `referral`; without any of the three the visit is `direct`. Rows that do
    not begin a visit are `not an entry`.
    """
    tagged = F.coalesce(F.element_at(_map(channels), F.lower(F.trim(tag))), F.lit("campaign"))
    referred = F.coalesce(channel_of_host(host, referrers), F.lit("referral"))
    told = F.coalesce(F.when(tag.isNotNull(), tagged), F.when(host.isNotNull(), referred), in_app, F.lit("direct"))
    return F.when(F.coalesce(entry, F.lit(False)), told).otherwise("not an entry")


def landing_group(path: Column, sections: dict[str, str] = SECTIONS, shown: int = SHOWN) -> Column:
    """The kind of page by the path's longest known beginning of whole segments, whatever follows `?` or `#`; of an unknown
    page the path itself, cut at `shown` characters. A null path is the front page."""
    bare = F.regexp_replace(F.coalesce(path, F.lit("")), "[?#].*", "")
    segments = F.filter(F.split(bare, "/"), lambda s: s != "")
    named = {k: v for k, v in sections.items() if k}
    front = F.when(F.size(segments) == 0, F.lit(sections.get("", "front")))
    return F.coalesce(front, _longest(segments, "/", False, named), F.substring(bare, 1, shown))


def device(agent: Column, systems: dict[str, str] = SYSTEMS, browsers: dict[str, str] = BROWSERS) -> Column:
    """`system, browser` of a user agent, one of them where the other is unknown, `unknown` where both are.

    Products are the names before a slash; of those that the table knows, the one that stands first in the table decides, so
    a browser that also names another one is listed before it.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(agent, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    products = F.regexp_extract_all(F.lower(F.coalesce(agent, F.lit(""))), F.lit("([a-z]+)/"), F.lit(1))

    def first(names: dict[str, str], found: Column) -> Column:
        known = F.filter(F.array(*[F.lit(k) for k in names]), lambda k: F.array_contains(found, k))
        return F.element_at(_map(names), F.try_element_at(known, F.lit(1)))

    told = F.concat_ws(", ", first(systems, words), first(browsers, products))
    return F.when(told == "", "unknown").otherwise(told)
