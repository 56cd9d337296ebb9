"""URL algebra as Column expressions. parse_url() isn't used: it rejects what crawled URLs contain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import TRACKING_KEYS, TRACKING_PREFIX
from tidemark.functions.text import let

#: scheme, netloc, path, query, fragment
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, NETLOC, PATH, QUERY, FRAGMENT = range(1, 6)


def pieces(url: Column) -> Column:
    """struct(scheme, netloc, path, query)"""
    def taken(u: Column) -> Column:
        found = {n: F.regexp_extract(u, PARTS, k) for n, k in (("scheme", SCHEME), ("netloc", NETLOC), ("path", PATH), ("query", QUERY))}
        return F.struct(F.lower(found.pop("scheme")).alias("scheme"), *(c.alias(n) for n, c in found.items()))

    return let(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\t\\r\\n]", ""), taken)


def part(url: Column, which: int) -> Column:
    found = F.regexp_extract(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\t\\r\\n]", ""), PARTS, which)
    return F.lower(found) if which == SCHEME else found


def join(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    """The URL of its parts, without a fragment."""
    def whole(p: Column) -> Column:
        rooted = F.when((F.length(p["path"]) > 0) & ~p["path"].startswith("/"), F.concat(F.lit("/"), p["path"])).otherwise(p["path"])
        place = F.when(F.length(p["netloc"]) > 0, F.concat(F.lit("//"), p["netloc"], rooted)).when(p["scheme"].isin("http", "https", "ftp") & ~p["path"].startswith("//"), F.concat(F.lit("//"), p["path"])).otherwise(p["path"])
        before = F.when(F.length(p["scheme"]) > 0, F.concat(p["scheme"], F.lit(":"))).otherwise("")
        return F.concat(before, place, F.when(F.length(p["query"]) > 0, F.concat(F.lit("?"), p["query"])).otherwise(""))

    return let(F.struct(scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path"), query.alias("query")), whole)


def is_http(url: Column) -> Column:
    return part(url, SCHEME).isin("http", "https") & (F.length(part(url, NETLOC)) > 0)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(F.regexp_replace(part(url, NETLOC), "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def is_root(url: Column) -> Column:
    return part(url, PATH).isin("", "/")


def repaired(url: Column) -> Column:
    """https where no scheme is given, the first piece of a path as the host where none is, no fragment."""
    def whole(p: Column) -> Column:
        bare = (F.length(p["netloc"]) == 0) & (F.length(p["path"]) > 0)
        first, rest = F.regexp_extract(p["path"], "(?s)^([^/]*)", 1), F.regexp_extract(p["path"], "(?s)^[^/]*(/.*)$", 1)
        scheme = F.when(F.length(p["scheme"]) > 0, p["scheme"]).otherwise("https")
        return F.when(bare & F.contains(p["path"], F.lit("://")), p["path"]).otherwise(join(scheme, F.when(bare, first).otherwise(p["netloc"]), F.when(bare, rest).otherwise(p["path"]), p["query"]))

    return let(pieces(url), whole)


def _decoded(text: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def without_tracking(url: Column) -> Column:
    """Without the parameters that only track, and without a fragment; the others encoded anew, blank values kept."""
    def pair(text: Column) -> Column:
        return F.struct(_decoded(F.substring_index(text, "=", 1)).alias("key"), _decoded(F.regexp_extract(text, "(?s)^[^=]*=(.*)$", 1)).alias("value"))

    def kept(x: Column) -> Column:
        return ~(F.lower(x["key"]).startswith(TRACKING_PREFIX) | F.lower(x["key"]).isin(*TRACKING_KEYS))

    def query(text: Column) -> Column:
        pairs = F.transform(F.filter(F.split(text, "&"), lambda x: F.length(x) > 0), pair)
        again = F.array_join(F.transform(F.filter(pairs, kept), lambda x: F.concat(_encoded(x["key"]), F.lit("="), _encoded(x["value"]))), "&")
        return F.when(text == "", text).otherwise(again)

    return let(pieces(url), lambda p: join(p["scheme"], p["netloc"], p["path"], query(p["query"])))


def without_amp(url: Column) -> Column:
    steps = (("(?i)/amp($|[/?#])", "/$1"), ("(?i)(\\?|&)amp=1(&|$)", "$1"), ("(?i)(\\?|&)output=amp(&|$)", "$1"))
    return reduce(lambda u, s: F.regexp_replace(u, s[0], s[1]), steps, url)


#: URLs that repairing and stripping leave as they are: they need no taking apart
PLAIN = r"^https?://[^/?#\x00-\x20]+(?:/[^?#\x00-\x20]*)?$"


def finalized(url: Column, strip_amp: bool = True) -> Column:
    """Repaired, without tracking parameters, and without marks of AMP."""
    done = F.when(url.rlike(PLAIN), url).otherwise(without_tracking(repaired(url)))
    return without_amp(done) if strip_amp else done


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a sub-domain of the other; a port belongs to the host here."""
    a, b = F.lower(a), F.lower(b)
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def safe_canonical(base: Column, canonical: Column, strip_amp: bool = True) -> Column:
    """The canonical URL if it may replace the base: same site, no loss of https, not a root; else null."""
    def fitting(x: Column) -> Column:
        b, t = x["base"], x["target"]
        downgrade = (b["scheme"] == "https") & (t["scheme"] != "https")
        return F.when(same_site(b["netloc"], t["netloc"]) & ~downgrade & ~t["path"].isin("", "/"), x["url"])

    return let(finalized(canonical, strip_amp), lambda t: let(F.struct(pieces(base).alias("base"), pieces(t).alias("target"), t.alias("url")), fitting))


def canonical_link(head: Column) -> Column:
    """The target of the first canonical link, null without one; `rel` must stand before `href`."""
    return F.nullif(F.regexp_extract(head, "(?i)<link[^>]+rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)[\"']", 1), F.lit(""))


def amp_link(html: Column) -> Column:
    """The absolute target of the first AMP link, null without one."""
    tag = F.regexp_extract(html, "(?is)(<link\\b[^>]*\\brel\\s*=\\s*(?:\"[^\">]*\\bamphtml\\b[^\">]*\"|'[^'>]*\\bamphtml\\b[^'>]*'|amphtml\\b)[^>]*>|<link\\b[^>]*\\brel\\s*=\\s*amphtml[^>]*>)", 1)
    target = F.regexp_extract(tag, "(?i)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)
    return F.when(target.rlike("^https?://"), target)


def looks_like_article(url: Column) -> Column:
    return url.rlike("/20[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}/") | F.contains(url, F.lit("/news")) | F.contains(url, F.lit("/article")) | F.contains(url, F.lit("/story"))


def in_domains(host_: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or below one; no domains accept all."""
    if not domains:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [(host_ == d) | host_.endswith("." + d) for d in domains])


def quoted(url: Column) -> Column:
    """Characters beyond ASCII, blanks and quotes percent-encoded; what is encoded already stays."""
    chars = F.regexp_extract_all(url, F.lit("(?s)([\\x21\\x23-\\x3b\\x3d\\x3f-\\x5b\\x5d\\x5f\\x61-\\x7a\\x7e]+|.)"), 1)
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike("^[\\x21\\x23-\\x3b\\x3d\\x3f-\\x5b\\x5d\\x5f\\x61-\\x7a\\x7e]+$"), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))), "")
