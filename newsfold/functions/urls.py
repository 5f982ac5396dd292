"""URL columns: choice, normal form, signature, routing keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL, MOVED, ALTERNATE = "canonical", "moved", "alternate"


def primary_url(urls: Column) -> Column:
    """The first href labelled canonical, else the first href, else null. urls: array of structs with href and labels."""
    named = F.filter(urls, lambda u: F.array_contains(u["labels"], CANONICAL))
    return F.coalesce(F.get(named, F.lit(0))["href"], F.get(urls, F.lit(0))["href"])


def has_handled_url(urls: Column) -> Column:
    """Whether a URL has a signature that isn't empty."""
    return F.coalesce(F.exists(urls, lambda u: u["signature"] != ""), F.lit(False))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no dot segments, upper-case percent codes, a path of at least /.

    What isn't a URL with scheme and host stays as it is, trimmed.
    """
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, "^[^:/?#]+://([^/?#]*)", 1))
    host = F.regexp_replace(host, ":$", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(u, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(u, "^[^?#]*(.*)$", 1)
    parts = F.slice(F.split(path, "/"), 2, 1_000_000)

    def step(done: Column, p: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(p == ".", done).when(p == "..", up).otherwise(F.concat(done, F.array(p)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    end = F.when(path.rlike("/\\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    full = F.concat(F.lit("/"), F.array_join(kept, "/"), end)
    codes = F.split(F.concat(full, rest), "%")
    upper = F.array_join(F.transform(codes, lambda c, i: F.when((i > 0) & c.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(c, 1, 2)), F.substring(c, 3, 1_000_000))).otherwise(c)), "%")
    return F.when((scheme == "") | (host == ""), u).otherwise(F.concat(scheme, F.lit("://"), host, upper))


def url_signature(url: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """SHA-256 of the canonical form that the first matching rule gives; no rule: the empty string.

    A rule is (host pattern, path pattern, template with $1.. for the path's groups). The URL is trimmed first.
    """
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    path = F.regexp_extract(u, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    out = None
    for h, p, template in rules:
        hit = host.rlike(f"^(?:{h})$") & path.rlike(f"^(?:{p})$")
        canon = F.concat(host, F.regexp_replace(path, f"^(?:{p})$", template))
        out = F.when(hit, F.sha2(canon, 256)) if out is None else out.when(hit, F.sha2(canon, 256))
    return F.lit("") if out is None else F.coalesce(out, F.lit(""))


def story_key(url: Column, id_: Column) -> Column:
    """(section, id): the last path part but one and the id; null where the path is too short."""
    path = F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    section = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    return F.struct(section.alias("section"), id_.alias("id"))


def same_article(a: Column, b: Column) -> Column:
    """Whether two URL arrays share a signature: of their canonical URLs, or of all where a side has no canonical one."""

    def signs(urls: Column) -> Column:
        own = F.transform(F.filter(urls, lambda u: F.array_contains(u["labels"], CANONICAL)), lambda u: u["signature"])
        every = F.transform(urls, lambda u: u["signature"])
        return F.filter(F.when(F.size(own) > 0, own).otherwise(every), lambda s: s != "")

    return F.arrays_overlap(signs(a), signs(b))
