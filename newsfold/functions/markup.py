"""Small helpers that read one HTML page; the jobs that run them over tables are in operators.pages."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

HIDDEN = frozenset("script style form noscript template iframe svg nav footer aside button select textarea".split())
BLOCK = frozenset("p div section article main header h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre figure figcaption dl dt dd body".split())
#: Block elements before which an open paragraph ends.
ENDS_P = BLOCK - {"body", "tr"}
#: Elements within which an outer paragraph stays open.
APART = frozenset("table caption td th button object marquee template html".split())
#: What stands before a block's words.
LEAD = {"li": "- ", "blockquote": "> "} | {f"h{i}": "#" * i + " " for i in range(1, 7)}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOT_FREE = frozenset(["false", "no", "0"])
PAID_TYPES = ("NewsArticle", "Article", "BlogPosting", "WebPage", "CreativeWork")


class Mark(str):
    """A sign of the markdown, not of the page's text."""


class Page(HTMLParser):
    """What one pass over a page finds: meta data, structured data, markdown blocks, links and free-access marks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.lang = self.title = self.canonical = ""
        self.ld: list[str] = []
        self.marks: list[dict] = []  # elements that say whether access is free
        self.blocks: list[tuple[str, list[str]]] = []
        self._open: list[tuple[str, bool]] = []
        self._into: list[str] | None = None
        self._mark: dict | None = None
        self._link = ""
        try:
            self.feed(html)
            self.close()
            while self._open:
                self.handle_endtag(self._open[-1][0])
        except Exception as e:  # a page that can't be read is reported, and doesn't end the job
            self.error: str | None = f"{type(e).__name__}: {e}"[:200]
        else:
            self.error = None

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self._within("p"):
            self.handle_endtag("p")
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            name = a.get("name") or a.get("property") or a.get("itemprop") or ""
            if name and "content" in a:
                self.meta.setdefault(name.lower(), a["content"])
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = self.canonical or a.get("href", "")
        for kind, key in (("microdata", "itemprop"), ("rdfa", "property")):
            if "isaccessibleforfree" in a.get(key, "").lower():
                self._mark = {"type": kind, "tag": tag, "value": a.get("content", ""), "path": "/" + "/".join([t for t, _ in self._open] + [tag]), "text": ""}
                self.marks.append(self._mark)
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        classes = a.get("class", "").lower().split()
        self._open.append((tag, tag in HIDDEN or "noprint" in classes or "ad" in classes))
        if tag == "title":
            self._into = []
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self._into = []
        elif tag in BLOCK:
            self._block(tag)
        elif tag == "a":
            self._link = "" if "redlink" in a.get("href", "") or "new" in classes else a.get("href", "")
            if self._link:
                self._say(Mark("["))
        elif tag in ("b", "strong"):
            self._say(Mark("**"))
        elif tag in ("i", "em"):
            self._say(Mark("*"))

    def _block(self, tag):
        self.blocks.append((LEAD.get(tag, ""), []))

    def _within(self, tag: str) -> bool:
        """Whether such an element is open, and nothing between that is hidden or keeps it apart."""
        for t, hidden in reversed(self._open):
            if t == tag or hidden or t in APART:
                return t == tag
        return False

    def _silent(self) -> bool:
        return any(h or t in ("head", "title") for t, h in self._open)

    def _say(self, text):
        if not self._silent():
            if not self.blocks:
                self._block("p")
            self.blocks[-1][1].append(text)

    def _end(self, begun: str, mark: str):
        """The end of a mark, before white space that stands there; a mark around nothing goes."""
        if self._silent():
            return
        parts = self.blocks[-1][1] if self.blocks else []
        k = len(parts)
        while k and not isinstance(parts[k - 1], Mark) and not parts[k - 1].strip():
            k -= 1
        if k and isinstance(parts[k - 1], Mark) and parts[k - 1] == begun:
            del parts[k - 1]
        else:
            tail = parts[k:]
            del parts[k:]
            if k and not isinstance(parts[-1], Mark):
                end = parts[-1].rstrip()
                tail.insert(0, parts[-1][len(end) :])
                parts[-1] = end
            for x in (Mark(mark), *tail):
                self._say(x)

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self._open]:
            return
        while self._open:
            t, _ = self._open[-1]
            if t == "title" and self._into is not None:
                self.title = self.title or " ".join("".join(self._into).split())
                self._into = None
            elif t == "script" and self._into is not None:
                self.ld.append("".join(self._into))
                self._into = None
            elif t == "a" and self._link:
                self._end("[", f"]({self._link})")
                self._link = ""
            elif t in ("b", "strong"):
                self._end("**", "**")
            elif t in ("i", "em"):
                self._end("*", "*")
            self._open.pop()
            if t == tag:
                break
        if tag in BLOCK:
            self._block("p")
        self._mark = None

    def handle_data(self, data):
        if self._into is not None:
            self._into.append(data)
        else:
            if self._mark is not None:
                self._mark["text"] = (self._mark["text"] + data)[:100]
            self._say(data)

    def markdown(self) -> str:
        """The visible text with # headings, - items and links."""
        lines = (lead + " ".join("".join(parts).split()) for lead, parts in self.blocks if self._plain(parts))
        return "\n\n".join(lines)

    @staticmethod
    def _plain(parts: list[str]) -> str:
        return " ".join("".join(p for p in parts if not isinstance(p, Mark)).split())

    def text(self) -> str:
        """The visible text without marks."""
        return "\n".join(filter(None, (self._plain(p) for _, p in self.blocks)))


def _false(v) -> bool:
    return v is False or v in ("false", "False")


def _jsonld(data, found: list[dict], path: str = "$") -> None:
    """Add the nodes of structured data that say access isn't free."""
    if isinstance(data, list):
        for i, x in enumerate(data):
            _jsonld(x, found, f"{path}[{i}]")
    elif isinstance(data, dict):
        kinds = data.get("@type", "")
        kinds = " ".join(map(str, kinds)) if isinstance(kinds, list) else str(kinds)
        part = path.rsplit(".", 1)[-1].startswith("hasPart")
        if _false(data.get("isAccessibleForFree")) and (part or any(t in kinds for t in PAID_TYPES)):
            found.append({"type": "json-ld", "tag": kinds, "value": str(data["isAccessibleForFree"]), "path": path, "text": ""})
        for k, v in data.items():
            _jsonld(v, found, f"{path}.{k}")


def paywall(page: Page) -> tuple[list[dict], list[str]]:
    """(evidence that the page isn't free, structured data that couldn't be read)."""
    found: list[dict] = []
    errors = []
    for block in page.ld:
        try:
            _jsonld(json.loads(block), found)
        except (ValueError, RecursionError) as e:
            errors.append(str(e)[:100])
    found += [m for m in page.marks if m["value"].strip().lower() in NOT_FREE or m["text"].strip().lower() in NOT_FREE]
    return found, errors


def date_of(page: Page) -> str | None:
    """The page's date, as written in its meta data or structured data."""
    for key in ("article:modified_time", "article:published_time", "datemodified", "datepublished", "date", "dc.date"):
        if page.meta.get(key):
            return page.meta[key]
    for block in page.ld:
        if m := re.search(r'"date(?:Modified|Published)"\s*:\s*"([^"]+)"', block):
            return m[1]
    return None
