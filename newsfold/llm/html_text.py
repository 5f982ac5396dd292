"""Main text of pages by tag-path ratios.

A page is read once into text blocks, each with its path of block tags from the root. For every path the text length per
block and the punctuation per block are summed up, smoothed over neighbouring paths in page order and multiplied. A block
that is links and nothing else (but for a paragraph that is a sentence), or lies in an element that names itself furniture (an advert's class, ...), has a path of
its own with a ratio near zero; navigation, footers, asides and what stands below a heading such as Comments have ratio
zero. Other furniture headings (Newsletter, ...) end where text goes on in a path that the page has had before. Paths above a threshold over the page are content. The main container is the deepest element that holds most of
the ratios' sum; headings and other short plain blocks in it, or in a branch beside it that is content for the most
part, are content too. What lies beside the container at the level of the page, or outside of the article element, has to have a larger ratio and a share of
the text. All sums over elements are made in one pass, so that depth costs nothing.

Null html is empty; a page without content has the empty text; broken markup never fails a page. Repeated rows give
equal rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text to read.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video map select textarea button option head title".split())
#: Silent elements that may lie in their like; a second start tag of any other tells that the first one was left open.
NESTING = frozenset("canvas object svg template".split())
#: Elements beside the article.
BESIDE = frozenset("nav footer aside menu dialog".split())
#: Words in a class, id or role that name furniture.
_NAMES = "ads?|adsbygoogle|adverts?|advertis(?:ing|ements?)|advertorial|adbox|adslot|sponsor(?:s|ed|ship)?|promos?|promoted|banner|cookies?|cookie-?bar|consent|gdpr|nav|navbar|navigation|menu|breadcrumbs?|masthead|footer|side-?bar|widget|related|recommend(?:ed|ations?)?|share|sharing|social|comments?|comment-?list|discussions?|disqus|replies|reply|respond|newsletter|subscribe|signup|login|search|popup|modal|overlay|paywall|toolbar|pagination|pager|complementary|contentinfo"
NAMED = re.compile(rf"(^|[\s_-])({_NAMES}|notices?|alerts?|header|aside)($|[\s_-])", re.I)
#: The same in the name of a paragraph or the like, where the last words tell of its text.
NAMED_LEAF = re.compile(rf"(^|[\s_-])({_NAMES})($|[\s_-])", re.I)
#: A name that tells of the furniture beside or of its absence.
EXEMPT = re.compile(r"(^|[_-])(has|no|with|without)[_-]|^(entry|article|post|story|content|page|section)[_-]*header$", re.I)
#: An opening tag ends these open ones.
ENDS = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"])}
#: An open tag that such an end doesn't reach through.
WALLS = frozenset("table ul ol dl div article section main body td th blockquote".split())
STOPS = re.compile(r"[.,;:!?…。，、]")
#: Character references of more digits than the parser's numbers may have.
HUGE = re.compile(r"&#([0-9]{20,});?")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no containers.
LEAVES = HEADINGS | frozenset("p li td pre blockquote".split())
#: A heading that says that what comes below isn't the article's.
FURNITURE = re.compile(
    r"(related( (articles?|posts|stories|news|links|content))?|read (more|next)|more (stories|news)|replies|you (may|might) also like|recommended( for you)?|advertisement|sponsored|share this( (article|post|story))?|newsletter)( \(?\d+\)?)?:?",
    re.I,
)
#: And that it is readers' comments up to the next heading of its rank.
COMMENTS = re.compile(
    r"(\d+ )?(reader )?(comments?|leave a (reply|comment)|add a comment|kommentare?|commentaires?|comentarios?)( \(?\d+\)?)?:?|\d+ (replies|meinungen|opinions?|opiniones|avis|réactions)|(replies|meinungen|opinions|opiniones|avis|réactions) \(?\d+\)?:?",
    re.I,
)
#: A paragraph that is one link and a sentence.
SENTENCE = re.compile(r"(\S+\s+){4,}\S*[.!?…]")
#: The share of a block's letters in links above which it is links alone.
LINKED = 0.9
#: The share of the whole that the main container keeps, and of the largest ratio that a path needs.
HOLDS, LEAST = 0.6, 0.02
#: Of containers beside the main one at the level of the page: the share of the largest ratio, and of the text that passes; and that share outside of the article element.
FAR, FAR_SHARE, OUTER_SHARE = 0.4, 0.05, 0.2
#: The share of the whole that shows a named element to be a wrapper; factors of a path's ratio by its mark.
WRAPS, LOWERED = 0.8, (1.0, 0.001, 0.0)


@lru_cache(maxsize=4096)
def _names_furniture(names: str, leaf: bool) -> bool:
    return any((NAMED_LEAF if leaf else NAMED).search(x) and not EXEMPT.search(x) for x in names.split())


def _sound(m: re.Match) -> str:
    digits = m[1].lstrip("0")
    return f"&#{digits};" if 0 < len(digits) < 8 else "\ufffd"


class _Tokens(HTMLParser):
    """Collects the page's tags and text: (tag, attrs), (tag, None) of an end tag, (None, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple] = []

    def read(self, html: str) -> list[tuple]:
        """The tokens of the whole page."""
        rest = HUGE.sub(_sound, html)
        while rest:
            self.reset()
            try:
                self.feed(rest)
                self.close()
                rest = ""
            except Exception:  # markup that the parser gives up on is skipped, and what comes after it is read
                rest = self.rawdata[(self.rawdata.find(">", self.at) + 1 or len(self.rawdata)) :]
        return self.tokens

    def goahead(self, end):
        self.at = 0
        super().goahead(end)

    def updatepos(self, i, j):
        self.at = j
        return j

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, 0)  # as browsers do: up to the next >

    def handle_starttag(self, tag, attrs):
        self.tokens.append((tag, attrs))

    def handle_endtag(self, tag):
        self.tokens.append((tag, None))

    def handle_data(self, data):
        self.tokens.append((None, data))


def _ended(tokens: list[tuple]) -> set[int]:
    """The numbers of the silent start tags that an end tag of their own closes."""
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # in the stack, by tag
    ended = set()

    def cut(k):
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    for at, (tag, attrs) in enumerate(tokens):
        if tag not in SILENT or tag == "head":
            continue
        k = places[tag][-1] if places[tag] else None
        if attrs is None:
            if k is not None:
                ended.add(stack[k][1])
                cut(k)
        else:
            if k is not None and tag not in NESTING:
                cut(k)
            places[tag].append(len(stack))
            stack.append((tag, at))
    return ended


def _closed_links(tokens: list[tuple]) -> set[int]:
    """The numbers of the start tags of links that end before the next one begins."""
    closed, last = set(), None
    for at, (tag, attrs) in enumerate(tokens):
        if tag == "a":
            if attrs is None and last is not None:
                closed.add(last)
            last = None if attrs is None else at
    return closed


class _Reader:
    """Collects elements, numbered in page order, and blocks of text in them.

    ``tag``, ``parent`` and ``mark`` are of each element (0 is the page); ``blocks`` has (element, parts of text) and
    ``linked`` the characters of each block that lie in links.
    """

    def __init__(self, tokens: list[tuple]):
        self.tag, self.parent, self.mark = [""], [-1], [0]
        self.open = [0]
        self.count: Counter[str] = Counter()  # of open elements by tag
        self.blocks: list[tuple[int, list[str]]] = []
        self.linked: list[int] = []
        #: Places of the silent elements in ``open``, and whether their own end tag comes.
        self.silent: list[tuple[int, bool]] = []
        self.fresh, self.link = True, False
        ended, links = _ended(tokens), _closed_links(tokens)
        for at, (tag, what) in enumerate(tokens):
            if tag is None:
                self._data(what)
            elif what is None:
                self.link &= tag != "a"
                self._end(tag)
            else:
                self.link = at in links if tag == "a" else self.link
                self._start(tag, what, at in ended)

    def _start(self, tag, attrs, ended):
        if tag in VOID:
            self.fresh |= tag == "hr"
            if self.blocks and tag == "br":
                self._data("\n")
            return
        if tag in INLINE:
            if not self.silent and (mark := self._named(attrs)):
                self._push(tag, mark)
            return
        while self.silent and not self.silent[-1][1]:  # one that is never ended hides what comes up to the next block
            self._cut(self.silent[-1][0])
        floor = self.silent[-1][0] if self.silent else 0
        some = any(self.count[t] > 0 for t in ENDS.get(tag, ()))
        for k in range(len(self.open) - 1, floor, -1) if some else ():
            t = self.tag[self.open[k]]
            if t in ENDS.get(tag, ()):
                self._cut(k)
                break
            if t in WALLS:
                break
        if self.silent:
            self._push(tag, 0)
        elif tag in BESIDE or tag == "header" and not (self.count["article"] or self.count["main"]):
            self._push(tag, 2)
        else:
            self._push(tag, 0 if tag in ("html", "body", "article", "main") else max(self._named(attrs, tag in LEAVES), tag == "form"))
        if tag in SILENT and tag != "head":  # what a head leaves open doesn't hide the body
            self.silent.append((len(self.open) - 1, ended))

    def _cut(self, k):
        self.count.subtract(self.tag[n] for n in self.open[k:])
        del self.open[k:]
        while self.silent and self.silent[-1][0] >= k:
            self.silent.pop()
        self.fresh = True

    def _push(self, tag, mark):
        self.parent.append(self.open[-1])
        self.open.append(len(self.tag))
        self.tag.append(tag)
        self.mark.append(int(mark))
        self.count[tag] += 1
        self.fresh = True

    @staticmethod
    def _named(attrs, leaf=False) -> int:
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return 2
        return int(any(k in ("class", "id", "role") and v and _names_furniture(v, leaf) for k, v in attrs))

    def _end(self, tag):
        if not self.count[tag]:
            return
        floor = next((k for k, ended in reversed(self.silent) if ended), 1)  # an end tag in a silent element ends nothing outside
        for k in range(len(self.open) - 1, floor - 1, -1):
            t = self.tag[self.open[k]]
            if t == tag:
                self._cut(k)
                return
            if t in WALLS and tag in ENDS and tag not in WALLS:
                return

    def _data(self, data):
        if self.silent:
            return
        if self.fresh or not self.blocks:
            if not data.strip():
                return
            self.blocks.append((self.open[-1], []))
            self.linked.append(0)
            self.fresh = False
        self.blocks[-1][1].append(data)
        if self.link:
            self.linked[-1] += len("".join(data.split()))


class _Page:
    """The elements and blocks of a page. Sums over elements go from the last to the first, states from the first on."""

    def __init__(self, html: str):
        r = _Reader(_Tokens().read(html))
        self.tag, self.parent, self.named = r.tag, r.parent, r.mark
        found = [(n, " ".join("".join(x).split()), linked) for (n, x), linked in zip(r.blocks, r.linked, strict=True)]
        found = [x for x in found if x[1]]
        self.at, self.text = [n for n, _, _ in found], [t for _, t, _ in found]
        self.last, paths = list(range(len(self.tag))), {}
        self.path = [0] * len(self.tag)
        for n in range(1, len(self.tag)):  # equal tag paths have one number
            self.path[n] = paths.setdefault((self.path[self.parent[n]], self.tag[n]), len(paths) + 1)
        for n in range(len(self.tag) - 1, 0, -1):
            self.last[self.parent[n]] = max(self.last[self.parent[n]], self.last[n])
        #: Blocks that are furniture whatever they lie in: below a heading that says so, or links and nothing else.
        self.own = [0] * len(found)
        for i, (n, t, linked) in enumerate(found):
            alone = not self.level(n) and linked and linked >= LINKED * len(t.replace(" ", ""))
            self.own[i] = int(alone and not (self.tag[n] == "p" and SENTENCE.fullmatch(t)))
        self._below()

    def level(self, n: int) -> int:
        """The level of a heading, else 0."""
        return int(self.tag[n][1]) if self.tag[n] in HEADINGS else 0

    def _below(self) -> None:
        """Mark the blocks of furniture headings and those that they stand for, in the same element.

        Comments go up to the next heading of their rank; other furniture also ends where a path goes on that has been before.
        """
        ends = [-1] * len(self.tag)  # the last block in each element
        for j, n in enumerate(self.at):
            ends[n] = j
        for n in range(len(ends) - 1, 0, -1):
            ends[self.parent[n]] = max(ends[self.parent[n]], ends[n])
        open_: list[tuple[int, int, bool]] = []  # (element, level, comments) of headings whose blocks go on, the innermost last
        seen: set[int] = set()
        for j, (n, t) in enumerate(zip(self.at, self.text, strict=True)):
            level, up = self.level(n), self.parent[n]
            goes_on = not level and self.tag[n] != "li" and self.path[n] in seen and not self.own[j]
            while open_:
                element, rank, talk = open_[-1]
                if ends[element] >= j and not (element == up and 0 < level <= rank) and (talk or not goes_on):
                    break
                open_.pop()
            if level and (FURNITURE.fullmatch(t) or COMMENTS.fullmatch(t)):
                open_.append((up, level, bool(COMMENTS.fullmatch(t))))
            if open_:
                self.own[j] = 2
            else:
                seen.add(self.path[n])

    def summed(self, values) -> list[float]:
        """For each element the sum of the values of the blocks in it."""
        out = [0.0] * len(self.tag)
        for n, v in zip(self.at, values, strict=True):
            out[n] += v
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def ratios(self, marks: list[int]) -> list[float]:
        """The smoothed, fused ratio of every block's path, lowered by its mark."""
        keys = [(self.path[n], m) for n, m in zip(self.at, marks, strict=True)]
        by_path: dict[tuple, list[tuple[float, float]]] = defaultdict(list)
        for key, text in zip(keys, self.text, strict=True):
            by_path[key].append((len(text), len(STOPS.findall(text)) + 0.1))
        order = list(by_path)
        mean = {p: (sum(a for a, _ in v) / len(v), sum(b for _, b in v) / len(v)) for p, v in by_path.items()}

        def smooth(k: int, part: int) -> float:
            near = [(w, mean[order[j]][part]) for j, w in ((k - 1, 0.25), (k, 1.0), (k + 1, 0.25)) if 0 <= j < len(order) and (j == k or not order[j][1])]
            return sum(w * x for w, x in near) / sum(w for w, _ in near)

        ratio = {p: LOWERED[p[1]] * smooth(k, 0) * smooth(k, 1) if LOWERED[p[1]] else 0.0 for k, p in enumerate(order)}
        return [ratio[key] for key in keys]

    def marked(self, mark: list[int]) -> list[int]:
        """The mark of every block, by the marks of the elements that it lies in and its own."""
        worst = [0] * len(mark)
        for n in range(1, len(mark)):
            worst[n] = max(worst[self.parent[n]], mark[n])
        return [max(worst[n], own) for n, own in zip(self.at, self.own, strict=True)]

    def marks(self) -> list[int]:
        """The mark of every block: 0 plain, 1 in an element named furniture or links alone, 2 furniture.

        A name doesn't count on an element that holds almost the whole page, and makes furniture of what lies beside an
        article or main element that has text of its own.
        """
        marks = self.marked(self.named)
        if 1 not in self.named:
            return marks
        held = self.summed([len(t) * r for t, r in zip(self.text, self.ratios([m & 2 for m in marks]), strict=True)])
        plain = self.summed([not m for m in marks])
        article = [int(t in ("article", "main") and p > 0) for t, p in zip(self.tag, plain, strict=True)]
        around, mark = [0] * len(self.tag), list(self.named)
        for n in range(1, len(self.tag)):
            up = self.parent[n]
            around[n] = around[up] + article[up]
            if mark[n] == 1 and held[n] >= WRAPS * held[0] and around[n] == sum(article):
                mark[n] = 0
            elif mark[n] == 1 and sum(article) and not around[n]:
                mark[n] = 2
        return self.marked(mark)

    def main(self, weight: list[float]) -> int:
        """The main container: the deepest element that holds most of the whole, articles first; 0 if only the page does."""
        depth = [0] * len(self.tag)
        for n in range(1, len(depth)):
            depth[n] = depth[self.parent[n]] + 1
        most = [n for n in range(1, len(depth)) if weight[n] >= HOLDS * weight[0] and self.tag[n] not in LEAVES]
        articles = [n for n in most if self.tag[n] in ("article", "main")]
        found = max(articles, key=lambda n: (self.tag[n] == "article", depth[n])) if articles else max(most, key=depth.__getitem__, default=0)
        return 0 if self.tag[found] in ("html", "body") else found


def main_text(html: str | None) -> str:
    """The main text of a page."""
    page = _Page(html or "")
    marks = page.marks()
    ratio = page.ratios(marks)
    least = LEAST * max(ratio, default=0.0)
    if not least:
        return ""
    main = page.main(page.summed([len(t) * r for t, r in zip(page.text, ratio, strict=True)]))
    on_way, n = {0}, main
    while n > 0:
        on_way.add(n)
        n = page.parent[n]
    # an element's branch: the main container, or the element that leaves the way from the page to the container; and the
    # depth at which it leaves
    branch, leaves = [0] * len(page.tag), [0] * len(page.tag)
    for n in range(1, len(branch)):
        up = page.parent[n]
        inside = main and (n == main or branch[up] == main)
        branch[n] = main if inside else n if n in on_way or up in on_way else branch[up]
        leaves[n] = leaves[up] + (n in on_way)
    length: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])  # of a branch: plain text, and what passes near and far
    far = FAR * max(ratio)
    for n, text, r, m in zip(page.at, page.text, ratio, marks, strict=True):
        length[branch[n]][0] += len(text) * (not m)
        length[branch[n]][1] += len(text) * (r >= least)
        length[branch[n]][2] += len(text) * (r >= far)
    climbed = min((leaves[n] for n, r in zip(page.at, ratio, strict=True) if r >= least), default=0)
    page_level = {page.parent[n] for n, t in enumerate(page.tag) if t in ("nav", "header", "footer") and page.named[n] == 2}
    outer, n = 0, main
    while n > 0:
        outer = n if page.tag[n] in ("article", "main") else outer
        n = page.parent[n]
    in_outer = [False] * len(page.tag)
    for n in range(1, len(in_outer)):
        in_outer[n] = n == outer or in_outer[page.parent[n]]
    passing = sum(x for _, x, _ in length.values())

    @lru_cache(maxsize=None)
    def belongs(b: int) -> tuple[float, bool]:
        """The share of the largest ratio that a path needs in a branch, and whether the branch may have text at all."""
        up = page.parent[b]
        if b in (0, main) or not main:
            return LEAST, True
        share = length[b][1] / passing
        if outer and not in_outer[b]:
            return LEAST, share >= OUTER_SHARE
        if page.tag[b] not in LEAVES and (page.tag[up] in ("", "html", "body") or up in page_level):
            return FAR, share >= FAR_SHARE
        return LEAST, True

    full = {b for b, (n, *x) in length.items() if b and 2 * x[belongs(b)[0] == FAR] >= n} | {main} - {0}
    most, out = max(ratio), []
    for n, t, r, m in zip(page.at, page.text, ratio, marks, strict=True):
        need, may = belongs(branch[n])
        heading = page.tag[n] in ("h1", "h2", "h3") and leaves[n] >= climbed
        plain = r > 0 and not m
        if may and (r >= need * most or plain and branch[n] in full) or plain and heading:
            out.append(t)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. One pass without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op7(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
