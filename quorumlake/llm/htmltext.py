"""Main text of web pages: a tree-structured graphical model over DOM nodes with sum-product messages."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import pieces

#: Fixed values of HTML: elements that start a block of text, that hold none, and whose text is never shown or is a form's.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text ends at their own end tag, whatever stands between; and those of which nothing is shown as text.
RAW = set("script style textarea title iframe noembed noframes xmp noscript".split())
MUTED = set("svg math select button object canvas audio video template".split())
FOREIGN = {"svg", "math"}
#: How the model of pages with hardly any structure trusts looks of blocks, tags, names and repetition: few blocks say more each.
BARE_TRUST = (0.7, 1.0, 1.5, 0.5)
#: Elements that stand side by side in lists of comments and teasers.
REPEATING = {"div", "section", "article", "aside", "blockquote", "table", "figure", "details"}
#: An opening tag ends these open elements, up to the nearest of the second list.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
AGAINST = set("ad ads adv advert advertisement adverts advertising banner billboard bottom breadcrumb breadcrumbs byline comment commentlist comments contentinfo complementary consent cookie cookies copyright disqus donate foot footer form gdpr hidden header login masthead menu menubar modal nav navbar navigation navi newsletter notice notices pager paging pagination popup privacy promo promoted promotion recommended recommendations related replies reply respond search share sharing side sidebar signup skip skyscraper social sponsor sponsored subscribe subscription tags toolbar topbar trending warning widget widgets".split())
#: The same in other languages.
AGAINST |= set("anzeige anzeigen barre commentaire commentaires commenti comentario comentarios entete fusszeile fuss hinweis kommentar kommentare kopf kopfzeile leser leserkommentare menue meinungen navegacion navigazione opiniones pied pie pubblicita publicidad publicite reacties reponses respuestas seitenleiste werbung".split())
IN_FAVOUR = set("article articlebody body blog beitrag contenido contenu content contents entry hentry main inhalt maincontent page post postbody primary story storybody text".split())

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What ends a tag, or begins a quoted value in it.
TAG_STOP = re.compile(r">|=\s*([\"'])")
NAMED = re.compile(r"\b(?:class|id|role|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAME = re.compile(r"\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
STATES = 4
CONTENT, OTHER, PAGE, ARTICLE = range(STATES)


class Page:
    """Nodes of a page: parents before children; kind is an element's tag, or None for a block of text."""

    __slots__ = ("parent", "depth", "tag", "marks", "text", "links", "like")

    def __init__(self):
        self.parent, self.depth, self.tag, self.marks, self.text, self.links, self.like = [-1], [0], ["#root"], [0], [None], [0.0], [""]

    def add(self, parent: int, tag: str | None, marks: int, text: str | None = None, links: float = 0.0, like: str = "") -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.marks.append(marks)
        self.text.append(text)
        self.links.append(links)
        self.like.append(like)
        return len(self.tag) - 1


def marks_of(attributes: str) -> int:
    """1: names that speak against main text, 2: names in favour, 3: both, 0: neither."""
    against = favour = False
    for m in NAMED.finditer(attributes):
        names = {w.lower() for w in WORD.findall(m[1])} if m[1] else {"hidden"}
        against |= bool(names & AGAINST)
        favour |= bool(names & IN_FAVOUR)
    return against + 2 * favour


class Tags:
    """The markup of a page in order; every character is looked at a bounded number of times."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in "<>\"'"}
        self.endless: set[str] = set()

    def tag_end(self, at: int) -> int | None:
        """Where the tag whose attributes begin at `at` ends, behind its >; None if it never does.

        A > inside a quoted value is part of it.  If a quote is never closed,
        closed only where another value begins, or nothing ends the tag behind
        it, the first > does.
        """
        if at > self.last[">"]:
            return None
        here = at
        while here <= self.last[">"]:
            m = TAG_STOP.search(self.source, here)
            if m is None:
                break
            if m[1] is None:
                return m.end()
            if m.end() > self.last[m[1]]:
                break
            closed = self.source.index(m[1], m.end())
            if self.source[closed - 1] == "=" and self.source.find(">", m.end(), closed) >= 0:
                break
            here = closed + 1
        return self.source.index(">", at) + 1

    def raw_end(self, tag: str, at: int) -> int | None:
        """Behind the end tag of an element of raw text, None if there is none."""
        if tag in self.endless:
            return None
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.source, at)
        if m is None:
            self.endless.add(tag)
            return None
        return m.end()

    def __iter__(self) -> Iterator[tuple[str, str | None, bool, str]]:
        """(text before, tag or None, whether it ends an element, attributes); raw text is left out."""
        source, at = self.source, 0
        while at < len(source):
            open_ = start = source.find("<", at) if at <= self.last["<"] else -1
            m = None
            while open_ >= 0:
                if source.startswith(("<!", "<?", "</"), open_) or (m := TAG.match(source, open_ + 1)):
                    break
                open_ = source.find("<", open_ + 1)
            if open_ < 0:
                yield source[at:], None, False, ""
                return
            m = TAG.match(source, open_ + 1)
            text = source[at:open_]
            if source.startswith("<!--", open_):
                if source.startswith((">", "->"), open_ + 4):
                    at = source.index(">", open_) + 1
                else:
                    end = source.find("-->", open_ + 4)
                    at = end + 3 if end >= 0 else len(source)
                yield text, None, False, ""
                continue
            if m is None:
                # A declaration, or an end tag without a name: up to the next >.
                end = source.find(">", open_) if open_ <= self.last[">"] else -1
                at = end + 1 if end >= 0 else len(source)
                yield text, None, False, ""
                continue
            end = self.tag_end(m.end())
            if end is None:
                # The page ends inside a tag.
                yield text, None, False, ""
                return
            tag, at = m[2].lower(), end
            yield text, tag, bool(m[1]), source[m.end() : end - 1]
            if tag in RAW and not m[1]:
                over = self.raw_end(tag, at)
                at = over if over is not None else len(source) if tag in ("script", "style") else at


def parse(source: str) -> Page:
    """The block elements of a page and its blocks of text, white space collapsed; tags left open are closed as browsers do."""
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]
    # How many elements of a name are open, so that an end tag without a start costs nothing.
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[bool] = []
    link_level = 0
    # Elements without text that are open, with the height of the stack where they began.
    muted: list[tuple[str, int]] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                inside = sum(len(p) for p, x in zip(parts, linked) if x)
                page.add(stack[-1][1], None, 0, text, inside / max(1, sum(map(len, parts))))
            parts.clear()
            linked.clear()

    def close(names: set[str], until: set[str]) -> None:
        nonlocal link_level
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                for x, _ in stack[k:]:
                    opened[x] -= 1
                del stack[k:]
                link_level = link_level if link_level <= len(stack) else 0
                # What hides text ends with the block that holds it.
                while muted and muted[-1][1] > len(stack):
                    muted.pop()
                return
            if stack[k][0] in until:
                return

    def put(text: str) -> None:
        if not muted:
            parts.append(text)
            linked.append(link_level > 0)

    for text, tag, ends, attributes in Tags(source):
        if text:
            put(entities.unescape(text))
        if tag is None:
            continue
        if ends:
            if tag in MUTED:
                for k in range(len(muted) - 1, -1, -1):
                    if muted[k][0] == tag:
                        del muted[k:]
                        break
            elif tag == "a":
                link_level = 0
            elif tag in BLOCKS:
                close({tag}, {"td", "th"} if tag == "p" else set())
            continue
        if tag in MUTED:
            if tag in ("select", "button"):
                put(" ")
            # Only foreign elements may end in themselves; one more inside another hides nothing more.
            if not (tag in FOREIGN and attributes.endswith("/")) and len(muted) < 64:
                muted.append((tag, len(stack)))
        elif tag == "textarea":
            put(" ")
        elif tag == "br":
            put(" ")
        elif tag == "a":
            link_level = len(stack)
        elif tag in BLOCKS:
            while muted and muted[-1][0] in FOREIGN:
                muted.pop()
            flush()
            if not muted:
                close({"p"}, {"td", "th"})
                if tag in ENDS:
                    close(*ENDS[tag])
            if tag not in VOID:
                name = NAME.search(attributes) if attributes else None
                stack.append((tag, page.add(stack[-1][1], tag, marks_of(attributes) if attributes else 0, like=name[0] if name else "")))
                opened[tag] += 1
    flush()
    return page


def leaf_class(text: str, links: float) -> tuple[int, int, int]:
    """Classes of a block's length in words, of its share inside links, and of how it ends."""
    n = text.count(" ") + 1
    return min(int(np.log2(n)), 7), 0 if links < 0.1 else 1 if links < 0.6 else 2, 1 if text[-1] in ".!?:;\"'”»…" else 0


def repeated(page: Page) -> list[int]:
    """0: a node unlike its siblings in tag and class, or without one; 1: one of two alike; 2: one of several.  Paragraphs, items, rows and headings are alike by nature: 0."""
    keys = [(p, t, c) if c and t in REPEATING else None for p, t, c in zip(page.parent, page.tag, page.like)]
    times = Counter(keys)
    return [0 if k is None else min(times[k] - 1, 2) for k in keys]


class Forest:
    """Nodes of many pages as arrays."""

    def __init__(self, pages: list[Page], tags: dict[str, int]):
        base = np.r_[0, np.cumsum([len(p.tag) for p in pages])].astype(np.int64)
        self.base = base
        parent = [np.array(p.parent) for p in pages]
        self.parent = np.concatenate([np.where(q >= 0, q + b, -1) for q, b in zip(parent, base)]) if pages else np.zeros(0, np.int64)
        self.depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, np.int64)
        tag = [t for p in pages for t in p.tag]
        self.leaf = np.array([t is None for t in tag], bool)
        self.tag = np.array([tags.get(t, 0) for t in tag], np.int64)
        # A block's own tag is its parent's.
        self.tag[self.leaf] = self.tag[self.parent[self.leaf]]
        self.marks = np.array([m for p in pages for m in p.marks], np.int64)
        self.rep = np.array([x for p in pages for x in repeated(p)], np.int64)
        self.look = np.zeros((len(tag), 3), np.int64)
        found = [leaf_class(t, x) for p in pages for t, x in zip(p.text, p.links) if t is not None]
        if found:
            self.look[self.leaf] = found


class ContentTree:
    """A tree-structured model with potentials by counting labelled pages.

    States: content, other, and two for nodes with both below: page, above the
    deepest node that holds all content, and article, from that node down.
    Blocks of one place look alike, so their looks are no independent evidence:
    trust weighs the looks of blocks, of tags, of names and of repetition down or up.

    Parent and child are tied by P(child state | parent state); a node's looks
    by P(look | state).  Blocks of text are never mixed.
    """

    trust = (0.2, 0.6, 2.5, 1.0)

    def __init__(self, tags: dict[str, int], root: np.ndarray, move: np.ndarray, leaf_move: np.ndarray, tag: np.ndarray, marks: np.ndarray, leaf_tag: np.ndarray, looks: list[np.ndarray], rep: np.ndarray):
        self.rep = rep
        self.tags, self.root, self.move, self.leaf_move = tags, root, move, leaf_move
        self.tag, self.marks, self.leaf_tag, self.looks = tag, marks, leaf_tag, looks

    @classmethod
    def fit(cls, labelled: list[tuple[str, set[str]]], most: int = 2000, soft: float = 0.1, trust: tuple[float, float, float, float] | None = None) -> ContentTree:
        """labelled: pages and the texts of their content blocks; of more than `most` pages the first are used."""
        labelled = labelled[:most]
        pages = [parse(h) for h, _ in labelled]
        tags = {t: i + 1 for i, t in enumerate(sorted(BLOCKS | {"#root"}))}
        f = Forest(pages, tags)
        n = len(f.leaf)
        has = np.zeros((n, 2), np.int64)
        texts = [(t, good) for p, (_, good) in zip(pages, labelled) for t in p.text]
        for i, (t, good) in enumerate(texts):
            if t is not None:
                has[i, 0 if t in good else 1] = 1
        for i in range(n - 1, 0, -1):
            if f.parent[i] >= 0:
                has[f.parent[i]] += has[i]
        whole = has[np.repeat(f.base[:-1], np.diff(f.base)), 0]
        above = np.zeros(n, bool)
        all_of = (has[:, 0] == whole) & (f.parent >= 0)
        above[f.parent[all_of]] = True
        mixed = np.where(above, PAGE, ARTICLE)
        state = np.where((has > 0).all(1), mixed, np.where(has[:, 0] > 0, CONTENT, OTHER))

        def share(shape: tuple[int, ...], *index: np.ndarray) -> np.ndarray:
            table = np.full(shape, soft)
            np.add.at(table, index, 1)
            return table / table.sum(-1, keepdims=True)

        inner, leaf, child = ~f.leaf & (f.depth > 0), f.leaf, f.parent >= 0
        up = state[np.maximum(f.parent, 0)]
        move = share((STATES, STATES), up[inner], state[inner])
        leaf_move = share((STATES, STATES), up[leaf & child], state[leaf & child])
        # Blocks of text are one or the other; elsewhere a trace stays for pages unlike the labelled ones.
        leaf_move[:, [PAGE, ARTICLE]] = 0
        root = share((STATES,), state[f.depth == 0])
        sized = len(tags) + 1
        tree = cls(
            tags, root, move, leaf_move / leaf_move.sum(-1, keepdims=True), share((STATES, sized), state[inner], f.tag[inner]), share((STATES, 4), state[inner], f.marks[inner]),
            share((STATES, sized), state[leaf], f.tag[leaf]), [share((STATES, k), state[leaf], f.look[leaf, j]) for j, k in enumerate((8, 3, 2))],
            share((STATES, 3), state[inner], f.rep[inner]),
        )
        tree.trust = trust or cls.trust
        return tree

    def marginals(self, f: Forest) -> np.ndarray:
        """P(content) of every node: messages from the leaves up, then from the roots down."""
        n = len(f.leaf)
        blocks = np.log(self.leaf_tag[:, f.tag].T) + sum(np.log(table[:, f.look[:, j]].T) for j, table in enumerate(self.looks))
        log = np.where(f.leaf[:, None], self.trust[0] * blocks, self.trust[1] * np.log(self.tag[:, f.tag].T) + self.trust[2] * np.log(self.marks[:, f.marks].T) + self.trust[3] * np.log(self.rep[:, f.rep].T))
        log[f.depth == 0] = 0.0
        levels = np.split(np.argsort(f.depth, kind="stable"), np.cumsum(np.bincount(f.depth))[:-1]) if n else []
        sent = np.zeros((n, STATES))
        for at in reversed(levels[1:]):
            belief = np.exp(log[at] - log[at].max(1, keepdims=True))
            message = np.where(f.leaf[at][:, None], belief @ self.leaf_move.T, belief @ self.move.T)
            sent[at] = np.log(message)
            np.add.at(log, f.parent[at], sent[at])
        for d, at in enumerate(levels):
            if d == 0:
                log[at] += np.log(self.root)
                continue
            # What the parent believes without this child's own message.
            above = log[f.parent[at]] - sent[at]
            above = np.exp(above - above.max(1, keepdims=True))
            log[at] += np.log(np.where(f.leaf[at][:, None], above @ self.leaf_move, above @ self.move) + 1e-300)
        p = np.exp(log - log.max(1, keepdims=True)) if n else log
        return p[:, CONTENT] / p.sum(1) if n else np.zeros(0)

    def extract(self, sources: list[str], bare: ContentTree | None = None) -> list[str]:
        """The content blocks of each page in page order, one line each; pages in which this tree finds none are left to another one, for pages with hardly any structure."""
        pages = [parse(s) for s in sources]
        f = Forest(pages, self.tags)
        good = self.marginals(f) > 0.5
        out = []
        for page, a in zip(pages, f.base.tolist()):
            out.append("\n".join(t for k, t in enumerate(page.text) if t is not None and good[a + k]))
        if bare and (lost := [k for k, t in enumerate(out) if not t and any(x is not None for x in pages[k].text)]):
            for k, t in zip(lost, bare.extract([sources[k] for k in lost])):
                out[k] = t
        return out


def labelled_pages(n: int = 400, seed: int = 5, plain: bool = False) -> list[tuple[str, set[str]]]:
    """Labelled training pages: invented words in the layouts of news, blog, shop and plain pages, with their content blocks; or pages with hardly any structure."""
    r = random.Random(seed)
    serial = iter(range(10**9))

    def words(a: int, b: int, stop: str = ".") -> str:
        # The serial number keeps blocks apart, so that a label is the block's own.
        k = next(serial)
        body = ["".join(r.choice("ba re ti on the el ku sch io né").replace(" ", "") + r.choice(["an", "er", "ou", "is", ""]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b))]
        return " ".join(" ".join([*body[:1], f"q{k}", *body[1:]]).split()).capitalize() + stop

    def bare(keep, mute, links, foot, form) -> str:
        """Hardly any structure: a few blocks, often one, in elements that say nothing or in none, with or without links beside them."""
        lines = lambda: r.choice(["<br>", "<br><br>", "<br/>"]).join(keep_all(words(4, 60) for _ in range(r.randint(1, 4))))

        def keep_all(parts) -> list[str]:
            # Line breaks leave one block.
            parts = list(parts)
            keep(" ".join(parts))
            return parts

        own = lambda: r.choice(["", "", f" class={mute('text')}", f" class=x{r.randint(1, 9)}", f" id={r.choice(['text', 'inhalt', 'main', 'body'])}"])
        block = lambda: r.choice([lambda: f"<p>{keep(words(3, 80))}</p>", lambda: f"<p>{keep(words(3, 80))}</p>", lambda: f"<p>{keep(words(3, 80))}", lambda: f"<div{own()}>{lines()}</div>", lambda: f"<div{own()}><p>{keep(words(3, 80))}</p></div>", lambda: f"<div{own()}><span>{keep(words(3, 80))}</span></div>"])()
        title = ""
        if r.random() < 0.3:
            opens, ends = r.choice([("<h1>", "</h1>"), ("<h2>", "</h2>"), ("<h3>", "</h3>"), ("<center><b>", "</b></center>")])
            title = f"{opens}{keep(words(0, 6, ''))}{ends}"
        text = lines() if r.random() < 0.15 else r.choice(["", "<hr>"]).join(block() for _ in range(r.choice([1, 1, 1, 2, 2, 3, 6])))
        menu = lambda: r.choice([lambda: links(r.randint(2, 6)), lambda: f"<div{own()}>" + " ".join(f"<a href=/{k}>{words(0, 2, '')}</a>" for k in range(r.randint(2, 5))) + "</div>", lambda: f"<nav>{links(r.randint(2, 6))}</nav>", lambda: f"<div id={r.choice(['menu', 'menue', 'nav'])}>{links(r.randint(2, 6))}</div>", lambda: f"<p><a href=/b>{words(0, 1, '')}</a></p>"])()
        return (menu() if r.random() < 0.3 else "") + title + text + (menu() if r.random() < 0.25 else "") + (form() if r.random() < 0.08 else "") + (foot() if r.random() < 0.15 else "")

    def page() -> tuple[str, set[str]]:
        good: set[str] = set()
        names = r.random() < 0.85
        # Some sites have names that say nothing.
        blank = r.random() < 0.12
        mute = lambda c: f"{r.choice('cxbm')}{r.randint(1, 99)}" if blank else c
        named = lambda *c: f' {r.choice(["class", "id"])}="{r.choice(c)}"' if names and r.random() < 0.9 else ""
        keep = lambda t: good.add(t) or t
        links = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{words(0, 3, "")}</a></li>' for i in range(k)) + "</ul>"

        def prose() -> str:
            t = keep(words(1, 120) if r.random() < 0.85 else words(0, 5))
            kind = r.random()
            if kind < 0.8:
                return f"<p>{t}" + r.choice(["</p>", "</p>", ""])
            if kind < 0.86:
                return f"<h2>{t}</h2>" if r.random() < 0.7 else f"<h3>{t}</h3>"
            if kind < 0.9:
                return f"<blockquote><p>{t}</p></blockquote>"
            if kind < 0.95:
                return "<ul>" + "".join(f"<li>{keep(words(2, 25))}</li>" for _ in range(r.randint(1, 4))) + f"</ul><p>{t}</p>"
            return f"<pre>{t}</pre>" if r.random() < 0.5 else f"<table><tr><td>{t}</td><td>{keep(words(1, 4))}</td></tr></table>"

        def comments() -> str:
            own = named(*(mute(c) for c in ("comment", "comment-body", "reply", "kommentar")))
            each = "".join(f'<div{own}>{r.choice(["", "", f"<b>{words(0, 2, str())}</b>", f"<div>{words(0, 2, str())}</div>"])}<p>{words(3, 70)}</p>' + r.choice(["", f"<p>{words(1, 3)}</p>"]) + "</div>" for _ in range(r.choice([1, 2, 2, 3, 3, 4, 6, 9])))
            return f'<{(t := r.choice(["section", "div", "div"]))} {r.choice(["class", "id"])}="{r.choice([mute(c) for c in ("comments", "comment-list", "comments-area", "replies", "disqus", "reader-comments", "kommentare", "commentaires", "comentarios")])}"><h3>{words(1, 3, "")}</h3>{each}</{t}>'

        ad = lambda: f'<{(t := r.choice(["div", "div", "aside", "section"]))} class="{r.choice(["ad", "ads", "advert", "sponsored", "promo", "banner-ad"])}">' + r.choice(["<p>{}</p>", "{}"]).format(words(2, 30)) + f"</{t}>"
        notice = lambda: f'<div {r.choice(["class", "id"])}="{r.choice(["notice", "cookie-notice", "cookie-banner", "gdpr-consent", "warning", "privacy-notice"])}"><p>{words(5, 40)}</p></div>'
        form = lambda: f"<form{named('newsletter', 'search', 'login', 'subscribe')}><label>{words(1, 5, '')}</label><input><p>{words(2, 14)}</p><button>{words(1, 2, '')}</button></form>"
        side = lambda: (lambda t, c: f"<{t}{c}><h3>{words(1, 3, '')}</h3>{links(r.randint(2, 8))}" + r.choice(["", f"<p>{words(4, 50)}</p>", f"<div>{words(4, 30)}</div>"]) + f"</{t}>")(*r.choice([("aside", ""), ("aside", ' class="sidebar"'), ("div", ' id="sidebar"'), ("div", ' class="widget related"')]))
        menu = lambda: r.choice([lambda: f"<nav>{links(r.randint(3, 9))}</nav>", lambda: f'<div {r.choice(["class", "id"])}="{mute(r.choice(["menu", "nav", "navbar", "breadcrumb", "navegacion"]))}">{links(r.randint(2, 9))}</div>'])()
        head = lambda: r.choice([lambda: f"<header><h1>{words(1, 4, '')}</h1><p>{words(2, 9)}</p>{menu()}</header>", lambda: f'<div id="header"><h2>{words(1, 3, "")}</h2></div>{menu()}', menu])()
        foot = lambda: r.choice([lambda: f"<footer>&copy; {words(2, 25)}</footer>", lambda: f"<footer><p>{words(3, 40)}</p>{links(3)}</footer>", lambda: f'<div {r.choice(["class", "id"])}="{mute(r.choice(["footer", "site-footer", "copyright", "fusszeile"]))}">{words(3, 30)}</div>'])()
        if plain:
            return f"<html><body>{bare(keep, mute, links, foot, form)}</body></html>" if r.random() < 0.7 else bare(keep, mute, links, foot, form), good
        paragraphs = [prose() for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25]))]
        if r.random() < 0.3:
            paragraphs.insert(r.randint(1, len(paragraphs)), ad())
        title = f"<h1>{keep(words(2, 11, r.choice(['', '.'])))}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        if len(paragraphs) > 2 and r.random() < 0.1:
            # Chapters.
            t, c, k = r.choice(["section", "section", "div"]), r.choice(["", "", ' class="chapter"']), r.randint(1, 3)
            paragraphs = [f"<{t}{c}><h2>{keep(words(0, 3, ''))}</h2>{''.join(paragraphs[i : i + k])}</{t}>" for i in range(0, len(paragraphs), k)]
        inner = title + "".join(paragraphs) + (comments() if r.random() < 0.15 else "")
        kind = r.random()
        if kind < 0.5:
            main = f"<article{named('post', 'entry', 'story')}>{inner}</article>" if r.random() < 0.9 else f"<article>{inner}"
            main = f"<main>{main}</main>" if r.random() < 0.4 else main
        elif kind < 0.65:
            main = f"<main{named('content', 'main')}>{inner}</main>"
        elif kind < 0.9:
            main = f'<div {r.choice(["class", "id"])}="{r.choice([mute(c) for c in ("content", "main-content", "article-body", "post", "entry-content", "story", "text", "inhalt")])}">{inner}</div>'
        else:
            main = r.choice(["<div>{}</div>", "{}", "<table><tr><td>{}</td></tr></table>"]).format(inner)
        rest = [x() for x in (ad, notice, side, form) if r.random() < 0.45]
        late = [x() for x in (ad, side, form, comments, notice) if r.random() < 0.3]
        r.shuffle(rest)
        body = head() + "".join(rest) + main + "".join(late) + foot()
        if r.random() < 0.3:
            body = f'<div{named("wrapper", "page", "container")}>{body}</div>'
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>", good

    return [page() for _ in range(n)]


def main_text(pages: DataFrame, *, labelled: list[tuple[str, set[str]]] | None = None, id_col: str = "page_id", html_col: str = "html", most: int = 2000) -> DataFrame:
    """id, text and n_chars (code points) of every row: the main text's blocks in page order, one line each.

    The model is fitted on labelled pages (at most `most`), by default the
    invented ones of labelled_pages; then a page in which it finds nothing is
    judged by a second one, fitted on invented pages with hardly any structure,
    so a lone paragraph is not lost.  White space inside a block becomes one
    space, character references are decoded, and nothing else is changed, so
    pages of any length are used whole.  Null and empty pages, and those with no
    content block, have the text "".  Repeated rows give a row each, null ids
    stay null; an empty table gives no rows; other columns are not read.
    """
    model = ContentTree.fit(labelled if labelled is not None else labelled_pages(), most)
    bare = ContentTree.fit(labelled_pages(plain=True), most, trust=BARE_TRUST) if labelled is None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20, "html"):
                texts = model.extract([x or "" for x in batch.column("html").to_pylist()], bare)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string, n_chars long").withColumnRenamed("id", id_col)
