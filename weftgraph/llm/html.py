"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of elements, with a leaf for each run of text. A node's label says whether its
subtree holds main text. Its features are subtree density, attribute tokens, depth, and statistics of
its siblings and ancestors. Boosted trees give each node a probability, and the decoder picks the labels
of highest likelihood in which no node is kept below one that is dropped.

The trees are fitted on pages that a seeded generator lays out here in many ways, with the labels known;
their number is a parameter. No page of the corpus is needed for the fit.
"""

from __future__ import annotations

import collections
import functools
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import bytescan as bs
from weftgraph.llm import store
from weftgraph.llm.boosting import Boosted

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The next attribute of a tag (a quote delimits only what follows an equals sign), or the tag's end.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+)""")
NAMED = set("class id role itemprop aria-label".split())
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements without content, with raw content, that begin a block, and whose start ends an open one.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg title textarea select".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("table ul ol dl div article section main aside nav body html td form".split())


class Page:
    """Nodes in document order: parent, tag, attribute tokens; leaves have text and a block number."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.text, self.block = [-1], ["html"], [()], [None], [0]
        stack, block, at, n = [0], 0, 0, len(source)
        opened: collections.Counter[str] = collections.Counter()  # elements in the stack by tag

        def leaf(piece: str):
            if piece and not piece.isspace():
                self._add(stack[-1], "#text", (), html.unescape(piece), block)
            elif piece:
                self._add(stack[-1], "#space", (), " ", block)

        def close(i: int):
            for node in stack[i:]:
                opened[self.tag[node]] -= 1
            del stack[i:]

        text = 0  # where the text before the next markup begins
        while at < n:
            at = source.find("<", at)
            if at < 0:
                break
            found = OPEN.match(source, at)
            if not found and source[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1  # a sign, not markup
                continue
            leaf(source[text:at])
            if not found:
                ends = "-->" if source.startswith("<!--", at) else ">"
                end = source.find(ends, at + (4 if ends == "-->" else 2))
                at = text = end + len(ends) if end >= 0 else n
                continue
            tag, at, words = found[2].lower(), found.end(), []
            while part := ATTRIBUTE.match(source, at):
                at = part.end()
                if part[1]:
                    break
                if part[2].lower() in NAMED:
                    words += [t.lower() for t in TOKEN.findall(part[3] or part[4] or part[5] or "")]
            else:  # the page ends inside a tag
                text = n
                break
            text, slashed = at, source[at - 2] == "/"
            if found[1]:
                if tag in RAW:
                    continue
                if tag in BLOCK:
                    block += 1
                for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if self.tag[stack[i]] == tag:
                        close(i)
                        break
                    if tag not in BLOCK and self.tag[stack[i]] in BLOCK:
                        break
                continue
            if tag in RAW:
                if not slashed:
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(source, at)
                    at = text = end.end() if end else n
                continue
            if tag == "html":
                continue
            if tag in BLOCK:
                block += 1
                ends = ENDS.get(tag, set())
                for i in range(len(stack) - 1, 0, -1) if opened["p"] or any(opened[t] for t in ends) else ():
                    held = self.tag[stack[i]]
                    if held == "p" or held in ends:
                        close(i)
                        if held == "p":
                            break
                    elif held in HOLDS:
                        break
            if tag in VOID:
                if tag in ("br", "hr", "img"):
                    self._add(stack[-1], "#space", (), " ", block)
                continue
            node = self._add(stack[-1], tag, tuple(words), None, block)
            if slashed and tag not in BLOCK:
                continue
            stack.append(node)
            opened[tag] += 1
        leaf(source[text:])

    def _add(self, parent, tag, tokens, text, block) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.block.append(block)
        return len(self.parent) - 1

    def features(self, odds: dict[str, float]) -> np.ndarray:
        """One row for each node."""
        parent, tag, n = self.parent, self.tag, len(self.parent)
        chars, link, marks, tags, leaves = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        depth, own, least, most, in_link, children = [0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [False] * n, [0] * n
        order, same = [0] * n, [0] * n
        kinds: dict[tuple[int, str], int] = {}
        for i in range(n):
            up, t = parent[i], tag[i]
            own[i] = odds.get("<" + t, 0.0) + sum(odds.get(w, 0.0) for w in self.tokens[i])
            if up >= 0:
                depth[i], in_link[i] = depth[up] + 1, in_link[up] or t == "a"
                least[i], most[i] = min(least[up], own[i]), max(most[up], own[i])
                order[i], children[up] = children[up], children[up] + 1
                kinds[(up, t)] = kinds.get((up, t), 0) + 1
            text = self.text[i]
            if text is not None and t == "#text":
                chars[i], leaves[i] = len(text), 1
                marks[i] = text.count(",") + text.count(".") + text.count(";")
                link[i] = len(text) if in_link[i] else 0
            elif text is None:
                tags[i] = 1
        for i in range(n - 1, 0, -1):
            up = parent[i]
            chars[up] += chars[i]
            link[up] += link[i]
            marks[up] += marks[i]
            tags[up] += tags[i]
            leaves[up] += leaves[i]
        total = max(1, chars[0])
        log = math.log1p
        rows = []
        for i in range(n):
            up = max(parent[i], 0)
            c, brothers = chars[i], max(1, children[up])
            rows.append((
                own[i], least[i], most[i], least[up], depth[i], log(c), link[i] / max(1, c), 10 * marks[i] / max(1, c), log(tags[i]),
                c / max(1, leaves[i]), c / total, chars[up] / total, log(brothers), order[i] / brothers, kinds.get((up, tag[i]), 1) / brothers,
                link[up] / max(1, chars[up]), own[up], log(chars[up]),
            ))
        return np.array(rows)

    def decode(self, p: np.ndarray) -> list[bool]:
        """Most likely labels in which a kept node has only kept ancestors."""
        n, parent = len(self.parent), self.parent
        p = np.clip(p, 1e-6, 1 - 1e-6)
        keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
        for i in range(n - 1, 0, -1):
            if self.tag[i] == "#space":
                continue
            up = parent[i]
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
        kept = [keep[0] > drop[0]] + [False] * (n - 1)
        for i in range(1, n):
            kept[i] = kept[parent[i]] and (self.tag[i] == "#space" or keep[i] > drop[i])
        return kept

    def render(self, kept: list[bool]) -> str:
        """Kept text: white space as one space, a line for each block."""
        blocks: dict[int, list[str]] = {}
        for i, text in enumerate(self.text):
            if text is not None and kept[i]:
                blocks.setdefault(self.block[i], []).append(text)
        lines = (" ".join("".join(pieces).split()) for pieces in blocks.values())
        return "\n".join(line for line in lines if line)


# --- training pages ----------------------------------------------------------------------------------

#: Names that the generator gives to regions (fixed values).
MAIN_NAMES = "article main content post entry story text body page-content article-body post-content entry-content main-content".split()
WRAP_NAMES = "wrapper container page site layout row col inner outer grid".split()
OTHER = {
    "menu": "nav menu navbar navigation breadcrumb topbar links tabs".split(),
    "header": "header masthead site-header banner logo branding".split(),
    "footer": "footer site-footer copyright bottom legal colophon".split(),
    "sidebar": "sidebar aside widget rail related recommended tags archive".split(),
    "notice": "notice cookie consent gdpr alert popup modal newsletter subscribe paywall".split(),
    "advert": "ad ads advert advertisement sponsor promo banner-ad sponsored".split(),
    "form": "form search login signup contact".split(),
    "comments": "comments comment-list commentlist replies discussion disqus respond".split(),
    "share": "share social sharing buttons meta byline".split(),
}
OTHER_TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "dialog"], "advert": ["div", "aside", "ins"], "form": ["form", "div"], "comments": ["div", "section", "ol"], "share": ["div", "ul", "p"]}


def generated_page(rnd: random.Random) -> str:
    """A page whose main texts all begin with a mark, which labels them and is taken out again."""
    letters = "abcdefghilmnoprstuv"

    def words(n):
        return " ".join("".join(rnd.choices(letters, k=rnd.randint(1, 9))) for _ in range(n))

    def sentences(n):
        return " ".join(words(rnd.randint(3, 14)).capitalize() + rnd.choice([".", ".", ",", "!", "?"]) for _ in range(n))

    def attribute(names):
        name = rnd.choice(names)
        form = rnd.random()
        return f' class="{name}"' if form < 0.5 else f' id="{name}"' if form < 0.7 else f' class="{name} {words(1)}-{rnd.randint(1, 9)}"' if form < 0.85 else ""

    def block(text, main):
        tag = rnd.choice(["p", "p", "p", "p", "div", "li", "blockquote", "h2", "h3", "td"])
        if main and rnd.random() < 0.3:
            text = rnd.choice([f"<b>{text}", f"<em>{text}</em>", f'<a href="/x">{text[:20]}</a>{text[20:]}', f"<span>{text}</span>", f"{text}<br>"])
        return f"<{tag}>{text}" + (f"</{tag}>" if tag != "p" or rnd.random() < 0.8 else "")

    def region(kind):
        tag = rnd.choice(OTHER_TAGS[kind])
        names = OTHER[kind]
        inside = ""
        if kind in ("menu", "share", "sidebar", "footer", "header") and rnd.random() < 0.7:
            items = "".join(f'<li><a href="/{words(1)}">{words(rnd.randint(1, 3))}</a></li>' for _ in range(rnd.randint(2, 8)))
            inside = f"<ul>{items}</ul>" if rnd.random() < 0.7 else items.replace("<li>", "").replace("</li>", " | ")
        if kind == "comments":
            inside = "".join(f'<div class="comment"><p class="author">{words(2)}</p><p>{sentences(rnd.randint(1, 6))}</p></div>' for _ in range(rnd.randint(1, 5)))
        if kind in ("form", "notice") and rnd.random() < 0.6:
            inside = f"<label>{words(2)}</label><input><button>{words(1)}</button>"
        if not inside or rnd.random() < 0.5:
            text = sentences(rnd.randint(1, 4))
            inside += rnd.choice([text, f"<p>{text}</p>", f"&copy; {words(2)} &middot; {text}", f'<a href="/y">{text}</a>'])
        plain = tag in ("nav", "header", "footer", "aside", "form") and rnd.random() < 0.6
        name = "" if plain else f' class="{rnd.choice(names)}"'
        return f"<{tag}{name}>{inside}</{tag}>"

    title = "\x01" + sentences(1)
    long = rnd.random()
    body = [block("\x01" + sentences(rnd.randint(1, 2 + int(24 * long * rnd.random()))), True) for _ in range(rnd.choice([1, 2, 3, 5, 8, 14]))]
    for _ in range(rnd.choice([0, 0, 0, 1, 2])):
        body.insert(rnd.randint(0, len(body)), region(rnd.choice(["advert", "sidebar", "share", "notice", "advert"])))
    head = rnd.choice(["", f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>"])
    tag = rnd.choice(["article", "article", "main", "div", "div", "section", "td"])
    names = "" if tag in ("article", "main") and rnd.random() < 0.7 else f' class="{rnd.choice(MAIN_NAMES)}"' if rnd.random() < 0.7 else f' id="{rnd.choice(MAIN_NAMES)}"'
    main = f"<{tag}{names}>{head}{''.join(body)}</{tag}>" if tag != "td" else f"<table><tr><td{names}>{head}{''.join(body)}</td></tr></table>"
    if rnd.random() < 0.03:
        main = ""
    for _ in range(rnd.randint(0, 2)):
        main = f"<div{attribute(WRAP_NAMES)}>{main}{region('sidebar') if rnd.random() < 0.3 else ''}</div>"
    before = [region(k) for k in ("header", "menu", "notice", "advert", "form") if rnd.random() < 0.5]
    after = [region(k) for k in ("comments", "share", "sidebar", "advert", "footer", "form") if rnd.random() < 0.5]
    rnd.shuffle(before)
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{''.join(before)}<!-- {words(2)} -->{main}{''.join(after)}" + ("</body></html>" if rnd.random() < 0.9 else "")
    return page


def labelled(page: Page) -> np.ndarray:
    """Whether each node's subtree holds marked text; the marks go."""
    n = len(page.parent)
    y = np.zeros(n)
    for i, text in enumerate(page.text):
        if text is not None and "\x01" in text:
            page.text[i] = text.replace("\x01", "")
            y[i] = 1
    # the rest of a marked block belongs to it
    marked = {page.block[i] for i in range(n) if y[i]}
    for i in range(n):
        if page.tag[i] == "#text" and page.block[i] in marked:
            y[i] = 1
    for i in range(n - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return y


@functools.lru_cache(maxsize=2)
def train(pages: int = 700, seed: int = 7) -> tuple[dict[str, float], Boosted]:
    """Log-odds of tags and attribute tokens, and the boosted trees, from generated pages."""
    rnd = random.Random(seed)
    made = [Page(generated_page(rnd)) for _ in range(pages)]
    labels = [labelled(p) for p in made]
    count: dict[str, list[float]] = {}
    for page, y in zip(made, labels, strict=True):
        for i, tag in enumerate(page.tag):
            for word in {"<" + tag, *page.tokens[i]}:
                count.setdefault(word, [1.0, 1.0])[int(y[i])] += 1
    odds = {w: math.log(b / a) for w, (a, b) in count.items() if a + b >= 6}
    x, y = np.concatenate([p.features(odds) for p in made]), np.concatenate(labels)
    use = np.concatenate([np.array([t != "#space" for t in p.tag]) for p in made])
    return odds, Boosted(x[use], y[use])


def extract(pages: DataFrame, training_pages: int = 700) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html): text is the page's main text.

    Null or empty html has an empty text, as has a page without main text. Pages may be of any length and
    depth; unclosed and broken markup ends no run. Null page_ids and urls stay; repeated rows stay. Other columns are ignored. An empty table gives no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(training_pages))

    def run(batches):
        odds, trees = model.value
        for batch in batches:
            source, offsets = bs.utf8(batch.column("html"))
            raw = source.tobytes()
            for a, b in bs.pieces(offsets, 2 << 20):
                parsed = [Page(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")) for i in range(a, b)]
                x = [p.features(odds) for p in parsed]
                p = trees.predict(np.concatenate(x))
                ends = np.cumsum([len(f) for f in x])
                texts = [page.render(page.decode(p[e - len(f) : e])) for page, f, e in zip(parsed, x, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(store.freed(run), "page_id long, url string, text string")


def digest(found: DataFrame) -> DataFrame:
    """page_id, url, text and the number of its code points."""
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
