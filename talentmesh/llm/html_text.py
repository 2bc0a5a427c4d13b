"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks with what their place in the DOM tells.
A logistic classifier gives each block a cost for being content and one for
being boilerplate; these are the capacities to the two terminals.  Blocks
that are adjacent, and blocks that follow each other under one DOM parent,
are tied by smoothness edges.  The minimum cut (max-flow) labels the page.
"""

from __future__ import annotations

import html
import random
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and words in class, id and role attributes.
BLOCK_TAGS = frozenset("""address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary
table tbody td tfoot th thead tr ul""".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr param".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "optgroup": {"optgroup", "option"}}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BOILERPLATE_WORDS = frozenset("""ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs byline-share consent cookie
cookies copyright dialog disclaimer dropdown foot footer gdpr head header hidden legal login masthead menu menubar message modal nav
navbar navigation newsletter notice notification overlay pager pagination paywall popup privacy promo promoted promotion recommended
related search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe tags toc toolbar topbar warning widget
alert complementary contentinfo rail outbrain taboola cta""".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion reader responses reviews".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent page post prose story text".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
HINTS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SIGNS = re.compile(r"[.,;:?!…。]")

(IN_NAV, IN_FOOTER, IN_HEADER, IN_ASIDE, IN_FORM, IN_ARTICLE, BAD_HINT, COMMENT, GOOD_HINT, HEADING, LIST_ITEM, LENGTH, LINKS, SIGN_SHARE,
 SHORT, RIGHTS, BIAS) = range(17)
N_FEATURES = 17
#: What the place in the DOM tells; left out now and then when fitting, so that
#: pages without telling tags are labelled too.
STRUCTURE = [IN_NAV, IN_FOOTER, IN_HEADER, IN_ASIDE, IN_FORM, IN_ARTICLE, BAD_HINT, GOOD_HINT]


@dataclass
class Block:
    text: str
    parent: int
    x: list[float]


def _hints(attrs: str) -> tuple[bool, bool, bool]:
    bad = comment = good = False
    for m in HINTS.finditer(attrs):
        for w in WORD.findall(CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()):
            bad |= w in BOILERPLATE_WORDS
            comment |= w in COMMENT_WORDS
            good |= w in CONTENT_WORDS
    if HIDDEN.search(attrs):
        bad = True
    return bad, comment, good


def parse_blocks(page: str | None) -> list[Block]:
    """Text blocks in page order; markup, scripts, styles and comments are
    gone, character references decoded, white space made one blank."""
    page = page or ""
    out: list[Block] = []
    # open elements: tag, number, and what holds below them
    none = (False,) * 9
    stack: list[tuple[str, int, tuple]] = [("", 0, none)]
    open_tags: dict[str, int] = {}
    number = 0
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush():
        if not parts:
            return
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(p.strip()) for p, a in parts if a)
            total = sum(len(p.strip()) for p, _ in parts) or 1
            tag, parent, f = stack[-1]
            k = len(stack) - 1
            while k and stack[k][0] not in BLOCK_TAGS:
                k -= 1
            heading = any(t in HEADINGS for t, _, _ in stack[max(1, k - 1):])
            n = text.count(" ") + 1
            x = [float(v) for v in f] + [float(heading), float("li" in open_tags and any(t == "li" for t, _, _ in stack[1:])),
                                         min(np.log1p(n) / 5, 1.2), linked / total, min(1.0, len(SIGNS.findall(text)) / n), float(n < 6),
                                         float("©" in text or "all rights reserved" in text.lower()), 1.0]
            out.append(Block(text, stack[k - 1][1] if k else 0, x))
        parts.clear()

    def pop(tag: str):
        nonlocal links
        while len(stack) > 1:
            t, _, _ = stack.pop()
            open_tags[t] -= 1
            if not open_tags[t]:
                del open_tags[t]
            links -= t == "a"
            if t == tag:
                return

    at = 0
    size = len(page)
    find = TOKEN.search
    while at < size:
        m = find(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at:m.start()], links > 0))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag in BLOCK_TAGS:
                flush()
            if tag in open_tags:
                pop(tag)
            elif tag == "p":
                flush()
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in RAW_TAGS:
            if tag == "head":
                continue
            if not attrs.endswith("/") or tag not in ("svg", "iframe"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            if tag in ("textarea", "iframe", "object"):
                flush()
            else:
                parts.append((" ", False)) if tag == "noscript" else None
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in BLOCK_TAGS:
            flush()
            if "p" in open_tags:
                pop("p")
            if tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ("ul", "ol", "menu", "dl", "table", "select", "div", "section", "article"):
                        break
                    if stack[k][0] in CLOSES[tag]:
                        while len(stack) > k:
                            pop(stack[-1][0])
        if tag in VOID_TAGS:
            continue
        number += 1
        nav, foot, head, aside, form, art, bad, com, good = stack[-1][2]
        if tag == "nav" or tag == "menu":
            nav = True
        elif tag == "footer":
            foot = True
        elif tag == "header" and not art:
            head = True
        elif tag in ("aside", "dialog"):
            aside = True
        elif tag in ("form", "button", "select", "fieldset", "label", "input", "option"):
            form = True
        elif tag in ("article", "main"):
            art = True
        if attrs and tag not in ("body", "html"):
            b, c, g = _hints(attrs)
            if tag in ("article", "main"):
                b = b and not g
            if tag == "header" and art:
                b = False
            bad, com, good = bad or b, com or c, good or g
        stack.append((tag, number, (nav, foot, head, aside, form, art, bad, com, good)))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
    flush()
    return out


def weak_label(x: list[float]) -> int | None:
    """1: inside an article and nothing against it; 0: a telling place
    against it; None: unknown."""
    against = any(x[i] for i in (IN_NAV, IN_FOOTER, IN_HEADER, IN_ASIDE, IN_FORM, BAD_HINT, COMMENT))
    if x[IN_ARTICLE] and not against:
        return 1
    return 0 if against else None


def example_pages(n: int = 300, seed: int = 11) -> list[tuple[list[float], int]]:
    """Labelled blocks of made-up pages that hold, in many arrangements,
    what an article should be freed from."""
    r = random.Random(seed)
    out = []

    def words(lo, hi, stops=True):
        w = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(lo, hi))]
        return " ".join(x + (r.choice(".,") if stops and r.random() < 0.12 else "") for x in w) + ("." if stops else "")

    def link_list(k):
        return "<ul>" + "".join(f'<li><a href="/{i}">0{words(1, 3, False)}</a></li>' for i in range(k)) + "</ul>"

    for _ in range(n):
        art = r.choice(["<article>{}</article>", "<main>{}</main>", '<article class="post">{}</article>',
                        '<main id="content"><article class="entry-content">{}</article></main>', '<div class="post-content">{}</div>', '<div id="content">{}</div>', "<div>{}</div>"])
        body = [f"<h1>1{words(4, 10, False)}</h1>"]
        inside = []
        for _ in range(r.randint(2, 7)):
            body.append(f"<p>1{words(r.choice([1, 1, 12]), r.choice([3, 80]) + 12)}</p>")
            if r.random() < 0.25:
                body.append("<ul>" + "".join(f"<li>1{words(1, 9, False)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            if r.random() < 0.1:
                body.append(f"<blockquote>1{words(1, 9)} All rights reserved.</blockquote>")
            if r.random() < 0.1:
                body.append(f'<p>1<a href="/x">{words(2, 6)}</a></p>')
        for piece in ('<div class="ad">0{}</div>', '<section class="comments"><h3>0{}</h3><p>0{}</p></section>', "<aside>0{}</aside>",
                      '<div class="related">0{}</div>', '<form><label>0{}</label><button>0{}</button></form>',
                      '<div class="newsletter">0{}</div>', '<div class="cookie-notice"><p>0{}</p></div>', "<footer>0{}</footer>",
                      '<div id="comments"><ul><li>0{}</li></ul></div>', '<nav>0{}</nav>'):
            if r.random() < 0.25:
                inside.append(piece.replace("{}", words(3, 40)))
        for p in inside:
            body.insert(r.randint(1, len(body)), p)
        page = [f"<nav>{link_list(5)}</nav>" if r.random() < 0.6 else f'<div class="menu">{link_list(5)}</div>' if r.random() < 0.5 else f"<div>{link_list(6)}</div>"]
        if r.random() < 0.5:
            page.append(f"<header>0{words(2, 12, False)}</header>")
        page.append(art.format("".join(body)))
        if r.random() < 0.5:
            page.append(r.choice(['<aside>0{}</aside>', '<div class="sidebar">0{}</div>', '<div id="cookie">0{}</div>']).replace("{}", words(5, 40)))
        page.append(r.choice(["<footer>0&copy; {}</footer>", '<div class="footer">0{}</div>', "<div>0&copy; {} 2020 All rights reserved</div>"]).replace("{}", words(2, 20)))
        for b in parse_blocks("<body>" + "".join(page) + "</body>"):
            out.append((b.x, int(b.text[0] == "1")))
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, seed: int = 3, rounds: int = 30, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton steps; each block is seen twice, the
    second time without its structure features."""
    r = np.random.default_rng(seed)
    bare = x.copy()
    bare[:, STRUCTURE] = 0
    keep = r.random(len(x)) < 0.1
    x, y = np.concatenate((x, bare[keep])), np.concatenate((y, y[keep]))
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (balance * (y - p)) - ridge * w
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(pages: DataFrame | None = None, max_pages: int = 1500, html_col: str = "html", id_col: str = "page_id",
        max_blocks: int = 200_000) -> np.ndarray:
    """Weights from the made-up labelled blocks and, where ``pages`` are given,
    from weakly labelled blocks (400 of a page at most) of about ``max_pages``
    of them, picked by a hash, and of their blocks' distinct figures at most
    ``max_blocks``, likewise.  This bounds the fit alone; extraction reads
    every block of every page."""
    made = example_pages()
    x, y = [b for b, _ in made], [v for _, v in made]
    if pages is not None:
        n = pages.count()
        some = pages.where(F.col(id_col).isNotNull())
        if n > max_pages:
            some = some.where(F.pmod(F.xxhash64(id_col, F.lit(9)), F.lit(1_000_000)) < int(max_pages * 1_000_000 // n))

        def run(batches):
            for b in batches:
                rows = [(bl.x, v) for t in b.column(0).to_pylist() for bl in parse_blocks(t) if (v := weak_label(bl.x)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())),
                                                  pa.array([r[1] for r in rows], pa.int32())], names=["x", "y"])

        got = (some.select(html_col).mapInArrow(run, "x array<double>, y int").groupBy("x", "y")
               .agg(F.count("*").alias("n")).orderBy(F.xxhash64("x", "y"), "x", "y").limit(max_blocks).collect())
        got.sort(key=lambda r: (r["x"], r["y"]))
        x += [list(r["x"]) for r in got]
        y += [r["y"] for r in got]
    return fit_weights(np.array(x), np.array(y, float))


def min_cut(logits: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise the costs of the labels plus
    the weights of edges between different labels; of several minima the
    smallest source side.  Dinic's algorithm from all sources at once."""
    n = len(logits)
    excess = [max(0.0, v) for v in logits]
    demand = [max(0.0, -v) for v in logits]
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, w in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        cap += [w, w]
    eps = 1e-9
    while True:
        level = [-1] * n
        q = deque(i for i in range(n) if excess[i] > eps)
        for i in q:
            level[i] = 0
        met = False
        while q:
            i = q.popleft()
            if demand[i] > eps:
                met = True
            for e in out[i]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    q.append(to[e])
        if not met:
            return [v >= 0 for v in level]
        nxt = [0] * n
        for s in range(n):
            while excess[s] > eps:
                path: list[int] = []
                i = s
                while True:
                    if demand[i] > eps:
                        break
                    while nxt[i] < len(out[i]):
                        e = out[i][nxt[i]]
                        if cap[e] > eps and level[to[e]] == level[i] + 1:
                            break
                        nxt[i] += 1
                    else:
                        if not path:
                            i = -1
                            break
                        i = to[path.pop() ^ 1]
                        nxt[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if i < 0:
                    break
                f = min(excess[s], demand[i], *(cap[e] for e in path))
                excess[s] -= f
                demand[i] -= f
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f


def label_blocks(blocks: list[Block], weights: np.ndarray, adjacent: float = 0.3, sibling: float = 0.3, limit: float = 8.0) -> list[bool]:
    if not blocks:
        return []
    z = np.clip(np.array([b.x for b in blocks]) @ weights, -limit, limit).tolist()
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, adjacent))
        if b.parent in last:
            edges.append((last[b.parent], i, sibling))
        last[b.parent] = i
    return min_cut(z, edges)


def extract_text(page: str | None, weights: np.ndarray) -> str:
    blocks = parse_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights)) if keep)


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and ``text`` of every row.  Null and empty pages,
    and pages without content, give an empty text; repeated rows are handled
    each for itself."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        w = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                text = pa.array([extract_text(t, w) for t in part.column(len(keep)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [text], names=[*keep, "text"])

    return pages.select(*keep, html_col).mapInArrow(run, f"{fields}, text string")
