"""HTML main text by minimum-cut labelling of a page's text blocks.

A page is cut into text blocks at block-level tags. A block's classifier score becomes the capacity of its edge to
the content terminal (score above 0) or the boilerplate terminal (below 0); blocks that follow each other and blocks
of one container are tied by smoothness edges, weaker across the edges of menus, asides and the like. A maximum flow
then separates content from boilerplate at the least total cost. Pages are independent, so the work is map-only.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.common import texts

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes template svg math select object video audio canvas".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead tr ul caption button label".split()
)
HEADINGS = {f"h{i}" for i in range(1, 7)}
BOILER = set("nav footer aside form menu dialog button noscript head label fieldset".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "main", "aside", "nav", "footer", "header", "form", "div", "blockquote"}
# Words in class and id tokens. Parts of a layout; notices and forms that cover a page; reader comments.
LAYOUT = (
    r"ads?|adverts?|advertis\w*|adsense|banner\w*|promo\w*|sponsor\w*|shar(?:e|ing)|social|side-?bar|related|recommend\w*|nav|navbar|navigation|menus?|breadcrumbs?|foot(?:er)?|page-?header"
    r"|site-?header|masthead|search|widgets?|tags?|pagination|pager|toolbar|skip\w*|taboola|outbrain|teasers?|trending|popular|byline|meta"
)
NOTICES = r"cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w*|sign-?up|copyright|legal|login|log-?in|disclaimer|paywall"
THREADS = r"comments?|comment\w*|repl(?:y|ies)|respond|responses|disqus|discussions?|guestbook"
_NAMES = re.compile(rf"(?:^|[\s_-])(?:(?P<thread>{THREADS})|(?P<notice>{NOTICES})|(?P<layout>{LAYOUT}))(?=$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|story|post|entry|content|body|main|text|prose)(?:$|[\s_-])", re.I)
# what a page has or lacks, said on its wrapper
_ABOUT = re.compile(r"(?:^|(?<=[_-]))(?:has|with|without|no)[_-].*", re.I)
# Headings of comment threads that say how many there are or ask for one, and bare ones; a comment's own line.
_THREAD_HEAD = re.compile(
    r"(?:\d+|no|one|two|three) (?:reader |user )?(?:comments?|thoughts?|repl(?:y|ies)|responses?|reactions?|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)\b.{0,80}"
    r"|(?:comments?|responses?|repl(?:y|ies)|kommentare|commentaires|comentarios|respuestas) ?[(:] ?\d+\)?"
    r"|(?:leave|post|write|add) (?:a|your) (?:reply|comment|response)\b.{0,40}|join the (?:discussion|conversation)\b.{0,40}"
    r"|(?:schreiben? (?:sie )?einen kommentar|hinterlasse einen kommentar|laissez? un commentaire|deja (?:un comentario|una respuesta))\b.{0,40}", re.I)  # fmt: skip
_BARE_HEAD = re.compile(r"(?:reader |user |your )?(?:comments?|discussion|responses?|replies|reactions?|thoughts|feedback|kommentare|diskussion|commentaires|réactions|comentarios)", re.I)
_BYLINE = re.compile(
    r"\b(?:said|says|wrote|writes|replied|replies|commented|schrieb|schreibt|sagte?|a écrit|a dit|escribió|dijo)\b.{0,60}$|\b(?:\d+|an?) (?:second|minute|hour|day|week|month|year)s? ago\b|^vor \d+ |^il y a \d+ |^hace \d+ "
    r"|^(?:reply|antworten|répondre|responder|report|like|permalink)\b|\b(?:at|um|à|a las) \d{1,2}[:.h]\d{2}\b|^(?:posted |comment )?(?:by|von|par|por) \S+.{0,60}\d", re.I)  # fmt: skip
_COOKIES = re.compile(r"\b(?:we|our|this (?:web)?site|this page|wir|unsere|diese (?:web)?seite|nous|ce site|nosotros|este sitio|esta web)\b.{0,60}\b(?:us(?:e|es|ing)|stores?|verwende[nt]?|nutz(?:t|en)|utilis\w+|usa(?:mos)?|utiliza\w*)\b.{0,60}\bcookies?\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BAD_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[a-zA-Z/][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SCALE, ADJACENT, KIN, ACROSS = 100, 1.0, 0.8, 0.2
NAMED, ROLE, HIDDEN, THREAD, COOKIES = 7.0, 6.0, 20.0, 8.0, 9.0
LAYOUT_SHARE, OTHER_SHARE = 0.5, 0.9


def _named(names: str) -> str:
    """What the class and id tokens name: a thread, a notice, a part of a layout, or nothing."""
    found = {m.lastgroup for t in names.split() if not t.lower().startswith("tag-") for m in _NAMES.finditer(_ABOUT.sub("", t))}
    return next((k for k in ("thread", "notice", "layout") if k in found), "")


class Node:
    """An element; ``bad`` is the greatest of what elements, roles and names around it say against it.

    ``kind`` and ``names`` are what the element itself adds, ``text`` and ``heading`` what it holds (set once the page
    is read). An article or main part inside a wrapper with a name speaks for itself, and its own names are topics of
    its text, unless they say that it is a comment; one inside an aside, or a hidden one, does not.
    """

    __slots__ = ("tag", "parent", "block", "kind", "names", "main", "article", "good", "like", "text", "heading", "bad", "bad_kind", "bad_name")

    def __init__(self, tag: str, parent: Node | None, attrs: str):
        self.tag, self.parent = tag, parent
        up = parent
        self.block = self if tag in BLOCKS or up is None else up.block
        self.article = bool(up and up.article) or tag == "article"
        self.good = 1.5 if tag == "main" else up.good if up else 0.0
        self.kind, self.names, self.text, self.heading = 0.0, "", 0, False
        a = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attrs)} if attrs else {}
        role = a.get("role", "").lower()
        self.main = tag in ("article", "main") or role in ("article", "main")
        self.like = (tag, a.get("class", ""))
        if tag in BOILER or tag == "header" and not self.article:
            self.kind = ROLE
        if a:
            names = f"{a.get('class', '')} {a.get('id', '')}"
            if names != " " and tag not in ("html", "body"):
                self.names = _named(names)
                if self.main and self.names != "thread":
                    self.names = ""
                if not self.names and _GOOD.search(names):
                    self.good = max(self.good, 1.5)
            if role in BAD_ROLES:
                self.kind = ROLE
            if role in ("main", "article"):
                self.good = max(self.good, 1.5)
            if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
                self.kind = HIDDEN

    def settle(self, total: int, articles: int) -> None:
        """Weigh what speaks against the element, its parent being settled: a wrapper of the page's text isn't a part of it.

        A name or a form that holds half of the text is a layout's, if no article or main part stands outside; names of notices
        and threads need a main heading, too, or nearly all of the text.
        """
        up, share = self.parent, self.text / max(1, total)
        wraps = share >= LAYOUT_SHARE and (self.heading or self.text >= articles > 0 or not articles)
        whole = share >= OTHER_SHARE or share >= LAYOUT_SHARE and (self.heading or self.main)
        name = NAMED if self.names and not (wraps if self.names == "layout" else whole) else 0.0
        kind = 0.0 if self.tag == "form" and self.kind < HIDDEN and wraps else self.kind
        self.bad_kind = max(up.bad_kind if up else 0.0, kind)
        self.bad_name = max(up.bad_name if up and not self.main else 0.0, name)
        self.bad = max(self.bad_kind, self.bad_name)


class Block:
    __slots__ = ("text", "node", "linked", "words", "bad")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked, self.words, self.bad = text, node, linked, text.count(" ") + 1, 0.0


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; markup may be cut off anywhere or left unclosed."""
    root = at = Node("html", None, "")
    nodes, opened = [root], {"html": 1}
    out: list[Block] = []
    parts: list[str] = []
    link, linked = 0, 0
    owner = root

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, owner, min(linked, len(text))))
        parts, linked = [], 0

    def leave(x: Node) -> None:
        """Close all elements up to ``x``."""
        nonlocal at
        while at is not x.parent:
            opened[at.tag] -= 1
            at = at.parent

    def close(names: set[str], until: set[str]) -> None:
        if not any(opened.get(n) for n in names):
            return  # else a stray end tag would look through the whole depth
        x = at
        while x is not root and x.tag not in names:
            if x.tag in until:
                return
            x = x.parent
        if x is not root:
            leave(x)

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        start = m.start() if m else size
        if start > pos:
            text = page[pos:start]
            if not parts:
                owner = at.block
            parts.append(text)
            if link:
                linked += len(text)
        if not m:
            break
        pos = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a":
                link = 0
            if tag in BLOCKS:
                flush()
                close({tag}, set())
            elif tag not in VOID and opened.get(tag):
                x = at
                while x is not root and x.tag not in BLOCKS and x.tag != tag:
                    x = x.parent
                if x.tag == tag and x is not root:
                    leave(x)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else size if tag in ("script", "style", "title") else pos
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif parts:
                parts.append(" " if tag in ("br", "img", "input") else "")
            continue
        if tag in BLOCKS:
            flush()
            link = 0
            if tag not in ("label", "button", "option"):
                close({"p"}, SCOPE)
            if tag in CLOSES:
                close(CLOSES[tag], SCOPE - {"div"} if tag == "li" else {"table"} if tag in ("td", "th", "tr") else SCOPE)
            if tag in HEADINGS:
                close(HEADINGS, SCOPE)
            if tag == "body" and at is not root:
                leave(next_to_root(at, root))
        if tag == "a":
            link = 1
        if not m[0].endswith("/>") or tag in BLOCKS:
            at = Node(tag, at, m["attrs"] or "")
            nodes.append(at)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    judge(out, nodes)
    return out


def next_to_root(x: Node, root: Node) -> Node:
    while x.parent is not root:
        x = x.parent
    return x


def judge(bs: list[Block], nodes: list[Node]) -> None:
    """Set what speaks against each block: its elements, then comment threads and cookie sentences by their form.

    ``nodes`` has each element after its parent, so two passes over it add up the text that elements hold, and settle
    them; both are linear, however deep the page is.
    """
    total = 0
    for b in bs:
        b.node.text += len(b.text)
        b.node.heading = b.node.heading or b.node.tag == "h1"
        total += len(b.text)
    for x in reversed(nodes[1:]):
        x.parent.text += x.text
        x.parent.heading = x.parent.heading or x.heading
    articles = sum(x.text for x in nodes if x.main and x.names != "thread" and not (x.parent and x.parent.article))
    for x in nodes:
        x.settle(total, articles)
    for b in bs:
        b.bad = max(b.node.bad, COOKIES if b.words <= 80 and "cookie" in b.text.lower() and _COOKIES.search(b.text) else 0.0)
    threads(bs)


def threads(bs: list[Block]) -> None:
    """Mark reader comments that no name gives away.

    They come after the text: behind a heading that counts or asks for comments, to the end of its element; or as two
    or more elements of one form beside each other, most of which have a line on who said it and when, a bare heading such as
    "Comments" before them making that certain.
    """
    prose = 0
    alike: dict[tuple, dict[int, list[int]]] = {}
    inside: set[int] = set()  # of the elements whose rest is a thread
    bare: dict[int, int] = {}
    for i, b in enumerate(bs):
        x, depth = b.node, 0
        marked = False
        while x is not None and depth < 12:
            if id(x) in inside:
                marked = True
                break
            if x.parent is not None and depth < 6:
                alike.setdefault((id(x.parent), *x.like), {}).setdefault(id(x), []).append(i)
            x, depth = x.parent, depth + 1
        heads = b.node.tag in HEADINGS or b.words <= 8
        if heads and prose and len(b.text) <= 120 and b.node.parent is not None:
            if _THREAD_HEAD.fullmatch(b.text) and b.node.tag in HEADINGS:
                inside.add(id(b.node.parent))
                marked = True
            elif _BARE_HEAD.fullmatch(b.text) and b.node.tag in HEADINGS:
                bare[id(b.node.parent)] = i
        if marked:
            b.bad = max(b.bad, THREAD)
        elif not b.bad:
            prose += b.words >= 12
    for (parent, *_), members in alike.items():
        first = min(own[0] for own in members.values())
        certain = parent in bare and bare[parent] < first
        if len(members) < 2 and not certain:
            continue
        signed = sum(len(own) > 1 and any(bs[i].words <= 14 and _BYLINE.search(bs[i].text) for i in own) for own in members.values())
        if 2 * signed <= len(members):
            continue
        if not any(bs[j].words >= 12 and not bs[j].bad for j in range(first)):
            continue  # nothing is said before: the posts are the page
        start = bare[parent] if certain else first
        for i in range(start, max(own[-1] for own in members.values()) + 1):
            bs[i].bad = max(bs[i].bad, THREAD)


def score(b: Block) -> float:
    """The classifier: above 0 speaks for content, below for boilerplate."""
    n = b.node
    s = min(b.words, 60) / 30 - 0.3 - 3 * b.linked / max(1, len(b.text)) - b.bad + n.good
    s += 2.5 if n.article else 0
    s += 0.5 if n.tag in HEADINGS else 0.7 if n.tag in ("p", "pre", "blockquote") else -0.3 if n.tag == "li" else 0
    s += 0.5 if b.text[-1] in ".!?…\"”»" else 0
    s -= 1.5 if b.words < 40 and ("©" in b.text or "all rights reserved" in b.text.lower()) and not n.article else 0
    return s


def ties(bs: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity): to the next block, and to the next block of the same parent."""
    out, last = [], {}
    for i, b in enumerate(bs):
        if i:
            a = bs[i - 1]
            same = a.node is b.node or a.node.parent is b.node.parent
            across = (a.bad > 0) != (b.bad > 0) or a.node.article != b.node.article
            out.append((i - 1, i, int(SCALE * (ACROSS if across else ADJACENT if same else ADJACENT / 2))))
        key = id(b.node.parent)
        if key in last and last[key] != i - 1:
            j = last[key]
            out.append((j, i, int(SCALE * (ACROSS if (bs[j].bad > 0) != (b.bad > 0) else KIN))))
        last[key] = i
    return out


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut.

    Terminal capacities are the scores (content above 0, boilerplate below); ``edges`` are undirected. Dinic's
    algorithm; the content side is everything that doesn't reach the boilerplate terminal in the residual graph.
    """
    n = len(scores)
    if not any(s < 0 for s in scores) or not any(s > 0 for s in scores):
        return [s > 0 or not any(x < 0 for x in scores) and any(x > 0 for x in scores) for s in scores]
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def link(a: int, b: int, forth: int, back: int) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i, v in enumerate(scores):
        if v > 0:
            link(s, i, v, 0)
        elif v < 0:
            link(i, t, -v, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:  # depth first along the levels, without recursion
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(graph[a]):
                e = graph[a][nxt[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(graph[a]):
                path.append(graph[a][nxt[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]
    reach = [False] * (n + 2)  # what still reaches the boilerplate terminal
    reach[t] = True
    queue = deque([t])
    while queue:
        a = queue.popleft()
        for e in graph[a]:
            if cap[e ^ 1] and not reach[to[e]]:
                reach[to[e]] = True
                queue.append(to[e])
    return [not r for r in reach[:n]]


def main_text(page: str) -> tuple[str, int]:
    """The main text (blocks joined by an empty line) and the number of blocks left out."""
    bs = blocks(page)
    keep = minimum_cut([round(SCALE * score(b)) for b in bs], ties(bs))
    return "\n\n".join(b.text for b, k in zip(bs, keep, strict=True) if k), keep.count(False)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text, n_chars, n_dropped): the main text of each whole page and its code points.

    Null and empty pages, and pages that are all boilerplate, give an empty text. Rows are independent (repeated rows
    repeat), a null id stays null, columns beyond ``keep`` are not read, an empty table gives an empty one.
    """
    src = pages.select(pages[id_col].cast("long").alias(id_col), *(pages[c].cast("string").alias(c) for c in keep), pages[html_col].cast("string").alias("_html"))

    def run(batches):
        for batch, raw in texts(batches, "_html"):
            got = [main_text(p.decode()) for p in raw]
            cols = [pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[id_col, *keep, "text", "n_chars", "n_dropped"])

    return src.mapInArrow(run, f"{id_col} long, " + "".join(f"{c} string, " for c in keep) + "text string, n_chars long, n_dropped long")
