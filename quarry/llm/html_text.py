"""Main-text extraction from HTML: flat text blocks and a decision tree.

A page is cut into flat text blocks at block-level tags. A block's features
are its word count and link density, those of the blocks before and after
it, and three flags of where it stands: inside <article> or <main>; inside
chrome (navigation, page header or footer, sidebar, form, advert, notice,
reader comments), which tag names, roles and class or id names tell; and, inside
<article> or <main>, in a container whose name only resembles chrome: there its
length and links decide (an article may have a section "social-history").
A decision tree trained on the small labelled table ``LABELLED`` says which blocks are
main text.

A name tells chrome if all its words do, words like "list" or "box" aside
("comments", "cookie-notice", "newsletter-box"); a name that describes a state does
not ("comments-open", "with-sidebar"). A container that holds most of the page's words
outside links is no chrome unless its name is plain chrome; not even then if it
holds nearly all.

Scripts, styles, comments and other elements without running text are
skipped whole. Character references are decoded, white space inside a block
becomes one space, blocks are joined in page order by a line feed. Each page
is handled by itself in one task, whole: there is no shuffle.

Defined results: null or empty html gives empty text; markup cut off at the
end of a page is dropped; a page without main text gives empty text; equal
rows each give a row; null ids and urls stay null.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_chrome",
            "named")

#: The labelled table: word counts, link densities (per cent) of a block, the one
#: before and the one after, whether it stands in <article>/<main>, whether in
#: chrome, whether (instead) in a named container of <article>/<main>, and whether a
#: reader takes it for main text (1) or not (0).
LABELLED = """
words links words_before links_before words_after links_after in_main in_chrome named content
1   100  0    0    1   100  0  1 0  0
2   100  1    100  1   100  0  1 0  0
1   100  2    100  9   0    0  1 0  0
3   67   1    100  4   100  0  1 0  0
4   100  3    100  12  0    0  0 0  0
2   100  2    100  2   100  0  0 0  0
1   100  1    100  1   100  0  0 0  0
5   80   2    100  3   100  0  0 0  0
9   0    1    100  8   0    0  1 0  0
12  0    2    100  10  0    0  1 0  0
25  0    1    100  60  0    0  1 0  0
60  5    25   0    80  0    0  1 0  0
120 0    90   0    70  2    0  1 0  0
8   0    14   0    40  0    1  0 0  1
1   0    30   0    45  0    1  0 0  1
2   0    1    0    2   0    1  0 0  1
3   0    9    0    60  0    1  0 0  1
14  0    3    0    1   0    1  0 0  1
40  0    8    0    75  0    1  0 0  1
75  3    40   0    33  0    1  0 0  1
33  12   75   3    90  0    1  0 0  1
90  0    33   0    12  0    1  0 0  1
210 1    64   0    120 4    1  0 0  1
640 0    90   0    14  0    1  0 0  1
10  100  60   0    55  0    1  0 0  1
6   50   80   0    40  0    1  0 0  1
2   100  70   0    66  0    1  0 0  1
20  0    120  0    10  0    1  1 0  0
15  30   90   0    5   60   1  1 0  0
4   0    60   0    18  0    1  1 0  0
70  0    20   0    35  0    1  1 0  0
1   0    45   0    2   100  1  1 0  0
11  0    95   0    0   0    0  1 0  0
18  20   130  0    0   0    0  1 0  0
7   0    60   0    3   100  0  1 0  0
3   0    2    100  4   100  0  0 0  0
5   0    3    100  2   100  0  0 0  0
6   40   5    100  8   100  0  0 0  0
12  60   40   0    9   80   0  0 0  0
4   0    0    0    3   100  0  0 0  0
30  0    6    0    45  0    0  0 0  1
45  0    30   0    80  0    0  0 0  1
80  4    45   0    28  0    0  0 0  1
28  10   80   0    50  0    0  0 0  1
150 2    60   0    95  1    0  0 0  1
16  0    70   0    64  0    0  0 0  1
9   0    85   0    40  0    0  0 0  1
55  0    4    100  62  0    0  0 0  1
35  0    3    0    0   0    0  0 0  1
26  70   50   0    5   100  0  0 0  0
40  90   3    100  3   100  0  0 0  0
5   0    0    0    20  0    1  0 0  1
3   0    6    100  2   0    1  0 0  1
2   0    4    100  1   0    1  0 0  1
1   0    2    0    1   0    1  0 0  1
1   0    1    100  0   0    1  0 0  1
50  0    4    100  3   100  1  0 0  1
22  0    18   0    1   100  1  0 0  1
13  0    70   0    2   100  1  0 0  1
4   0    28   0    6   80   1  0 0  1
2   0    11   0    9   0    1  0 0  1
85  0    10   0    7   0    1  0 0  1
17  0    10   0    12  50   1  0 0  1
3   0    150  0    10  0    1  0 0  1
9   11   9    0    4   100  1  0 0  1
24  4    1    100  1   100  1  0 0  1
6   0    2    100  90  0    1  0 0  1
1   100  35   0    42  0    1  0 0  1
3   100  12   0    6   0    1  0 0  1
4   75   20   0    9   0    1  0 0  1
7   0    0    0    0   0    1  0 0  1
1   0    0    0    0   0    1  0 0  1
300 0    0    0    0   0    1  0 0  1
30  0    50   0    40  0    1  1 0  0
45  0    38   0    70  0    1  1 0  0
12  0    45   0    60  0    1  1 0  0
3   33   20   0    30  0    1  1 0  0
65  0    100  0    110 0    1  1 0  0
8   0    8    0    25  0    1  1 0  0
2   0    2    0    3   0    0  1 0  0
16  0    12   0    9   0    0  1 0  0
90  0    50   0    44  0    0  1 0  0
140 2    30   0    60  0    0  1 0  0
35  0    0    0    15  0    0  1 0  0
7   0    30   0    0   0    0  1 0  0
10  0    80   0    0   0    0  1 0  0
21  0    40   0    2   0    0  1 0  0
5   0    90   0    0   0    0  1 0  0
6   0    4    0    3   0    0  0 0  0
2   0    6    0    5   0    0  0 0  0
5   0    1    100  2   0    0  0 0  0
3   0    7    0    0   0    0  0 0  0
8   0    0    0    0   0    0  0 0  0
8   100  6    100  45  0    0  0 0  0
3   100  2    100  30  0    0  0 0  0
14  93   5    80   66  0    0  0 0  0
45  0   2     0    60  0    0  0  1  1
80  1   45    0    70  0    0  0  1  1
120 3   8     0    0   0    0  0  1  1
36  0   90    0    3   0    0  0  1  1
64  5   30    0    20  0    0  0  1  1
200 2   1     0    95  0    0  0  1  1
28  0   50    0    44  0    0  0  1  1
24  0   2     0    33  0    0  0  1  1
2   0   70    0    45  0    0  0  1  1
3   0   40    0    90  0    0  0  1  1
1   0   33    0    64  0    0  0  1  1
9   0   12    0    5   0    0  0  1  0
1   0   25    0    0   0    0  0  1  0
12  0   1     0    8   0    0  0  1  0
4   0   60    0    9   0    0  0  1  0
15  0   45    0    0   0    0  0  1  0
7   0   80    0    3   100  0  0  1  0
10  0   2     0    12  0    0  0  1  0
1   100 80    0    1   100  0  0  1  0
3   100 1     100  60  0    0  0  1  0
30  90  40    0    26  80   0  0  1  0
45  75  3     0    50  0    0  0  1  0
6   50  30    0    70  0    0  0  1  0
22  60  5     0    90  0    0  0  1  0
6   33  9     0    4   0    1  0  0  1
8   25  4     0    6   0    1  0  0  1
5   40  2     0    0   0    1  0  0  1
12  30  8     0    10  0    1  0  0  1
9   44  5     0    3   0    1  0  0  1
7   100 6     0    8   0    1  0  0  1
4   100 3     0    9   0    1  0  0  1
15  45  10    0    2   0    1  0  0  1
18  0   2     0    0   0    0  0  1  1
19  0   30    0    25  0    0  0  1  1
17  0   3     0    40  0    0  0  1  1
16  0   60    0    50  0    0  0  1  1
20  0   22    0    24  0    0  0  1  1
21  0   1     0    22  0    0  0  1  1
2   100 2     100  2   100  1  0  0  0
1   100 3     100  1   100  1  0  0  0
4   100 2     100  5   100  1  0  0  0
3   100 60    0    2   100  1  0  0  0
2   100 25    0    3   100  1  0  0  0
5   100 9     0    4   100  1  0  0  0
2   100 3     100  40  0    1  0  0  0
3   100 1     100  0   0    1  0  0  0
6   100 4     100  0   0    1  0  0  0
9   100 6     90   7   100  1  0  0  0
2   0   80    0    0   0    0  0  0  1
3   0   45    0    0   0    0  0  0  1
1   0   120   0    0   0    0  0  0  1
4   0   66    0    0   0    0  0  0  1
2   0   38    0    3   100  0  0  0  1
5   0   90    0    2   100  0  0  0  1
3   0   70    0    55  0    0  0  0  1
1   0   52    0    33  0    0  0  0  1
4   0   30    0    28  0    0  0  0  1
6   0   48    0    75  0    0  0  0  1
"""

#: Tags that hold no running text: skipped to their end tag.
SKIPPED = "script|style|title|noscript|template|svg|math|iframe|object|canvas|textarea|select|button|audio|video"

#: Fixed HTML block-level tags: a text block ends where one begins or ends.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split())

CONTAINERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header li main "
                       "menu nav ol section table td th tr ul".split())
CHROME_TAGS = frozenset("aside dialog footer form menu nav".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
                         "search toolbar".split())
#: Words that make a name chrome anywhere, and words that do so only outside <article> and <main>.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav "
    "navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup login comment comments replies disqus pagination pager "
    "toolbar related recommended".split())
VAGUE_WORDS = frozenset("side menu banner share sharing social search reply respond widget widgets copyright legal skip".split())
READER_WORDS = frozenset("comment comments replies disqus".split())
#: Words of a name that say nothing, and words that make it a state of the page.
FILLERS = frozenset(
    "list section area box container wrapper wrap block bar form panel item items link links content body title inner outer "
    "main site page post posts article entry top bottom left right global primary secondary user reader module group "
    "holder row col column region zone slot unit thread feed".split())
STATES = frozenset("with without has no is open closed enabled disabled on off show hide hidden active".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({SKIPPED})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)", re.IGNORECASE | re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PARTS = re.compile(r"[a-z0-9]+").findall


NOTHING, NAMED, CHROME, PLAIN, READERS, FIXED = range(6)


def name_kind(name: str, in_main: bool) -> int:
    """What one class or id name says of a container: NOTHING; NAMED: it resembles chrome; CHROME;
    PLAIN: each of its words says so; READERS: the same, of reader comments."""
    parts = _PARTS(name)
    if not STATES.isdisjoint(parts):
        return NOTHING
    said = {p for p in parts if p not in FILLERS and not p.isdigit()}
    if said and said <= CHROME_WORDS | VAGUE_WORDS and not said <= VAGUE_WORDS:
        return READERS if said <= READER_WORDS else PLAIN
    if not said.isdisjoint(CHROME_WORDS | VAGUE_WORDS) or "header" in said and not in_main:
        return NAMED if in_main else CHROME
    return NOTHING


def container_kind(tag: str, attributes: str, in_main: bool) -> int:
    """What a container's tag, role, class and id say of it; FIXED: chrome whatever it holds."""
    kind = FIXED if tag in ("aside", "footer", "menu", "nav") else CHROME if tag in CHROME_TAGS or tag == "header" and not in_main \
        else NOTHING
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "role" and value in CHROME_ROLES:
            return FIXED
        if name in ("class", "id"):
            kind = max([kind, *(name_kind(v, in_main) for v in value.split())])
    return NOTHING if tag in ("article", "main") and kind < PLAIN else kind


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_main: bool
    in_chrome: bool = False
    named: bool = False


def _parse(page: str) -> tuple[list, dict[int, list[int]]]:
    """What happens in page order: blocks, openings (number, kind) and closings (number) of the
    containers that may be chrome; and by number the words outside links before and in a container."""
    events: list = []
    pieces: list[str] = []
    stack: list[tuple[str, int | None, bool]] = []       # open container: tag, number, main
    waiting: dict[str, int] = {}                         # open containers of each tag
    held: dict[int, list[int]] = {}
    link, linked, mains, free = False, 0, 0, 0

    def flush() -> None:
        nonlocal linked, free
        if pieces:
            words = "".join(pieces).split()
            if words:
                events.append(Block(" ".join(words), len(words), min(linked, len(words)), mains > 0))
                free += len(words) - min(linked, len(words))
            pieces.clear()
        linked = 0

    def close() -> str:
        nonlocal mains
        tag, number, main = stack.pop()
        waiting[tag] -= 1
        mains -= main
        if number is not None:
            held[number][1] = free - held[number][0]
            events.append(number)
        return tag

    for skipped, end1, tag1, attrs1, end2, tag2, attrs2, text in _TOKEN.findall(page):
        if text:
            text = html.unescape(text)
            pieces.append(text)
            if link:
                linked += len(text.split())
            continue
        tag = (tag1 or tag2).lower()
        if not tag:
            if skipped:
                pieces.append(" ")
            continue
        closing = bool(end1 or end2)
        if tag == "a":
            link = not closing
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            link = False
            if tag in CONTAINERS:
                if not closing:
                    kind = container_kind(tag, attrs1 or attrs2, mains > 0)
                    main = tag in ("article", "main") and kind < PLAIN
                    number = None
                    if kind:
                        number = len(held)
                        held[number] = [free, 0]
                        events.append((number, kind))
                    stack.append((tag, number, main))
                    waiting[tag] = waiting.get(tag, 0) + 1
                    mains += main
                elif waiting.get(tag):
                    while close() != tag:
                        pass
    flush()
    while stack:
        close()
    held[-1] = [0, free]
    return events, held


#: Shares of the page's words outside links from which a container is no chrome, by what its
#: name says, and the words that it must hold.
MOST = {NAMED: (0.5, 0), CHROME: (0.5, 0), PLAIN: (0.95, 50), READERS: (1.01, 0), FIXED: (1.01, 0)}


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; blocks without text are left out."""
    events, held = _parse(page)
    total, out, kinds, open_ = held[-1][1], [], {}, [0, 0]
    for e in events:
        if isinstance(e, Block):
            e.in_chrome, e.named = open_[1] > 0, open_[0] > 0
            out.append(e)
        elif isinstance(e, tuple):
            number, kind = e
            share, least = MOST[kind]
            if kind != NAMED and held[number][1] > share * total and held[number][1] >= least:
                kind = NOTHING
            kinds[number] = kind
            if kind:
                open_[kind > NAMED] += 1
        elif kinds[e]:
            open_[kinds[e] > NAMED] -= 1
    return out


def feature_matrix(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of one page."""
    words = np.array([b.words for b in found], dtype=float)
    links = np.array([100 * b.linked / b.words for b in found])
    before, after = slice(None, -1), slice(1, None)
    out = np.zeros((len(found), len(FEATURES)))
    out[:, 0], out[:, 1] = words, links
    out[after, 2], out[after, 3] = words[before], links[before]
    out[before, 4], out[before, 5] = words[after], links[after]
    out[:, 6], out[:, 7] = [b.in_main and not b.named for b in found], [b.in_chrome for b in found]
    out[:, 8] = named = np.array([b.named for b in found], dtype=bool)
    edge = np.flatnonzero(named[before] != named[after])       # what stands outside a named container says nothing of it
    out[edge[named[edge]], 4:6] = 0
    out[edge[~named[edge]] + 1, 2:4] = 0
    return out


def labelled_table(text: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([[float(x) for x in line.split()] for line in text.strip().splitlines()[1:]])
    return rows[:, :-1], rows[:, -1]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A decision tree by Gini impurity: a share of content, or (feature, threshold, low, high)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        xs, ys = x[order, f], y[order]
        left = np.arange(1, len(ys))
        ones = np.cumsum(ys)[:-1]
        p, q = ones / left, (ys.sum() - ones) / (len(ys) - left)
        impurity = left * p * (1 - p) + (len(ys) - left) * q * (1 - q)
        impurity[(xs[1:] == xs[:-1]) | (left < least) | (len(ys) - left < least)] = np.inf
        at = int(np.argmin(impurity))
        if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0] - 1e-12):
            best = (impurity[at], f, (xs[at] + xs[at + 1]) / 2)
    if best is None:
        return share
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def train(text: str = LABELLED):
    return grow(*labelled_table(text))


def predict(tree, x: np.ndarray) -> np.ndarray:
    """Share of content of the leaf that each row falls into."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    at = x[:, f] <= cut
    out = np.empty(len(x))
    out[at], out[~at] = predict(low, x[at]), predict(high, x[~at])
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    content = predict(tree, feature_matrix(found)) >= 0.5
    return "\n".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def extract(pages: DataFrame, tree=None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page; other columns are dropped."""
    tree = train() if tree is None else tree

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(p, tree) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 ["page_id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kind}, url string, text string")
