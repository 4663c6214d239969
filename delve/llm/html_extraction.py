"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: the text between two block-level tag boundaries, with the
open elements above it. Each block has features of its ancestors' tags, classes and roles and of its
text; the field labels the sequence main or other, trained by conditional likelihood
(forward-backward gradients) on labelled pages and decoded by Viterbi. The labelled pages are composed
here from templates with known main text; the model is a small table of weights, which is broadcast.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, temp_name, text_of

#: Elements that start and end blocks, that have no content, and whose content is not text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea noembed xmp".split())
#: A start tag closes open elements of these names, up to the nearest element that is none of them or inline.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol dl fieldset blockquote figure".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_STEM = re.compile(r"[a-z]+")

Block = tuple[str, tuple[str, ...], int, int]  # text, ancestor marks, link characters, place of its parent


def _marks(name: str, attrs: str) -> tuple[str, ...]:
    words = [name]
    if attrs:
        for m in _ATTR.finditer(attrs):
            spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1] or m[2] or m[3] or "").lower()
            words += [f".{w}" for w in _STEM.findall(spaced)]
        if _HIDDEN.search(attrs):
            words.append(".hidden")
    return tuple(words)


def leaf_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; markup, comments and the content of RAW elements left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    links = 0
    above: tuple[str, ...] | None = None

    def flush() -> None:
        nonlocal links, above
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                out.append((words, above or (), links, len(stack)))
            text.clear()
        links, above = 0, None

    def take(piece: str) -> None:
        nonlocal links, above
        if piece:
            if above is None and not piece.isspace():
                above = tuple(w for _, marks in stack for w in marks)
            text.append(piece)
            if any(n == "a" for n, _ in stack):
                links += len(piece)

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            take(page[at:])
            break
        take(page[at:start])
        m = _TAG.match(page, start)
        if not m:
            take("<")
            at = start + 1
            continue
        at = m.end()
        close = m[1]
        if close:
            close = close.lower()
            if close in BLOCKS:
                flush()
            if close == "br":
                take(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == close:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPES and close not in _SCOPES:
                    break
            continue
        name = m[2] or m[4]
        if not name:
            continue
        name = name.lower()
        attrs = m[3] if m[2] else m[5]
        if name in BLOCKS:
            flush()
            closes = _CLOSES.get(name, frozenset())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in closes:
                    del stack[k:]
                elif stack[k][0] in _SCOPES:
                    break
        elif name == "br":
            take(" ")
        if name in VOID or attrs.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((name, _marks(name, attrs)))
    flush()
    return out


# ---------------------------------------------------------------- features


def _size(n: int) -> int:
    return min(7, n.bit_length())


@functools.lru_cache(maxsize=1 << 14)
def _path_features(above: tuple[str, ...]) -> tuple[str, ...]:
    own = frozenset(above)
    tags = [w for w in above if w[0] != "."]
    return (*(f"in {w}" for w in own), f"parent {tags[-1] if tags else ''}", f"top {next((t for t in tags if t not in ('html', 'body', 'div')), '')}")


def block_features(blocks: list[Block]) -> list[tuple[str, ...]]:
    """Names of the binary features of each block."""
    seen = {w for b in blocks for w in b[1]}
    page = "article" if "article" in seen else "main" if "main" in seen else "none"
    out = []
    for words, above, links, _ in blocks:
        n = words.count(" ") + 1
        dense = links * 3 // max(len(words), 1)
        last = words[-1]
        text = (f"words {_size(n)}", f"links {min(dense, 3)}", f"ends {'stop' if last in '.!?' else 'other'}", f"mark {'c' if words[0] == chr(169) else '-'}")
        place = f"page {page} {'in' if page in above else 'out'}"
        out.append((*_path_features(above), *text, place, "bias"))
    return out


# ---------------------------------------------------------------- the field


class ChainField:
    """Linear-chain conditional random field with two labels (0 other, 1 main)."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}  # of a feature for label 1
        self.moves = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, features: list[tuple[str, ...]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in fs) for fs in features]

    def viterbi(self, features: list[tuple[str, ...]]) -> list[int]:
        """The most likely labels."""
        if not features:
            return []
        scores = self.scores(features)
        (m00, m01), (m10, m11) = self.moves
        a, b = 0.0, scores[0]
        back = []
        for s in scores[1:]:
            from0, from1 = (a + m00 < b + m10), (a + m01 < b + m11)
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01) + s
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def marginals(self, features: list[tuple[str, ...]]) -> tuple[list[float], list[list[float]]]:
        """P(label 1) of each block, and expected moves, by forward-backward."""
        scores, moves = self.scores(features), self.moves
        n = len(scores)
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        fore = [(0.0, scores[0])]
        for s in scores[1:]:
            a, b = fore[-1]
            fore.append((add(a + moves[0][0], b + moves[1][0]), add(a + moves[0][1], b + moves[1][1]) + s))
        hind = [(0.0, 0.0)] * n
        for k in range(n - 2, -1, -1):
            a, b = hind[k + 1]
            b += scores[k + 1]
            hind[k] = (add(moves[0][0] + a, moves[0][1] + b), add(moves[1][0] + a, moves[1][1] + b))
        total = add(*fore[-1])
        ones = [math.exp(f[1] + h[1] - total) for f, h in zip(fore, hind, strict=True)]
        expected = [[0.0, 0.0], [0.0, 0.0]]
        for k in range(n - 1):
            for i in (0, 1):
                for j in (0, 1):
                    expected[i][j] += math.exp(fore[k][i] + moves[i][j] + (scores[k + 1] if j else 0.0) + hind[k + 1][j] - total)
        return ones, expected

    def train(self, pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 8, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> ChainField:
        """Maximise the conditional likelihood by adaptive gradient steps, a page at a time."""
        order = random.Random(seed)
        seen: dict[str, float] = {}
        move_seen = [[1e-8, 1e-8], [1e-8, 1e-8]]
        pages = [p for p in pages if p[0]]
        for _ in range(rounds):
            order.shuffle(pages)
            for features, labels in pages:
                ones, expected = self.marginals(features)
                slope: dict[str, float] = {}
                for fs, p, y in zip(features, ones, labels, strict=True):
                    if abs(y - p) > 1e-4:
                        for f in fs:
                            slope[f] = slope.get(f, 0.0) + y - p
                for f, g in slope.items():
                    g -= decay * self.weights.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-8) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / math.sqrt(seen[f])
                for a, b in zip(labels, labels[1:], strict=False):
                    expected[a][b] -= 1
                for i in (0, 1):
                    for j in (0, 1):
                        g = -expected[i][j]
                        move_seen[i][j] += g * g
                        self.moves[i][j] += rate * g / math.sqrt(move_seen[i][j])
        return self


# ---------------------------------------------------------------- labelled pages

#: Names that pages give to what is not the article.
_OTHER = {
    "nav": "nav navigation navbar menu topnav breadcrumb breadcrumbs pagination pager links toc skip tabs submenu",
    "header": "header masthead banner topbar logo branding siteheader tagline",
    "footer": "footer copyright legal bottom colophon imprint sitefooter",
    "aside": "sidebar aside widget rail related recommended popular trending tags categories archive recent teaser more promo",
    "div": "ad ads advert advertisement adverts sponsor sponsored banner promo promotion notice notices alert cookie cookies consent gdpr warning disclaimer popup modal overlay message newsletter subscribe paywall social share sharing follow login signup author byline hidden",
    "form": "form search subscribe contact login newsletter feedback poll survey",
    "section": "comments comment replies reply discussion disqus responses respond reader readers thread commentlist reviews review feedback",
}
_MAIN = "article content main post entry story text body page maincontent articlebody primary column container wrapper"
#: Everyday words of four languages, to fill composed pages with.
_WORDS = (
    "water morning house garden river market people children window paper summer music street doctor teacher kitchen winter bridge letter island "
    "after before under between slowly often always never small large green old young quick because while where until walked found carried opened wrote "
    "haus garten wasser morgen fenster brücke kinder straße freund arbeit langsam immer zwischen schnell schrieb gefunden "
    "maison jardin matin fenêtre enfants école rivière travail toujours lentement petite écrivait trouvé "
    "casa jardín mañana ventana niños escuela camino trabajo siempre despacio pequeño escribió agua y de la le und der"
).split()
#: What heads of pages hold beside the title.
_HEADS = ('<meta name="viewport" content="width=device-width">', '<link rel="stylesheet" href="/main.css">', "<style>.lead > p { color: #333 } /* a < b */</style>", '<script type="application/ld+json">{"@type":"Article"}</script>', "<script>if (a < b && c) { load('<div>'); }</script>", "<noscript><img src=/pixel.gif></noscript>")


def _sentence(rng: random.Random, words: int) -> str:
    out = [rng.choice(_WORDS) for _ in range(max(1, words))]
    return " ".join(out).capitalize() + rng.choice([".", ".", ".", "!", "?", "", "***", " 12"])


def _other(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """Markup of something that is not the article, and its blocks."""
    tag = rng.choice(list(_OTHER))
    name = rng.choice(_OTHER[tag].split())
    outer = rng.choice([tag, tag, "div", "section" if tag != "section" else "div"])
    attrs = f' class="{name}"' if outer not in ("nav", "header", "footer", "aside", "form") or rng.random() < 0.5 else ""
    if attrs and rng.random() < 0.3:
        attrs = rng.choice([f' id="{name}"', f" class='{name} {rng.choice(['box', 'x1', 'inner', 'wide'])}'", f' class="{name}-{rng.choice(['list', 'area', 'box'])}"'])
    parts, blocks = [], []
    style = rng.choice(["links", "plain", "paragraphs", "heading", "plain"])
    if outer == "nav" or style == "links":
        items = [_sentence(rng, rng.randint(1, 3)).rstrip(".!?") for _ in range(rng.randint(2, 7))]
        parts.append("<ul>" + "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(items)) + "</ul>")
        blocks += items
    elif outer == "form":
        items = [_sentence(rng, 2), _sentence(rng, 1)]
        parts.append(f"<label>{items[0]}</label><input name=q><button>{items[1]}</button>")
        blocks += items
    elif style == "plain":
        blocks.append(_sentence(rng, rng.randint(2, 25)))
        parts.append(blocks[-1])
    else:
        if style == "heading":
            blocks.append(_sentence(rng, 2))
            parts.append(f"<h{rng.randint(2, 4)}>{blocks[-1]}</h3>")
        for _ in range(rng.randint(1, 4)):
            blocks.append(_sentence(rng, rng.randint(3, 50)))
            parts.append(f"<p>{blocks[-1]}</p>")
    return f"<{outer}{attrs}>{''.join(parts)}</{outer}>", [(b, 0) for b in blocks]


def _article(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    parts, blocks = [], []

    def put(open_: str, words: int, close: str = "") -> None:
        blocks.append((_sentence(rng, words), 1))
        parts.append(open_ + blocks[-1][0] + close)

    if rng.random() < 0.9:
        put("<h1>", rng.randint(2, 10), "</h1>")
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.5:
            put(rng.choice(["<p>", "<p>", "<p><b>", '<p class="lead">']), rng.choice([1, 2, 4, 20, 60, 120]), rng.choice(["</p>", "</p>", "<br>"]))
        elif kind < 0.58:
            put("<h2>", rng.randint(1, 6), "</h2>")
        elif kind < 0.65:
            parts.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                put("<li>", rng.randint(1, 15), "</li>")
            parts.append("</ul>")
        elif kind < 0.7:
            put("<blockquote>", rng.randint(5, 40), "</blockquote>")
        elif kind < 0.74:
            put("<pre>", rng.randint(3, 30), "</pre>")
        elif kind < 0.78:
            parts.append("<table><tr>")
            for _ in range(rng.randint(2, 6)):
                put("<td>", rng.randint(1, 4), "</td>")
            parts.append("</tr></table>")
        else:
            markup, more = _other(rng)
            parts.append(markup)
            blocks.extend(more)
    return "".join(parts), blocks


def labelled_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A page and the label of each of its blocks, 1 for main text."""
    title = _sentence(rng, 4)
    blocks: list[tuple[str, int]] = [(title, 0)]
    extra = [x for x in _HEADS if rng.random() < 0.3]
    cut = rng.randint(0, len(extra))
    parts = ["<!DOCTYPE html><html><head>", *extra[:cut], "<title>", title, "</title>", *extra[cut:], "</head><body>"]

    def others(low: int, high: int) -> None:
        for _ in range(rng.randint(low, high)):
            markup, more = _other(rng)
            parts.append(markup)
            blocks.extend(more)

    others(0, 4)
    markup, inner = _article(rng)
    name = rng.choice(_MAIN.split())
    open_, close = rng.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<div class="{name}"><article>', "</article></div>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>")])
    parts += [open_, markup, close]
    blocks.extend(inner)
    others(0, 4)
    parts.append(rng.choice(["</body></html>", "", "</body>"]))
    return "".join(parts), [(" ".join(html.unescape(b).split()), y) for b, y in blocks]


def labelled_pages(count: int, seed: int) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """(features, labels) of composed pages; pages whose blocks don't parse as composed are left out."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        page, truth = labelled_page(rng)
        blocks = leaf_blocks(page)
        if [b[0] for b in blocks] == [t for t, _ in truth if t]:
            out.append((block_features(blocks), [y for t, y in truth if t]))
    return out


@functools.lru_cache(maxsize=4)
def trained_field(pages: int = 3_000, seed: int = 11) -> ChainField:
    """The field trained on ``pages`` labelled pages; the same weights for the same arguments."""
    return ChainField().train(labelled_pages(pages, seed))


def main_text(page: str | None, field: ChainField) -> str:
    """The main blocks of a page, joined by line feeds."""
    blocks = leaf_blocks(page or "")
    return "\n".join(b[0] for b, y in zip(blocks, field.viterbi(block_features(blocks)), strict=True) if y)


def extract_main_text(pages: DataFrame, html_col: str = "html", field: ChainField | None = None, name: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` in the new column ``name``.

    - Null and empty pages, and pages without main text, have an empty text.
    - Character references are decoded, white space inside a block is one space, blocks are joined by one
      line feed; nothing else is dropped or cut, however long the page.
    - Unclosed and stray tags are accepted. Columns of ``pages`` stay; one called ``name``, in any case, is replaced.
    """
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or trained_field())  # some hundred weights

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, shared.value) for p in pages], dtype=object)

    new = temp_name(pages, f"{name}_new")
    made = pages.withColumn(new, extract(text_of(pages[html_col])))
    return made.select(*(made[c] for c in pages.columns if c.lower() != name.lower()), made[new].alias(name))
