"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

``leaf_blocks`` cuts a page into leaf blocks: runs of text with the same innermost block-level element, each with
the tags, classes and ids of its ancestors. Scripts, styles, markup and form controls never give text. Unclosed
tags, stray end tags and pages that stop anywhere are read as browsers do in spirit: an end tag closes the nearest
element of its name, a new paragraph or list item closes an open one, inline tags only separate nothing.

The field has two labels (main text or not), features of each block (ancestor tags, words of ancestor classes and
ids, tag path end, size, share of text in links, punctuation, place in the page) with one weight a label, and four
transitions. It is trained here, by maximising the penalised conditional likelihood on ``TRAINING_PAGES`` labelled
pages that ``labelled_pages`` writes from a fixed seed in several layouts; the bound is that parameter. Pages are
decoded by Viterbi inside one narrow pass: no shuffle, no join, and the weights (some hundred numbers) travel with
the task.

The text of a page is its main blocks in page order, joined by one line feed. In a block character references are
decoded, white space (also the no-break space and other Unicode spaces) becomes one space, and ends are trimmed;
blocks left empty are no blocks. ``<br>`` counts as white space. A null or empty page, or one without main blocks, gives
an empty text. Names (classes, ids, roles) count as features for the innermost ``NAMED`` ancestors that have any; a tag
whose quotes never close ends at its first ``>``. Time is linear in the page, whatever its markup. Repeated rows are extracted alike. An empty table gives an empty result. Columns other than page_id,
url and html are ignored.
"""

from __future__ import annotations

import functools
import html as html_module
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TRAINING_PAGES = 360
#: Shares of written pages whose main text has containers without names, and of pages with nothing but it.
UNNAMED = 0.25
LONE = 0.06
STEPS = 160
PENALTY = 0.05
#: Ancestor contexts whose scores a task remembers.
KNOWN = 1 << 14
_TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
#: Innermost elements with names whose names are features of a block.
NAMED = 64
#: name[=value], one after another, so that nothing is looked for within values; a value without its end quote goes to the end.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>][^\s>]*)))?")
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is never text.
SILENT = frozenset("script style noscript template head title textarea select option iframe object canvas audio video map datalist".split())
#: Silent elements whose content isn't markup: only their own end tag closes them.
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind closes an open element of the second kind, up to a barrier.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIERS = frozenset("ul ol menu dl table".split())


@dataclass
class Block:
    """A leaf block: its text, the tags and name words of its ancestors, the innermost name words, and how much of it is in links.

    ``tags`` are the block-level ancestors' tags, ``last`` the two innermost of them in order.
    """

    text: str
    tags: frozenset[str]
    last: tuple[str, ...]
    names: frozenset[str]
    nearest: tuple[str, ...] = ()
    linked: int = 0


@dataclass
class _Open:
    tag: str
    block: bool
    tags: frozenset[str]
    last: tuple[str, ...]
    named: bool = False
    silent: bool = False


@dataclass
class _Reader:
    """Open elements as a stack, with the places of each tag and of block-level elements in it: nothing walks the stack."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    block_places: list[int] = field(default_factory=list)
    named: list[tuple[str, ...]] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)

    silent: int = 0
    links: int = 0

    def text(self, raw: str) -> None:
        if raw and not self.silent:
            self.pieces.append(raw)
            if self.links:
                self.linked.append(raw)

    def nearest(self, tags: frozenset[str] | set[str]) -> int:
        """The place of the innermost open element of one of these tags, or -1."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def drop(self, k: int) -> None:
        """Close the open elements from number ``k``."""
        while len(self.stack) > k:
            x = self.stack.pop()
            self.places[x.tag].pop()
            if x.block:
                self.block_places.pop()
            if x.named:
                self.named.pop()
            self.silent -= x.silent
            self.links -= x.tag == "a"

    def flush(self) -> None:
        if self.pieces:
            text = clean("".join(self.pieces))
            if text:
                names = frozenset(n for own in self.named[-NAMED:] for n in own)
                tags, last = (self.stack[-1].tags, self.stack[-1].last) if self.stack else (frozenset(), ())
                self.blocks.append(Block(text, tags, last, names, self.named[-1] if self.named else (), len(clean("".join(self.linked))) if self.linked else 0))
        self.pieces, self.linked = [], []

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.pieces.append(" ")
            if tag == "hr":
                self.flush()
            return
        block = tag in BLOCKS
        if block:
            self.flush()
            if tag != "body":
                self.close_until({"p"}, _BARRIERS | {"td", "th", "div", "article", "section", "li", "blockquote"})
            if tag in _CLOSES:
                self.close_until(_CLOSES[tag], _BARRIERS)
        names, hidden = names_of(attributes) if attributes.strip() else ((), False)
        silent = tag in SILENT or hidden
        tags, last = (self.stack[-1].tags, self.stack[-1].last) if self.stack else (frozenset(), ())
        if block:
            tags, last = tags if tag in tags else tags | {tag}, (*last[-1:], tag)
            self.block_places.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        if names:
            self.named.append(names)
        self.stack.append(_Open(tag, block, tags, last, bool(names), silent))
        self.silent += silent
        self.links += tag == "a"

    def close_until(self, tags: set[str], barriers: frozenset[str] | set[str]) -> None:
        k = self.nearest(tags)
        if k >= 0 and k > self.nearest(barriers - tags):
            self.flush()
            self.drop(k)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        k, block = self.nearest({tag}), self.block_places[-1] if self.block_places else -1
        if k >= 0 and (k >= block or tag in BLOCKS or tag in SILENT):  # an inline end tag doesn't reach out of its block
            if block >= k:
                self.flush()
            self.drop(k)
        elif tag in BLOCKS:
            self.flush()


def clean(raw: str) -> str:
    """Character references decoded, white space as one space, trimmed."""
    return " ".join((html_module.unescape(raw) if "&" in raw else raw).split())


def names_of(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Lower-case words of class, id and role, and whether the element is hidden."""
    words: list[str] = []
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif key in ("class", "id", "role"):
            spread = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
            words += _WORD.findall(spread)
    return tuple(words), hidden


class _TagEnds:
    """Where tags end, in time linear in the page: no place outside quotes is looked at twice without an end."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.failed: set[int] = set()

    def find(self, at: int) -> int:
        """The > of the tag whose attributes start at ``at``; within quotes only if they stay open; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        passed, place = [], at
        while place not in self.failed:
            passed.append(place)
            m = _STOP.search(self.page, place)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            if m.start() >= self.last[m[0]]:
                break
            place = self.page.find(m[0], m.end()) + 1
        self.failed.update(passed)
        return self.page.find(">", at)


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order."""
    if not page:
        return []
    reader, ends = _Reader(), _TagEnds(page)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        close = -1 if m is None or m[2] is None else ends.find(m.end())
        if m is None or (m[2] is not None and close < 0):
            rest = page[at:]
            while (m := _TOKEN.search(page, at)) and m[2] is not None:  # tags that the page's end cuts short
                at = m.end()
            if m is not None:
                rest = page[n - len(rest) : m.start()]
            cut = rest.rfind("<")
            # a tag that the end of the page cuts short is markup
            reader.text(rest[:cut] if cut >= 0 and re.match(r"<[a-zA-Z/!?]", rest[cut:] + " ") and ">" not in rest[cut:] else rest)
            break
        reader.text(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
        elif m[0] in ("<!", "<?"):
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
        else:
            at = close + 1
            tag = m[2].lower()
            if m[1]:
                reader.end(tag)
            else:
                reader.start(tag, page[m.end() : close])
                if tag in RAW:
                    raw_end = _raw_end(tag).search(page, at)
                    at = n if raw_end is None else raw_end.start()
    reader.flush()
    return reader.blocks


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/>]", re.I)


def _step(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value >= b for b in bounds)


def context_features(tags: frozenset[str], last: tuple[str, ...], names: frozenset[str], nearest: tuple[str, ...]) -> list[str]:
    """Names of the features of a block's ancestors."""
    found = {f"in:{t}" for t in tags} | {f"named:{w}" for w in names} | {f"nearest:{w}" for w in nearest}
    return sorted(found | {"own:" + (last[-1] if last else "none"), "end:" + "/".join(last)})


def text_features(block: Block, place: int, n: int) -> tuple[str, ...]:
    """Names of the features of a block's text and of its place among ``n`` blocks."""
    text = block.text
    words = text.count(" ") + 1
    marks = sum(map(text.count, ".,;:!?"))
    return (
        f"words:{_step(words, (2, 4, 8, 16, 32, 64))}",
        f"linked:{_step(block.linked / len(text), (0.05, 0.35, 0.75)) if block.linked else 0}",
        f"marks:{_step(marks / words, (0.01, 0.06, 0.12, 0.3))}",
        f"stop:{text[-1] in '.!?…:;'}",
        f"copyright:{'©' in text}",
        f"place:{_step(place / n, (0.1, 0.3, 0.7, 0.9))}",
        "first" if place == 0 else "last" if place == n - 1 else "inner",
    )


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of every block."""
    return [[*context_features(b.tags, b.last, b.names, b.nearest), *text_features(b, i, len(blocks))] for i, b in enumerate(blocks)]


@dataclass
class Field:
    """Weights of a trained field: for every feature how far it speaks for main text, and transitions."""

    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    known: dict = field(default_factory=dict)

    def score(self, block: Block, place: int, n: int) -> float:
        context = (block.tags, block.last, block.names, block.nearest)
        value = self.known.get(context)
        if value is None:
            value = self.bias + sum(self.weights.get(x, 0.0) for x in context_features(*context))
            if len(self.known) < KNOWN:
                self.known[context] = value
        get = self.weights.get
        return value + sum([get(x, 0.0) for x in text_features(block, place, n)])

    def labels(self, blocks: list[Block]) -> list[bool]:
        """The best labelling of a page's blocks (Viterbi); ties go to the other text."""
        if not blocks:
            return []
        scores = [self.score(b, i, len(blocks)) for i, b in enumerate(blocks)]
        stay0, go1, go0, stay1 = map(float, self.transitions.ravel())
        best0, best1 = 0.0, scores[0]
        back: list[tuple[bool, bool]] = []
        for s in scores[1:]:
            from0, from1 = best0 + stay0, best1 + go0
            up0, up1 = best0 + go1, best1 + stay1
            back.append((from1 > from0, up1 > up0))
            best0, best1 = max(from0, from1), s + max(up0, up1)
        now = best1 > best0
        out = [now]
        for zero, one in reversed(back):
            now = one if now else zero
            out.append(now)
        return out[::-1]

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, main in zip(blocks, self.labels(blocks), strict=True) if main)


def log_likelihood(scores: np.ndarray, labels: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Conditional log-likelihood of padded pages, and its gradients by scores and transitions.

    ``scores`` (pages, places) are those of label 1, label 0 scores nothing.
    """
    pages, longest = scores.shape
    emit = np.stack((np.zeros_like(scores), scores), axis=2)
    real = np.arange(longest)[None, :] < sizes[:, None]
    forward = np.zeros((pages, longest, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + transitions[None], axis=1) + emit[:, t]
        forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    backward = np.zeros((pages, longest, 2))
    for t in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(transitions[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(real[:, t + 1, None], step, backward[:, t + 1])
    one = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * real
    pair = forward[:, :-1, :, None] + transitions[None, None] + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
    both = real[:, 1:]
    expected = (np.exp(pair) * both[:, :, None, None]).sum(axis=(0, 1))
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    value = float((scores * labels * real).sum() + (transitions * seen).sum() - total.sum())
    return value, labels * real - one, seen - expected


def train(pages: list[list[tuple[Block, bool]]], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """A field fitted to labelled pages by adaptive gradient steps on the penalised likelihood."""
    pages = [p for p in pages if p]
    named = [features_of([b for b, _ in p]) for p in pages]
    numbers = {x: k for k, x in enumerate(sorted({x for p in named for found in p for x in found}))}
    longest = max(len(p) for p in pages)
    sizes = np.array([len(p) for p in pages])
    labels = np.zeros((len(pages), longest), dtype=np.int64)
    cells, columns = [], []
    for i, (p, found) in enumerate(zip(pages, named, strict=True)):
        for j, ((_, main), names) in enumerate(zip(p, found, strict=True)):
            labels[i, j] = main
            cells += [i * longest + j] * len(names)
            columns += [numbers[x] for x in names]
    cells, columns = np.array(cells), np.array(columns)
    theta = np.zeros(len(numbers) + 5)
    m = len(numbers)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        scores = np.bincount(cells, weights=theta[columns], minlength=labels.size).reshape(labels.shape) + theta[m]
        _, by_score, by_transition = log_likelihood(scores, labels, sizes, theta[m + 1 :].reshape(2, 2))
        gradient = np.concatenate((np.bincount(columns, weights=by_score.ravel()[cells], minlength=m), [by_score.sum()], by_transition.ravel())) - penalty * theta
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field({x: float(theta[k]) for x, k in numbers.items()}, float(theta[m]), theta[m + 1 :].reshape(2, 2))


class _Writer:
    """Writes labelled pages: main text is wrapped in marks that ``labelled_pages`` reads back from the blocks."""

    MARK = "⁣"

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        letters = "etaoinshrdlucmfwygpbvk" + "äöüéèñ" * rng.randrange(2)
        self.words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(120)]

    def sentence(self, least: int, most: int) -> str:
        words = [self.rng.choice(self.words) for _ in range(self.rng.randint(least, most))]
        if self.rng.random() < 0.1:
            words = [w + self.rng.choice(("", "&amp;&amp;", "%%", " |")) for w in words]
        return " ".join(words).capitalize() + self.rng.choice(("...", ".", ".", "!", "?", "", "&hellip;"))

    def prose(self) -> str:
        return " ".join(self.sentence(2, 22) for _ in range(self.rng.choice((1, 1, 2, 3, 5, 9))))

    def tagged(self, tag: str, body: str, *names: str) -> str:
        attribute = ""
        if names:
            attribute = f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(names)}"'
        return f"<{tag}{attribute}>{body}</{tag}>"

    def links(self, tag: str, n: int) -> str:
        items = "".join(f'<li><a href="/{self.rng.choice(self.words)}">{self.sentence(1, 3)}</a></li>' for _ in range(n))
        return self.tagged(tag, items)

    def main(self) -> str:
        rng, out = self.rng, []
        mark = self.MARK
        if rng.random() < 0.85:
            heading = f"<h1>{mark}{self.sentence(1, 12)}</h1>"
            out.append(f"<header>{heading}</header>" if rng.random() < 0.1 else heading)
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = rng.random()
            if kind < 0.52:
                out.append(f"<p>{mark}{self.prose()}</p>")
            elif kind < 0.55:
                out.append(f"<p>{mark}{self.prose()} {self.inline()} {self.sentence(2, 9)}</p>")
            elif kind < 0.7:
                out.append(f"<p><b>{mark}{self.prose()}<br>")
            elif kind < 0.76:
                out.append(f"<h2>{mark}{self.sentence(1, 7)}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{mark}{self.sentence(2, 14)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{mark}{self.prose()}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<pre>{mark}{self.sentence(2, 20)}</pre>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{mark}{self.sentence(1, 3)}</td><td>{mark}{self.sentence(1, 3)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif kind < 0.98:
                out.append(f'<p>{mark}{self.prose()} <a href="/{rng.choice(self.words)}">{self.sentence(1, 4)}</a> {self.prose()}</p>')
            else:
                out.append(f"<figure><img src='x.png'><figcaption>{mark}{self.sentence(2, 9)}</figcaption></figure>")
            if rng.random() < 0.06:
                out.append(self.advert())
        if rng.random() < 0.05:
            return "".join(out)
        if rng.random() < UNNAMED:
            return self.unnamed(out)
        outer = rng.random()
        if outer < 0.6:
            return self.tagged("article", "".join(out), *(("post", "entry", "story") if rng.random() < 0.3 else ()))
        if outer < 0.8:
            return self.tagged("main", "".join(out), *(("content", "main") if rng.random() < 0.5 else ()))
        return self.tagged("div", "".join(out), "content", "post-content", "entry-content", "article-body", "main-content", "story-body", "post", "text")

    def unnamed(self, out: list[str]) -> str:
        """Main text whose containers tell nothing: divs, sections and layout tables without names, text between tags, or text only."""
        mark, kind = self.MARK, self.rng.random()
        bare = [x.replace("<p>", "<div>").replace("</p>", "</div>") for x in out]
        if kind < 0.3:
            return "<div>" + "".join(bare) + "</div>"
        if kind < 0.5:
            return "".join(f"<div><div>{x}</div></div>" for x in out)
        if kind < 0.58:
            return "".join(f"<section>{x}</section>" for x in out)
        if kind < 0.68:
            return "<table><tr><td>" + "".join(out) + "</td></tr></table>"
        if kind < 0.85:
            return "<div>" + "<br><br>".join(f"{mark}{self.prose()}" for _ in range(self.rng.randint(1, 6))) + "</div>"
        return "".join(f"<div>{mark}{self.prose()}</div>" for _ in range(self.rng.randint(1, 8)))

    def inline(self) -> str:
        """Elements within a sentence whose text is the sentence's."""
        return self.rng.choice(("<math><mi>{0}</mi><mo>=</mo><mn>2</mn></math>", "<svg><text>{0}</text></svg>", "<button>{0}</button>", "<code>{0}</code>")).format(self.sentence(1, 2))

    def advert(self) -> str:
        name = self.rng.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "adbox"))
        return self.tagged(self.rng.choice(("div", "div", "section", "aside")), self.rng.choice((self.prose(), f"<p>{self.prose()}</p>")), name)

    def before(self) -> list[str]:
        out = [
            lambda: self.tagged("nav", self.links("ul", self.rng.randint(2, 8)), *(("nav", "menu", "main-nav") if self.rng.random() < 0.4 else ())),
            lambda: self.tagged("header", f"<h1>{self.sentence(1, 4)}</h1><p>{self.sentence(2, 9)}</p>", "header", "site-header", "masthead"),
            lambda: f"<header><div>{self.sentence(1, 5)}</div></header>",
            lambda: self.tagged("div", self.links("ul", self.rng.randint(2, 7)), "menu", "navbar", "navigation", "breadcrumbs", "topbar"),
            lambda: self.tagged("div", f"<p>{self.prose()}</p>", "cookie", "cookie-notice", "consent", "notice", "gdpr-banner", "alert", "newsletter-notice"),
            self.advert,
        ]
        return [f() for f in self.rng.sample(out, self.rng.randint(1, 4))]

    def after(self) -> list[str]:
        note = "<p>" + self.prose() + "</p>"
        comments = "".join(self.tagged("div", f"<b>{self.rng.choice(self.words)}</b><p>{self.prose()}</p>", "comment", "reply", "comment-body") for _ in range(self.rng.randint(1, 5)))
        out = [
            lambda: self.tagged("footer", f"&copy; {self.sentence(1, 4)} &middot; {self.prose()}", *(("footer", "site-footer") if self.rng.random() < 0.3 else ())),
            lambda: f"<footer><p>{self.prose()}</p></footer>",
            lambda: self.tagged("div", f"&copy; {self.sentence(2, 12)}", "footer", "copyright", "legal", "bottom"),
            lambda: self.tagged("aside", f"<h3>{self.sentence(1, 4)}</h3>" + self.rng.choice((note, self.links("ul", 4))), *(("sidebar", "related") if self.rng.random() < 0.5 else ())),
            lambda: self.tagged("div", f"<h3>{self.sentence(1, 4)}</h3>" + self.rng.choice((note, self.links("ul", 3))), "sidebar", "related", "widget", "recommended", "share", "social", "tags"),
            lambda: self.tagged("form", f"<label>{self.sentence(1, 3)}</label><input name='q'><p>{self.sentence(2, 9)}</p><button>{self.sentence(1, 2)}</button>", *(("search", "subscribe", "login") if self.rng.random() < 0.5 else ())),
            lambda: self.tagged(self.rng.choice(("section", "div", "div")), f"<h2>{self.sentence(1, 3)}</h2>" + comments, "comments", "comment-list", "discussion", "replies", "responses"),
            lambda: f"<nav><a href='/p'>{self.sentence(1, 2)}</a> <a href='/n'>{self.sentence(1, 2)}</a></nav>",
            self.advert,
        ]
        return [f() for f in self.rng.sample(out, self.rng.randint(1, 5))]

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.04:
            parts = [*self.before(), *self.after()]
        elif rng.random() < LONE:
            parts = [self.unnamed([f"<p>{self.MARK}{self.prose()}</p>" for _ in range(rng.randint(1, 6))])]
        else:
            body, tail = self.main(), self.after()
            if rng.random() < 0.1 and body.endswith("</article>"):
                body, tail = body[: -len("</article>")] + tail[0] + "</article>", tail[1:]
            parts = [*self.before(), body, *tail]
        joined = "".join(x if rng.random() < 0.6 else x + "\n" for x in parts)
        if rng.random() < 0.15:
            joined = self.tagged("div", joined, "wrapper", "container", "page", "site")
        return f"<html><head><title>{self.sentence(1, 8)}</title><script>var x='</p>'</script></head><body>{joined}</body></html>"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[list[tuple[Block, bool]]]:
    """Leaf blocks of written pages, each with whether it is main text; the same for the same numbers."""
    out = []
    for k in range(n):
        blocks = leaf_blocks(_Writer(random.Random(seed * 1_000_003 + k)).page())
        labelled = [(b, _Writer.MARK in b.text) for b in blocks]
        for b, _ in labelled:
            b.text = b.text.replace(_Writer.MARK, "")
        out.append(labelled)
    return out


@functools.cache
def default_field(pages: int = TRAINING_PAGES) -> Field:
    return train(labelled_pages(pages))


def extract_text(spark: SparkSession, pages: DataFrame, model: Field | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = spark.sparkContext.broadcast(model or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.text(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
