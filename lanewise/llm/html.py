"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is read into blocks of text in page order, each with the elements around it. Features are
tags and class words of those elements and some of the text; the field weighs them and the
neighbour's label, is trained by gradient ascent on the likelihood of labelled pages, and decoded
by Viterbi. The main text is the blocks labelled 1.
"""

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import annotate

#: Elements without an end tag, with raw content, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary"
    " table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag that ends an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}} | dict.fromkeys(
    ("td", "th"), {"td", "th"}
) | dict.fromkeys(("dt", "dd"), {"dt", "dd"})
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|data-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
SPACES = re.compile(r"\s+")

BUCKETS = 1 << 14
#: At most so many pages, those of the smallest hashes, are labelled for training.
TRAINING_PAGES = 300
CHAIN = 64


class Path:
    """An open element with what its ancestors and it hold: tags, words of their attributes, block tags nearest to the text.

    A child that adds nothing new shares its parent's sets, so that a deep page costs no more than a long one.
    """

    __slots__ = ("tag", "tags", "words", "blocks", "label")

    def __init__(self, tag: str = "", words: str = "", label: int | None = None, up: "Path | None" = None):
        own = {w for w in re.split(r"[^a-z]+", words) if w}
        self.tag = tag
        self.tags = frozenset() if up is None else up.tags if tag in up.tags else up.tags | {tag}
        self.words = frozenset() if up is None else up.words if own <= up.words else up.words | own
        self.blocks = () if up is None else (*up.blocks, tag)[-2:] if tag in BLOCK else up.blocks
        self.label = label if label is not None or up is None else up.label

    @property
    def key(self) -> tuple:
        return self.tag, self.tags, self.words, self.blocks


@dataclass
class Block:
    around: Path
    label: int | None
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def read_blocks(page: str, labelled: bool = False) -> list[Block]:
    """Blocks with text, in page order; entities decoded, white space inside a block turned into one space.

    ``labelled`` pages are those of ``variant``, whose elements say what they are.
    """
    out: list[Block] = []
    root = Path()
    stack: list[Path] = []
    open_tags: Counter[str] = Counter()
    now: Block | None = None
    unclosed: set[str] = set()

    def text(raw: str) -> None:
        nonlocal now
        if now is None:
            if not raw.strip():
                return
            around = stack[-1] if stack else root
            now = Block(around, around.label)
            out.append(now)
        now.parts.append(raw)
        if open_tags["a"]:
            now.linked += len(raw)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            now = None
        elif tag == "br" and now is not None:
            now.parts.append(" ")
        if m[1]:
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    leave(len(stack) - 1)
                leave(len(stack) - 1)
            continue
        if tag in RAW:
            if tag == "svg" and m[3].rstrip(">").endswith("/"):
                continue
            close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                at = end
            else:  # without an end tag, only the tag itself is left out
                unclosed.add(tag)
            continue
        if tag in VOID or m[3].rstrip(">").endswith("/") and tag not in BLOCK:
            continue
        ends = CLOSES.get(tag)
        if ends and any(open_tags[t] for t in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends:
                    leave(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        words, label = "", None
        if "=" in m[3]:
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])}
            own = found.pop("data-label", None)
            label = int(own) if labelled and own is not None else None
            words = " ".join(found.values()).lower()
        stack.append(Path(tag, words, label, stack[-1] if stack else root))
        open_tags[tag] += 1
    for b in out:
        raw = "".join(b.parts)
        b.text = SPACES.sub(" ", html.unescape(raw)).strip()
        b.parts = []
    return [b for b in out if b.text]


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def structure_features(around: Path) -> list[str]:
    names = {f"in:{t}" for t in around.tags} | {f"word:{w}" for w in around.words}
    return sorted(names | {f"parent:{around.tag}", f"block:{'>'.join(around.blocks)}"})


def text_features(b: Block) -> list[str]:
    t = b.text
    n = len(t)
    ends = t[-1] in ".!?:;\"”»"
    out = ["bias", f"length:{min(9, n.bit_length())}", f"ends:{ends}", f"short:{n < 40}:{ends}"]
    out.append(f"linked:{min(4, 4 * b.linked // n)}")
    out.append(f"stops:{min(4, sum(t.count(c) for c in '.!?'))}")
    if "©" in t or "(c)" in t.lower():
        out.append("copyright")
    if sum(map(str.isdigit, t)) * 4 > n:
        out.append("digits")
    return out


class Field:
    """The field's weights: ``emit[bucket, label]``, ``move[from, to]``, ``start[label]``."""

    def __init__(self):
        self.emit, self.move, self.start = np.zeros((BUCKETS, 2)), np.zeros((2, 2)), np.zeros(2)
        self._known: dict = {}

    def __getstate__(self):
        return {"emit": self.emit, "move": self.move, "start": self.start, "_known": {}}

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        out = []
        for b in blocks:
            around = b.around.key
            base = self._known.get(around)
            if base is None:
                base = self.emit[[bucket(f) for f in structure_features(b.around)]].sum(axis=0)
                if len(self._known) < 10_000:
                    self._known[around] = base
            key = tuple(text_features(b))
            more = self._known.get(key)
            if more is None:
                more = self._known[key] = self.emit[[bucket(f) for f in key]].sum(axis=0)
            out.append((float(base[0] + more[0]), float(base[1] + more[1])))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        scores = self.scores(blocks)
        a, b = self.start[0] + scores[0][0], self.start[1] + scores[0][1]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + m00 if from0 else b + m10) + s0, (a + m01 if from1 else b + m11) + s1
        label = 1 if b > a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[list[Block]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam; chains run in step, forward and backward in log space."""
    chains = [p[i : i + CHAIN] for p in pages for i in range(0, len(p), CHAIN)]
    f = Field()
    if not chains:
        return f
    n, length = len(chains), max(map(len, chains))
    mask = np.zeros((n, length), bool)
    gold = np.zeros((n, length), int)
    where, ids = [], []
    for i, c in enumerate(chains):
        for t, b in enumerate(c):
            mask[i, t], gold[i, t] = True, b.label or 0
            own = [bucket(x) for x in (*structure_features(b.around), *text_features(b))]
            where += [i * length + t] * len(own)
            ids += own
    where, ids = np.array(where), np.array(ids)
    used, local = np.unique(ids, return_inverse=True)
    params = [np.zeros((len(used), 2)), np.zeros((2, 2)), np.zeros(2)]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = mask.sum()
    hot = np.eye(2)[gold] * mask[..., None]
    pair = (mask[:, 1:] & mask[:, :-1])[..., None, None]
    gold_pairs = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum(axis=(0, 1))
    for k in range(1, rounds + 1):
        emit, move, start = params
        e = np.stack([np.bincount(where, emit[local, y], n * length) for y in (0, 1)], -1).reshape(n, length, 2)
        fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fwd[:, 0] = start + e[:, 0]
        for t in range(1, length):
            step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + move, axis=1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        pairs = np.exp(fwd[:, :-1, :, None] + move + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair
        d = (hot - p).reshape(-1, 2)
        grads = [
            np.stack([np.bincount(local, d[where, y], len(used)) for y in (0, 1)], -1) / total - decay * emit,
            (gold_pairs - pairs.sum(axis=(0, 1))) / total - decay * move,
            (hot[:, 0] - p[:, 0]).sum(axis=0) / total,
        ]
        for x, g, m1, m2 in zip(params, grads, one, two, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    f.emit[used], f.move, f.start = params
    return f


# ---- labelled pages -----------------------------------------------------------------------

#: What marks a block as no part of an article, wherever it stands.
SIDE_TAGS = frozenset("nav footer aside form head button select menu dialog".split())
SIDE_WORDS = frozenset(
    "ad ads advert advertisement banner sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead comment comments reply replies discussion notice cookie consent popup modal alert share social"
    " related recommended newsletter subscribe signup login search pagination pager widget toolbar".split()
)
MAIN_TAGS = frozenset(("article", "main"))


def label_blocks(blocks: list[Block]) -> bool:
    """Labels a page by its markup; False if the page has no ``article`` or ``main`` to go by."""
    for b in blocks:
        tags, words = b.around.tags, b.around.words
        side = tags & SIDE_TAGS or words & SIDE_WORDS or "header" in tags and not tags & MAIN_TAGS
        b.label = int(bool(tags & MAIN_TAGS) and not side)
    return any(b.label for b in blocks)


def variant(page: str, blocks: list[Block], draw: random.Random) -> str:
    """The page's texts in another layout, labelled: other elements, classes, and things beside the article."""
    body = [b for b in blocks if b.label]
    rest = [b.text for b in blocks if not b.label] or ["Home"]
    quote = html.escape

    def lines(count: int, tag: str) -> str:
        own = [draw.choice(rest) if draw.random() < 0.5 else draw.choice(body).text for _ in range(count)]
        return "".join(f"<{tag}>{quote(x)}</{tag}>" for x in own)

    def side() -> str:
        word = draw.choice(sorted(SIDE_WORDS))
        shape = draw.randrange(7)
        n = draw.randint(1, 3)
        if shape == 0:
            return f'<aside class="{word}" data-label="0">{lines(n, "p")}</aside>'
        if shape == 1:
            return f'<form data-label="0"><label>{quote(draw.choice(rest))}</label>{lines(1, "button")}</form>'
        if shape == 2:
            return f'<section class="{word}" data-label="0"><h2>{quote(draw.choice(rest))}</h2>{lines(n, "p")}</section>'
        if shape == 3:
            return f'<div id="{word}" data-label="0"><ul>{lines(n, "li")}</ul></div>'
        if shape == 4:
            return f'<div class="{word} box" data-label="0">{quote(draw.choice(body).text)}</div>'
        if shape == 5:
            return f'<{word_tag} data-label="0">{lines(n, "p")}</{word_tag}>' if (word_tag := draw.choice(("nav", "footer", "aside"))) else ""
        return f'<div class="{word}" data-label="0">{lines(n, "p")}</div>'

    tag, words = draw.choice(
        [("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("section", "post"), ("div", "entry text")]
    )
    inner = []
    for b in body:
        kind = draw.choice(("p", "p", "p", "div", "li", "blockquote", "h2"))
        inner.append(f"<{kind}>{quote(b.text)}</{kind}>")
        if draw.random() < 0.1:
            inner.append(side())
    head = f'<header data-label="0">{lines(1, "p")}</header>' if draw.random() < 0.5 else ""
    before, after = ["".join(side() for _ in range(draw.randint(0, 2))) for _ in "ab"]
    main = f'<{tag} class="{words}" data-label="1">{"".join(inner)}</{tag}>'
    return f'<html><body data-label="0">{head}{before}{main}{after}<footer>{lines(1, "p")}</footer></body></html>'


def labelled(page: str, seed: int, variants: int = 2) -> list[list[Block]]:
    """The page's blocks and those of its variants; nothing for a page that cannot be labelled."""
    blocks = read_blocks(page)
    if not label_blocks(blocks):
        return []
    draw = random.Random(seed)
    return [blocks, *[read_blocks(variant(page, blocks, draw), True) for _ in range(variants)]]


def fit(pages: DataFrame, column: str = "html", most: int = TRAINING_PAGES) -> Field:
    """Trains on the ``most`` different pages of the smallest hashes.

    The hashes are ranked without the pages, so that no more than the chosen pages reach the driver.
    """
    hashed = pages.where(F.length(column) > 0).select(column, F.xxhash64(column).alias("_h"))
    chosen = hashed.select("_h").distinct().orderBy("_h").limit(most).collect()
    if not chosen:
        return Field()
    rows = hashed.where(F.col("_h") <= chosen[-1][0]).dropDuplicates(["_h"]).orderBy("_h").collect()
    return train([b for i, r in enumerate(rows) for b in labelled(r[0], i)])


def extract_text(pages: DataFrame, model: Field, column: str = "html") -> DataFrame:
    """``row`` (the input), ``text`` and ``n_chars``: the main text of the whole page.

    Blocks in page order with an empty line between them. A null or empty page, or one without main
    text, has an empty text. Repeated rows are read alike; no rows give no rows.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        field_ = shipped.value

        def run(raw):
            texts = []
            for r in raw:
                blocks = read_blocks(r.decode()) if r else []
                labels = field_.decode(blocks)
                texts.append("\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y))
            return texts, [len(t) for t in texts]

        return run

    return annotate(pages, column, make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
