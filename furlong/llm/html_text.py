"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: runs of text between the tags that begin or end a block. A block's
features are the tags around it, words of their class, id and role names, and properties of its
text. The field labels each block as article or not; weights are learned from labelled pages and
the best labelling is found by Viterbi.

Labelled pages come from a bounded sample of the table: whole pages with an article or main element, which
label themselves. Each one's paragraphs are also laid out anew in known ways (other containers, menus, notices,
adverts, forms, sidebars, reader comments), so that the labels are known. Where no page labels itself, only such
layouts are learned from, with the paragraphs of the sample, or made-up ones if it has none.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "op4_article_text"
SQL = None
SAMPLE_PAGES = 150
SAMPLE_CHARS = 50_000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)|(<)|([^<]+)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# fixed values: element kinds of the HTML standard
_SILENT = frozenset("script style noscript template textarea title iframe svg annotation select option canvas audio video".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr svg object math annotation semantics mi mo mn ms mtext mrow mfrac msqrt "
    "mroot msup msub msubsup mover munder munderover mstyle mpadded mfenced".split()
)
_CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol pre section table ul".split()
)
# words of class, id and role names that say what a part of a page is for
_GROUPS = {
    "body": "article content main post entry story body text prose",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs topbar tabs pagination pager toc",
    "head": "header masthead banner head logo branding",
    "foot": "footer foot bottom colophon copyright legal",
    "side": "sidebar side aside widget related recommended more popular trending rail complementary",
    "advert": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion promoted",
    "notice": "cookie cookies consent notice alert popup modal gdpr dialog message disclaimer",
    "form": "form login signup subscribe newsletter search register contact input",
    "reply": "comment comments reply replies respond discussion disqus thread reader readers responses",
    "share": "share sharing social follow tweet facebook tags author byline meta",
}
_GROUP_OF = {w: g for g, words in _GROUPS.items() for w in words.split()}
_TAG_GROUPS = {"nav", "header", "footer", "aside", "form", "article", "main", "section", "figure", "table", "ul", "ol", "blockquote"}


@dataclass
class Block:
    text: str
    features: list[str]
    around: frozenset[str]


def _names(attributes: str) -> set[str]:
    groups = set()
    for _, value in _ATTRIBUTE.findall(attributes):
        for word in _WORD.findall(_CAMEL.sub(" ", value).lower()):
            if word in _GROUP_OF:
                groups.add("is:" + _GROUP_OF[word])
    return groups


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in its order; text has references decoded and spaces folded.

    Elements that are left open, ends without a begin and a page that breaks off are all allowed:
    an end closes up to the nearest element of its name, or nothing.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    around: list[frozenset[str]] = [frozenset()]
    text: list[str] = []
    linked = 0
    inside_link = silent = 0
    skip_to: str | None = None

    def close_block() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                here = around[-1]
                tag = next((t for t, _ in reversed(stack) if t not in _INLINE), "none")
                blocks.append(Block(" ".join(words), _features(words, linked, tag, here), here))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal inside_link, silent
        tag, _ = stack.pop()
        around.pop()
        inside_link -= tag == "a"
        silent -= tag in _SILENT

    for m in _TOKEN.finditer(page or ""):
        cdata, slash, tag, attributes, end, stray, chars = m.groups()
        if skip_to:
            if tag and slash and tag.lower() == skip_to:
                skip_to = None
                pop()
            continue
        chars = chars or cdata or stray
        if chars:
            if not silent:
                text.append(chars)
                linked += len(chars) if inside_link else 0
            continue
        if not tag or not end:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _INLINE and not silent:
            close_block()
        if slash:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _VOID:
            continue
        shut = _CLOSES.get(tag, {"p"} if tag in _ENDS_P else ())
        while stack and stack[-1][0] in shut or (len(stack) > 1 and stack[-1][0] in _INLINE and stack[-2][0] in shut):
            pop()
        marks = _names(attributes) if attributes else set()
        if tag in _TAG_GROUPS:
            marks.add("in:" + tag)
        own = frozenset(marks)
        stack.append((tag, own))
        around.append(around[-1] | own if own else around[-1])
        inside_link += tag == "a"
        silent += tag in _SILENT
        if tag in _RAW:
            skip_to = tag
    close_block()
    _place(blocks)
    return blocks


def _features(words: list[str], linked: int, tag: str, around: frozenset[str]) -> list[str]:
    text = " ".join(words)
    n = len(words)
    out = ["one", "tag:" + tag, *sorted(around)]
    out.append("words:" + ("1" if n == 1 else "4" if n < 5 else "12" if n < 13 else "40" if n < 41 else "more"))
    share = linked / max(len(text), 1)
    out.append("links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
    if text[-1] in ".!?:;…。！？\"'”»)":
        out.append("stop")
    if "©" in text or "copyright" in text.lower():
        out.append("rights")
    if "in:article" not in around and "in:main" not in around and "is:body" not in around:
        out.append("loose")
    return out


def _place(blocks: list[Block]) -> None:
    for k, b in enumerate(blocks):
        if k == 0:
            b.features.append("first")
        if k == len(blocks) - 1:
            b.features.append("last")


# ---- the field


class Field:
    """Two labels (0 other, 1 article), weights of the features for label 1, and of label pairs."""

    def __init__(self, names: Sequence[str], weights: np.ndarray, pairs: np.ndarray, ends: np.ndarray):
        self.weight = dict(zip(names, weights.tolist(), strict=True))
        self.pairs, self.ends = pairs.tolist(), ends.tolist()

    def scores(self, block: Block) -> float:
        return sum(self.weight.get(f, 0.0) for f in block.features)

    def labels(self, blocks: list[Block]) -> list[int]:
        """The best labelling, by Viterbi; at equal scores label 0."""
        if not blocks:
            return []
        (p00, p01), (p10, p11) = self.pairs
        a, b = self.ends[0][0], self.ends[0][1] + self.scores(blocks[0])
        back = []
        for block in blocks[1:]:
            s = self.scores(block)
            from0, from1 = int(b + p10 > a + p00), int(b + p11 > a + p01)
            back.append((from0, from1))
            a, b = (b + p10 if from0 else a + p00), (b + p11 if from1 else a + p01) + s
        out = [int(b + self.ends[1][1] > a + self.ends[1][0])]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, y in zip(blocks, self.labels(blocks), strict=True) if y)


class Pages:
    """Labelled pages of about one length, padded to the longest, with what a step of the training needs."""

    def __init__(self, pages: list[tuple[list[Block], list[int]]], place: dict[str, int]):
        n, longest = len(pages), max(len(b) for b, _ in pages)
        self.n, self.longest, self.features = n, longest, len(place)
        size = np.array([len(b) for b, _ in pages])
        gold = np.zeros((n, longest), dtype=np.int64)
        row, col, feature = [], [], []
        for i, (blocks, labels) in enumerate(pages):
            gold[i, : len(labels)] = labels
            for t, b in enumerate(blocks):
                for f in b.features:
                    row.append(i), col.append(t), feature.append(place[f])
        self.row, self.col, self.feature = (np.array(x) for x in (row, col, feature))
        self.valid = np.arange(longest)[None, :] < size[:, None]
        self.last = size - 1
        both = self.valid[:, 1:]
        seen_pairs = np.zeros((2, 2))
        np.add.at(seen_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        ends = [np.bincount(gold[:, 0], minlength=2), np.bincount(gold[np.arange(n), self.last], minlength=2)]
        seen = np.bincount(self.feature, weights=gold[self.row, self.col], minlength=self.features)
        self.seen = np.concatenate([seen, seen_pairs.ravel(), np.stack(ends).ravel()])

    def expected(self, theta: np.ndarray) -> np.ndarray:
        """What the field expects of features, label pairs and ends, by forward-backward over all pages at once."""
        n, longest, last, valid = self.n, self.longest, self.last, self.valid
        w, pairs, ends = theta[: self.features], theta[self.features : -4].reshape(2, 2), theta[-4:].reshape(2, 2)
        score = np.zeros((n, longest, 2))
        own = np.bincount(self.row * longest + self.col, weights=w[self.feature], minlength=n * longest)
        score[:, :, 1] = own.reshape(n, longest)
        fore, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = score[:, 0] + ends[0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(fore[:, t - 1, :, None] + pairs[None], axis=1) + score[:, t]
            fore[:, t] = np.where(valid[:, t, None], new, fore[:, t - 1])
        back[np.arange(n), last] = ends[1]
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(pairs[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where((t < last)[:, None], new, back[:, t])
        total = np.logaddexp.reduce(fore[np.arange(n), last] + ends[1], axis=1)
        node = np.exp(fore + back - total[:, None, None]) * valid[:, :, None]
        edge = fore[:, :-1, :, None] + pairs[None, None] + (score[:, 1:] + back[:, 1:])[:, :, None, :]
        edge = np.exp(edge - total[:, None, None, None]) * valid[:, 1:, None, None]
        of_features = np.bincount(self.feature, weights=node[self.row, self.col, 1], minlength=self.features)
        of_ends = np.stack([node[:, 0].sum(axis=0), node[np.arange(n), last].sum(axis=0)])
        return np.concatenate([of_features, edge.sum(axis=(0, 1)).ravel(), of_ends.ravel()])


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 200, penalty: float = 0.0005) -> Field:
    """Maximum likelihood with an L2 penalty, by gradient steps with adaptive rates (Adam).

    Pages are worked in groups whose lengths lie between two powers of two, so that a long page does not
    pad the others.
    """
    pages = [p for p in pages if p[0]]
    names = sorted({f for blocks, _ in pages for b in blocks for f in b.features})
    if not pages:
        return Field([], np.zeros(0), np.zeros((2, 2)), np.zeros((2, 2)))
    place = {f: k for k, f in enumerate(names)}
    lengths: dict[int, list[tuple[list[Block], list[int]]]] = {}
    for p in pages:
        lengths.setdefault(max(len(p[0]), 32).bit_length(), []).append(p)
    groups = [Pages(group, place) for _, group in sorted(lengths.items())]
    seen = sum(g.seen for g in groups)
    theta = np.zeros(len(names) + 8)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        slope = (seen - sum(g.expected(theta) for g in groups)) / len(pages) - penalty * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(names, theta[: len(names)], theta[len(names) : -4].reshape(2, 2), theta[-4:].reshape(2, 2))


# ---- labelled pages

_NOT_ARTICLE = {"in:nav", "in:header", "in:footer", "in:aside", "in:form"} | {
    "is:" + g for g in ("menu", "head", "foot", "side", "advert", "notice", "form", "reply", "share")
}


def self_labelled(page: str | None) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page that marks its article itself, or None."""
    blocks = leaf_blocks(page)
    if not any({"in:article", "in:main"} & b.around for b in blocks):
        return None
    return blocks, [int(bool({"in:article", "in:main"} & b.around) and not b.around & _NOT_ARTICLE) for b in blocks]


# how parts of a page are written: (begin, end) around the article, and other parts by kind
_BODIES = (
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"),
    ('<div class="post entry">', "</div>"), ('<section class="story">', "</section>"), ('<div class="article-body">', "</div>"),
    ("<div>", "</div>"), ('<main><article class="post">', "</article></main>"), ("", ""),
)
_PARTS = {
    "before": (
        '<nav><ul>{links}</ul></nav>', '<div class="menu">{links}</div>', "<header><h2>{short}</h2>{links}</header>",
        '<div id="header"><p>{short}</p></div>', '<ul class="breadcrumb">{links}</ul>', '<div class="cookie-notice"><p>{long}</p></div>',
        '<div class="ad">{long}</div>', '<form action="/s"><label>{short}</label><input><button>{short}</button></form>',
        '<div class="banner"><p>{short}</p></div>', '<div class="alert"><p>{long}</p></div>', '<header class="site-header"><p>{long}</p></header>',
    ),
    "inside": (
        '<div class="advert"><p>{long}</p></div>', '<aside><p>{long}</p></aside>', '<div class="share">{links}</div>',
        '<div class="sponsored">{short}</div>', '<div class="related"><ul>{links}</ul></div>', '<form class="newsletter"><p>{long}</p></form>',
        '<section class="comments"><p>{long}</p><p>{long}</p></section>', '<div id="comments"><div class="comment"><p>{long}</p></div></div>',
        '<nav>{links}</nav>', '<footer><p>{short}</p></footer>', '<div class="notice"><p>{long}</p></div>', '<header><p>{short}</p></header>',
    ),
    "after": (
        "<footer>&copy; {short}</footer>", '<div class="footer"><p>{long}</p></div>', "<aside><h3>{short}</h3><p>{long}</p></aside>",
        '<div class="sidebar"><ul>{links}</ul><p>{long}</p></div>', '<section id="comments"><h3>{short}</h3><p>{long}</p><p>{long}</p></section>',
        '<div class="comments"><ul><li>{long}</li><li>{long}</li></ul></div>', '<form><p>{short}</p><textarea></textarea></form>',
        '<div class="related">{links}</div>', '<div class="popup"><p>{long}</p></div>', '<div class="promo"><p>{long}</p></div>',
        '<div class="reader-comments"><p>{long}</p></div>', '<p class="copyright">{short}</p>',
    ),
}


def laid_out(texts: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of these paragraphs in one of the known layouts, and its labels.

    The article's text carries a mark that no page has; it gives the labels and is then taken out.
    """
    mark = ""

    def filled(part: str) -> str:
        def one(m: re.Match) -> str:
            words = rng.choice(texts).split()
            if m[1] == "long":
                return html.escape(" ".join(words))
            if m[1] == "short":
                return html.escape(" ".join(words[: rng.randint(1, 6)]))
            return "".join(f'<li><a href="/x">{html.escape(w)}</a></li>' for w in words[: rng.randint(2, 8)])

        return re.sub(r"\{(\w+)\}", one, part)

    kinds = ["<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<li>{}</li>", "<blockquote>{}</blockquote>", "<h2>{}</h2>"]
    begin, end = rng.choice(_BODIES)
    title = f"<h1>{mark}{html.escape(' '.join(rng.choice(texts).split()[:9]))}</h1>"
    own = [rng.choice(kinds).format(mark + html.escape(t)) for t in rng.sample(texts, rng.randint(1, len(texts)))]
    if rng.random() < 0.5:
        own.insert(rng.randint(0, len(own)), filled(rng.choice(_PARTS["inside"])))
    if rng.random() < 0.3:
        own.append(filled(rng.choice(_PARTS["inside"])))
    body = begin + (title if rng.random() < 0.7 else "") + "".join(own) + end
    before = "".join(filled(p) for p in rng.sample(_PARTS["before"], rng.randint(0, 3)))
    after = "".join(filled(p) for p in rng.sample(_PARTS["after"], rng.randint(0, 3)))
    blocks = leaf_blocks(f"<html><body>{before}{body}{after}</body></html>")
    return blocks, [int(mark in b.text) for b in blocks]


def made_up(rng: random.Random) -> list[str]:
    """Paragraphs of no meaning, for a sample without any."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    return [" ".join(word() for _ in range(rng.choice((3, 9, 25, 60)))) + rng.choice((".", ".", "")) for _ in range(12)]


def labelled_pages(sample: list[str | None], seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Each page of the sample that labels itself, whole, and three layouts of its paragraphs.

    If none does, the layouts of every page's paragraphs of 13 words or more; if there are none, of made-up ones.
    """
    rng = random.Random(seed)
    out = []
    for page in sample:
        own = self_labelled(page)
        texts = [b.text for b, y in zip(*own, strict=True) if y] if own else []
        if own:
            out.append(own)
        out += [laid_out(texts, rng) for _ in range(3)] if texts else []
    if out:
        return out
    for page in sample:
        texts = [b.text for b in leaf_blocks(page) if len(b.text.split()) > 12]
        out += [laid_out(texts, rng) for _ in range(3)] if texts else []
    return out or [laid_out(made_up(rng), rng) for _ in range(300)]


def fit(
    pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS
) -> Field:
    """A field trained on at most sample_pages whole pages of at most sample_chars characters.

    Pages with an article or main element come first, then those with the least hash of their html.
    """
    marked = F.col(html_col).rlike(r"(?i)<(article|main)[\s>]")
    rows = pages.filter(F.length(html_col) <= sample_chars).select(
        html_col, F.struct((~marked).cast("int").alias("u"), F.xxhash64(html_col).alias("x")).alias("h")
    )
    # first the hashes alone, so that tasks send no pages which are not taken
    last = rows.select("h").distinct().orderBy("h").limit(sample_pages).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return train(labelled_pages([]))
    least = F.struct(F.lit(last["u"]).alias("u"), F.lit(last["x"]).cast("bigint").alias("x"))
    taken = rows.filter(F.col("h") <= least).select(html_col).distinct()
    sample = sorted(taken.limit(sample_pages).collect())
    return train(labelled_pages([r[0] for r in sample]))


def extract(
    pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars), one row per input row, without a shuffle.

    text joins the article's blocks by a line feed; it is empty for a null or empty page and where no
    block is article. Repeated rows are read one by one; other columns are not read.
    """
    kinds = [pages.select(c).schema[0].dataType.simpleString() for c in (id_col, url_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [field.text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    schema = f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint"
    return pages.select(id_col, url_col, html_col).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
