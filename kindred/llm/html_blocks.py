"""Main text of web pages: a recurrent network labels every text block in its context.

A page becomes a sequence of blocks. Each is described by its tag path (tags and
the parts of class, id and role names, hashed), its words (hashed) and a few
numbers. A bidirectional LSTM reads the sequence, so that every decision sees the
whole page. It is trained here, on a bounded sample of the pages themselves: labels
come from names that say what a block is for, and the sample is also shown in other
dress, with the containers named in other common ways and with more kinds of
boilerplate, so that what it learns does not hang on one page layout.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z",
    re.DOTALL,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style head title template noscript textarea select option button svg iframe object canvas audio video math".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: What may stand in a head; any other element, and text, ends one that is open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: HTML elements that end an open drawing or formula, unless they stand in one of its ``HTML_INSIDE``.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)
HTML_INSIDE = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Other silent elements, and the start tags that end them.
ENDED_BY = {"select": {"select", "input", "textarea", "body"}, "button": {"button", "body"}}

#: Names that say that a block is not the article, by kind, and names of the article's container.
KINDS: dict[str, tuple[str, ...]] = {
    "menu": ("nav", "div.menu", "div.navbar", "ul.navigation", "div#topnav", "div.breadcrumbs", "nav.site-nav", "div.pagination", "div.toc-nav"),
    "header": ("header", "div.header", "div#masthead", "header.site-header", "div.topbar", "div.branding"),
    "footer": ("footer", "div.footer", "div#footer", "div.copyright", "footer.site-footer", "div.colophon"),
    "side": ("aside", "div.sidebar", "aside.widget", "div#secondary", "section.related", "div.recommended", "div.trending", "div.more-stories"),
    "notice": ("div.cookie-notice", "div.consent", "div#gdpr", "div.alert", "div.notice", "dialog", "div.modal", "div.popup", "div.banner"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "ins.adsbygoogle", "div.sponsored", "div.promo", "aside.ad-slot", "div.promotion"),
    "form": ("form", "div.newsletter form", "div.subscribe", "form.search-form", "fieldset", "div.signup", "div.login"),
    "comments": ("div.comments", "section#comments", "ol.comment-list", "div.comment", "section.reader-comments", "div#disqus", "div.replies", "div.discussion"),
    "share": ("div.share", "div.social", "ul.social-links", "div.tags", "div.share-buttons"),
}
ARTICLE = ("article", "main", "div.article", "div.content", "div#content", "div.post", "section.entry-content", "div.main-content", "div.story", "main article", "div.article-body", "div.text", "div", "div", "section")
PAGE = ("", "", "div.page", "div#wrapper", "div.container", "div.site div.row")


def name_tokens(element: str) -> list[str]:
    """Tokens of an element: the tag, and each part of its names whole and by its first five letters."""
    tag, *names = re.split(r"[.#]", element)
    out = [tag]
    for name in names:
        for part in PART.findall(name):
            part = part.lower()
            out += [f".{part}", f"~{part[:5]}"]
    return out


BAD = {t for kind in KINDS.values() for spec in kind for e in spec.split() for t in name_tokens(e) if t[0] == "." or t in ("nav", "footer", "aside", "form", "dialog", "fieldset")}
BAD -= {".site", ".list", ".more", ".slot", ".links", ".buttons", ".search", ".toc", ".row", ".page"}
GOOD = {"article", "main", ".article", ".content", ".post", ".entry", ".story", ".body", ".text"}


@dataclass
class Block:
    path: list[str]
    text: str
    linked: float
    label: bool | None = None


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with white space made single and character references decoded.

    Missing and wrong end tags are taken as browsers take them, roughly; a tag
    cut off by the end of the page is no text. The path of a block has each token
    of all open elements once.
    """
    stack: list[tuple[str, list[str]]] = []
    out: list[Block] = []
    pieces: list[str] = []
    around: dict[str, int] = {}
    links: list[int] = []
    linked = silent = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            leaf = next((f"leaf:{tag}" for tag, _ in reversed(stack) if tag in BREAKS), "leaf:")
            out.append(Block([*around, leaf], text, min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    def pop(place: int) -> None:
        nonlocal silent
        while len(stack) > place:
            tag, tokens = stack.pop()
            silent -= tag in SILENT
            for t in tokens:
                around[t] -= 1
                if not around[t]:
                    del around[t]
        while links and links[-1] >= place:
            links.pop()

    def end_silent(tag: str) -> None:
        """End the silent elements that a start tag ends."""
        for i, (name, _) in enumerate(stack):
            if name == "head":
                ends = tag not in IN_HEAD and all(below not in SILENT for below, _ in stack[i + 1 :])
            elif name in ("svg", "math"):
                ends = tag in BREAKOUT and all(below not in HTML_INSIDE for below, _ in stack[i + 1 :])
            else:
                ends = tag in ENDED_BY.get(name, ())
            if ends:
                return pop(i)

    def add(raw: str) -> None:
        nonlocal linked
        if silent and stack[-1][0] == "head" and raw.strip():
            pop(len(stack) - 1)
        if raw and not silent:
            piece = html.unescape(raw)
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    position, size = 0, len(page)
    while position < size:
        found = TOKEN.search(page, position)
        if not found:
            add(page[position:])
            break
        add(page[position : found.start()])
        position = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BREAKS:
                flush()
            if place is not None:
                pop(place)
            continue
        if silent:
            end_silent(tag)
        if tag in BREAKS:
            flush()
            if tag != "a":  # a block ends an open paragraph
                place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None) if "p" in around else None
                if place is not None:
                    pop(place)
        elif tag == "br":
            pieces.append(" ")
        if tag in ENDS_ITSELF:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ENDS_ITSELF[tag]:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
        if tag in VOID or attributes.endswith("/") and tag not in BREAKS:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.IGNORECASE).search(page, position)
            position = end.end() if end else size
            continue
        names = ["".join(x) for x in NAMES.findall(attributes)] if attributes else []
        if tag == "a":  # ends an open link; without an address it is none
            links[:] = [len(stack)] if HREF.search(attributes) else []
        stack.append((tag, name_tokens(".".join([tag, *names]))))
        for t in stack[-1][1]:
            around[t] = around.get(t, 0) + 1
        silent += tag in SILENT
    flush()
    return out


def weak_label(block: Block) -> bool:
    """Whether the names on the path make the block part of the article; without any, whether it reads like prose."""
    if BAD.intersection(block.path):
        return False
    inside = bool(GOOD.intersection(block.path))
    if ("header" in block.path or ".header" in block.path) and not inside:
        return False
    return inside or (len(block.text) > 60 and block.linked < 0.3)


@dataclass(frozen=True)
class Labeller:
    """``pages`` of at most ``page_chars`` are the bounded training sample; the network has ``hidden`` cells per direction."""

    pages: int = 300
    page_chars: int = 60_000
    hidden: int = 24
    path_rows: int = 2048
    path_size: int = 24
    word_size: int = 16
    steps: int = 500
    batch: int = 16
    span: int = 40
    rate: float = 0.01
    seed: int = 3


def _hash(token: str, rows: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % rows


def _word_vector(text: str, size: int) -> np.ndarray:
    """Signed hash of a block's words, scaled to length 1; long blocks are described by all their words."""
    out = np.zeros(size, np.float32)
    for word in text.split():
        h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        out[h % size] += 1 if h & 0x10000 else -1
    return out / max(1.0, float(np.sqrt((out * out).sum())))


def _numbers(block: Block) -> list[float]:
    text, n = block.text, len(block.text)
    marks = sum(text.count(c) for c in ".,;:!?")
    return [min(1.0, np.log1p(n) / 8), block.linked, min(1.0, 20 * marks / n), float(text[-1] in ".!?"), min(1.0, text.count(" ") / 40), 1.0]


def describe(page: list[Block], spec: Labeller, words: dict[str, np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed path tokens and the other inputs of every block. ``words`` remembers word vectors, for training."""
    words = {} if words is None else words
    for b in page:
        if b.text not in words:
            words[b.text] = _word_vector(b.text, spec.word_size)
    paths = [np.unique([_hash(t, spec.path_rows) for t in b.path]) for b in page]
    rest = np.array([np.concatenate([words[b.text], _numbers(b)]) for b in page], np.float32)
    return paths, rest


class Network:
    """Bidirectional LSTM with one logit per block, in numpy."""

    def __init__(self, spec: Labeller):
        r = np.random.default_rng(spec.seed)
        h, d = spec.hidden, spec.path_size + spec.word_size + 6
        scale = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.spec = spec
        self.weights = {"path": (r.normal(size=(spec.path_rows, spec.path_size)) * 0.3).astype(np.float32), "out": scale(2 * h + d, 1), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.weights |= {f"{way}x": scale(d, 4 * h), f"{way}h": scale(h, 4 * h), f"{way}b": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def inputs(self, pages: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded input ``(page, place, feature)`` and the mask of real blocks."""
        longest = max(len(p) for p, _ in pages)
        x = np.zeros((len(pages), longest, self.spec.path_size + self.spec.word_size + 6), np.float32)
        mask = np.zeros((len(pages), longest), np.float32)
        for i, (paths, rest) in enumerate(pages):
            sizes = np.array([len(p) for p in paths])
            rows = self.weights["path"][np.concatenate(paths)]
            x[i, : len(paths), : self.spec.path_size] = np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            x[i, : len(paths), self.spec.path_size :] = rest
            mask[i, : len(paths)] = 1
        return x, mask

    def _pass(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        w, h = self.weights, self.spec.hidden
        n, t, _ = x.shape
        pre = x @ w[f"{way}x"] + w[f"{way}b"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, saved = np.zeros((n, t, h), np.float32), []
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            z = pre[:, i] + state @ w[f"{way}h"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            new = np.tanh(z[:, 3 * h :])
            m = mask[:, i, None]
            # in, forget, out; padding keeps the state as it is
            after = m * (gates[:, h : 2 * h] * cell + gates[:, :h] * new) + (1 - m) * cell
            squashed = np.tanh(after)
            if keep:
                saved.append((i, state, cell, gates, new, squashed))
            state = m * (gates[:, 2 * h :] * squashed) + (1 - m) * state
            cell = after
            out[:, i] = state
        return out, saved

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        joined = np.concatenate([self._pass(x, mask, way, False)[0] for way in "fb"] + [x], 2)
        return (joined @ self.weights["out"])[..., 0] + self.weights["bias"]

    def gradients(self, pages, labels: np.ndarray) -> dict[str, np.ndarray]:
        x, mask = self.inputs(pages)
        w, h = self.weights, self.spec.hidden
        passes = {way: self._pass(x, mask, way, True) for way in "fb"}
        joined = np.concatenate([passes["f"][0], passes["b"][0], x], 2)
        p = 1 / (1 + np.exp(-np.clip((joined @ w["out"])[..., 0] + w["bias"], -30, 30)))
        d = ((p - labels) * mask / mask.sum())[..., None].astype(np.float32)
        grads = {"out": np.einsum("ntk,nto->ko", joined, d), "bias": d.sum((0, 1))}
        back = d @ w["out"].T
        dx = back[..., 2 * h :].copy()
        for k, way in enumerate("fb"):
            dz = np.zeros((*mask.shape, 4 * h), np.float32)
            ds, dc = np.zeros((len(mask), h), np.float32), np.zeros((len(mask), h), np.float32)
            gh = np.zeros_like(w[f"{way}h"])
            for i, state, cell, gates, new, squashed in reversed(passes[way][1]):
                m = mask[:, i, None]
                ds = ds + back[:, i, k * h : (k + 1) * h]
                a, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                do = m * ds * squashed * o * (1 - o)
                dcell = dc + m * ds * o * (1 - squashed**2)
                z = np.concatenate([m * dcell * new * a * (1 - a), m * dcell * cell * f * (1 - f), do, m * dcell * a * (1 - new**2)], 1)
                dz[:, i] = z
                gh += state.T @ z
                dc = dcell * (m * f + (1 - m))
                ds = z @ w[f"{way}h"].T + (1 - m) * ds
            grads |= {f"{way}h": gh, f"{way}x": np.einsum("ntd,ntk->dk", x, dz), f"{way}b": dz.sum((0, 1))}
            dx += dz @ w[f"{way}x"].T
        table = np.zeros_like(w["path"])
        sizes = np.array([len(rows) for paths, _ in pages for rows in paths])
        page = np.repeat(np.arange(len(pages)), [len(paths) for paths, _ in pages])
        place = np.concatenate([np.arange(len(paths)) for paths, _ in pages])
        each = dx[page, place, : self.spec.path_size] / np.sqrt(sizes)[:, None]
        np.add.at(table, np.concatenate([rows for paths, _ in pages for rows in paths]), np.repeat(each, sizes, 0))
        return grads | {"path": table}


def redress(page: list[Block], spare: list[Block], r: np.random.Generator) -> list[Block]:
    """The page in another dress: other names for its containers and more boilerplate made of other pages' blocks."""
    pick = lambda names: [t for e in str(r.choice(names)).split() for t in name_tokens(e)]
    outer = pick(PAGE) if r.random() < 0.6 else []
    outer = [t for t in outer if t]
    inner = pick(ARTICLE)
    if r.random() < 0.15:  # a name that says nothing
        inner = name_tokens("div." + "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)))
    body = [b for b in page if b.label]
    leaf = lambda b: [t for t in b.path if t.startswith("leaf:")]
    out: list[Block] = []

    def boilerplate(kind: str) -> None:
        names = pick(KINDS[kind])
        inside = inner if kind in ("advert", "side", "share", "comments", "form", "notice") and r.random() < 0.6 else []
        for b in r.choice(len(spare), int(r.integers(1, 6))):
            block = spare[b]
            tag = str(r.choice(["p", "div", "li", "span", "h3", "td"]))
            text = block.text if kind == "comments" or r.random() < 0.4 else " ".join(block.text.split()[: int(r.integers(1, 9))])
            linked = float(r.choice([0.0, 0.0, 1.0])) if kind != "menu" else float(r.random() < 0.8)
            out.append(Block(["html", "body", *outer, *inside, *names, tag, f"leaf:{tag if tag != 'span' else 'div'}"], text, linked, False))

    for kind in ("notice", "header", "menu", "advert"):
        if r.random() < 0.5:
            boilerplate(kind)
    if r.random() < 0.15:
        boilerplate("side")
    for i, b in enumerate(body):
        tag, text = leaf(b)[0][5:] or "p", b.text
        head = ["header"] if i == 0 and r.random() < 0.2 else []
        if i and r.random() < 0.25:  # lists, headings, quotes and tables belong to the article as well
            head = [[], ["ul"], ["ol"], ["blockquote"], ["table", "tr"], ["figure"]][int(r.integers(6))]
            tag = {"ul": "li", "ol": "li", "blockquote": "p", "table": "td", "figure": "figcaption"}.get(head[0], "h2") if head else str(r.choice(["h2", "h3", "div", "pre"]))
            text = " ".join(text.split()[: int(r.integers(1, 40))])
        out.append(Block(["html", "body", *outer, *inner, *head, tag, f"leaf:{tag}"], text, b.linked if r.random() < 0.8 else float(r.random()), True))
        if r.random() < 0.06:
            boilerplate(str(r.choice(["advert", "share", "side", "form", "notice"])))
    for kind in ("share", "comments", "side", "form", "notice", "advert", "menu", "footer"):
        if r.random() < 0.45:
            boilerplate(kind)
    return out


def train(pages: list[str], spec: Labeller) -> Network:
    """Train on pages with weak labels, half of the time in other dress."""
    network = Network(spec)
    known = []
    for page in pages:
        found = blocks(page)
        for b in found:
            b.label = weak_label(b)
        if found:
            known.append(found)
    if not known:
        return network
    r = np.random.default_rng(spec.seed)
    spare = [b for page in known for b in page]
    words: dict[str, np.ndarray] = {}
    mean = {k: np.zeros_like(v) for k, v in network.weights.items()}
    square = {k: np.zeros_like(v) for k, v in network.weights.items()}
    for step in range(1, spec.steps + 1):
        batch, labels = [], np.zeros((spec.batch, spec.span), np.float32)
        for i in range(spec.batch):
            page = known[int(r.integers(len(known)))]
            if r.random() < 0.75:
                page = redress(page, spare, r)
            start = int(r.integers(max(1, len(page) - spec.span + 1)))
            page = page[start : start + spec.span]
            batch.append(describe(page, spec, words))
            labels[i, : len(page)] = [b.label for b in page]
        grads = network.gradients(batch, labels[:, : max(len(p) for p, _ in batch)])
        rate = spec.rate * min(1.0, 2 * (1 - step / (spec.steps + 1)))
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            network.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def main_text(pages: list[str | None], network: Network, batch: int = 64) -> list[str]:
    """The texts of the blocks labelled as article, joined by blank lines."""
    found = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    start = 0
    while start < len(order):
        own = order[start : start + batch]
        # few long pages at a time
        own = own[: max(1, 40_000 // len(found[own[-1]]))]
        start += len(own)
        x, mask = network.inputs([describe(found[i], network.spec) for i in own])
        keep = network.logits(x, mask) > 0
        for row, i in enumerate(own):
            out[i] = "\n\n".join(b.text for b, k in zip(found[i], keep[row]) if k)
    return out


def fit(pages: DataFrame, spec: Labeller = Labeller()) -> Network:
    """Train on a bounded sample of pages, drawn by a hash of their text."""
    chosen = pages.where(F.length("html") <= spec.page_chars).select(F.xxhash64("html").alias("h")).distinct().orderBy(F.xxhash64("h", F.lit(1)), "h").limit(spec.pages)
    sample = pages.select("html", F.xxhash64("html").alias("h")).join(F.broadcast(chosen), "h", "left_semi").select("html").distinct()
    return train(sorted(sample.toPandas()["html"]), spec)


def extract(pages: DataFrame, spec: Labeller = Labeller()) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; ``text`` is empty if there is none.

    A null or empty page has no blocks. Repeated rows get equal results; an empty
    table gives none (and trains nothing); other columns are ignored. Pages of any
    length are read whole.
    """
    network = fit(pages, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = main_text(part.column("html").to_pylist(), network)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
