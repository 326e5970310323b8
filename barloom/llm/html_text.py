"""Main text of HTML pages by a recurrent block labeller.

A page becomes its leaf blocks in order: runs of text with no block-level tag
between them. Each block has a vector of its tag path (elements, classes, ids and
roles above it) and one of its hashed words and shape; a bidirectional LSTM in
numpy reads the blocks of a page in order and labels each as article or not from
all of them. Scripts, styles, form controls and the head hold no blocks.

There are no labelled pages, so the network learns from at most ``SAMPLE_PAGES``
whole pages of the table, of ``SAMPLE_CHARS`` characters at most, labelled where semantic containers decide (article and main
against nav, aside, footer, comments and so on), and from generated layouts whose
labels are known and whose article is marked in other ways or not at all.

Defined results: a null or empty html, and a page without article, give an empty
text and 0 characters; repeated rows are extracted alike; a table without pages
trains on the generated layouts alone.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.storage import small_batches
from barloom.llm.text import LOWER, spans, word_hashes

SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES = 192, 60_000, 640
PATH, WORDS, SHAPE, HIDDEN, EPOCHS, SEED = 64, 12, 6, 16, 40, 11
SIZE = PATH + WORDS + SHAPE
#: Padded blocks to a batch of several pages, and steps whose inputs are projected at once.
SLOTS, STRETCH = 1 << 14, 1 << 12

_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
#: The rest of a tag, with quoted values that may hold ">".
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that do not end a block, that hold no text, that never close, and those that end an open one of their kind.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template svg math head iframe object canvas audio video select option textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an open head may hold; any other start tag, or text, ends it.
HEAD = frozenset("html head title meta link base basefont bgsound noframes script style noscript template".split())
_RAW = {x: re.compile(rf"</{x}\b[^>]*>", re.I) for x in ("script", "style", "textarea", "noscript", "iframe", "title")}
ENDS = {"p": "p", "li": "li", "tr": "tr", "td": "td", "th": "th", "dt": "dt", "dd": "dd", "option": "option"}
CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: Words of paths that mark what is no article, and what is.
NOT_ARTICLE = frozenset(
    "nav aside footer header form menu sidebar ad ads advert advertisement banner cookie consent notice comment comments reply share social related promo "
    "breadcrumb breadcrumbs pagination widget newsletter subscribe popup modal copyright login search toolbar dialog".split()
)
ARTICLE = frozenset("article main".split())


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, lower-case name (empty for comments and the like), whether it closes, attributes of each tag, in one pass.

    A tag whose quotes never close ends at the first ">", and so do all tags after it.
    """
    at, quoted = html.find("<"), True
    while at >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(html)
            yield at, end, "", False, ""
        elif m := _NAME.match(html, at):
            rest = _REST.match(html, m.end()) if quoted else None
            quoted = rest is not None
            end = rest.end() if rest else html.find(">", m.end()) + 1
            if not end:
                return
            yield at, end, m[1].lower(), html[at + 1] == "/", html[m.end() : end - 1]
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at) + 1
            if not end:
                return
            yield at, end, "", False, ""
        else:
            end = at + 1
        at = html.find("<", end)


class Node:
    """An open element that shapes the path below it; what features and labels need of the path is kept from node to node."""

    __slots__ = ("key", "up", "fresh", "words", "inner", "bad", "header", "aside")

    def __init__(self, up: Node | None, words: tuple[str, ...], fresh: tuple[str, ...]):
        self.key = hash((up.key if up else 0, words))
        self.up, self.words, self.fresh = up, words, fresh
        self.inner, self.bad, self.header, self.aside = (up.inner, up.bad, up.header, up.aside) if up else (False,) * 4
        if self.inner:
            self.header |= "header" in words
            self.bad |= any(w in NOT_ARTICLE and w != "header" for w in words)
        elif words and words[0] in ARTICLE:
            self.inner, self.bad = True, self.aside
        else:
            self.aside |= bool(words) and words[0] in ("nav", "aside", "footer")

    @property
    def article(self) -> bool:
        return self.inner and not self.bad and not (self.header and self.words[0] not in ("h1", "h2"))


ROOT = Node(None, (), ())


class Open:
    """The open elements, with where each kind stands."""

    SCOPES = ("ul", "ol", "table", "dl", "select")

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes = [ROOT]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.words: Counter[str] = Counter()
        self.silent = 0

    def push(self, name: str, words: tuple[str, ...]) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.silent += name in SILENT
        if words:
            fresh = tuple(w for w in dict.fromkeys(words) if not self.words[w])
            self.words.update(words)
            self.nodes.append(Node(self.nodes[-1], words, fresh))
        else:
            self.nodes.append(self.nodes[-1])

    def pop(self, to: int) -> None:
        while len(self.names) > to:
            name, node = self.names.pop(), self.nodes.pop()
            self.places[name].pop()
            self.silent -= name in SILENT
            if name not in INLINE:
                self.blocks.pop()
            if node is not self.nodes[-1]:
                self.words.subtract(node.words)

    def last(self, name: str) -> int:
        return self.places[name][-1] if self.places.get(name) else -1

    def end(self, name: str) -> None:
        """Close an element that ``name`` ends: a paragraph with only inline elements open in it, others within their list or table."""
        at = self.last(name)
        if at >= 0 and (at == self.blocks[-1] if name == "p" else at > max(self.last(x) for x in self.SCOPES)):
            self.pop(at)

    def top(self) -> str:
        return self.names[-1] if self.names else ""


_SPACES = " \t\n\f\r"


def blocks(html: str) -> list[tuple[Node, str]]:
    """(node, text) of each leaf block of a page, in time that grows with its length alone."""
    out: list[tuple[Node, str]] = []
    opened, held, node, pos = Open(), [], ROOT, 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((node, text))
            held.clear()

    def text_until(end: int) -> None:
        nonlocal node
        if end > pos and opened.top() == "head" and html[pos:end].strip(_SPACES):
            opened.pop(len(opened.names) - 1)
        if end > pos and not opened.silent:
            if not held:
                node = opened.nodes[-1]
            held.append(html[pos:end])

    for start, end, name, closing, attributes in tags(html):
        if start < pos:
            continue
        text_until(start)
        pos = end
        if not name:
            continue
        if not closing and opened.top() == "head":
            if name in ("html", "head"):
                continue
            if name not in HEAD:
                opened.pop(len(opened.names) - 1)
        if name not in INLINE:
            flush()
        elif name in ("br", "img", "wbr"):
            if held:
                held.append(" ")
            continue
        if closing:
            if opened.last(name) >= 0:
                opened.pop(opened.last(name))
            continue
        if name in CLOSE_P or name in ENDS:
            opened.end("p" if name in CLOSE_P else ENDS[name])
        if name == "body":
            opened.pop(0)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if name in _RAW:
            found = _RAW[name].search(html, pos)
            pos = found.end() if found else len(html)
            continue
        words = () if name in INLINE else (name,)
        for _, a, b, c in _MARK.findall(attributes) if attributes and words else ():
            words += tuple(w for w in re.split(r"[^a-z]+", (a or b or c).lower()) if w)
        opened.push(name, words)
    text_until(len(html))
    flush()
    return out


def path_node(path: str) -> Node:
    """The node of a path of steps, each an element and words of its class, id and role."""
    opened = Open()
    for step in path.split("/"):
        opened.push(step.split()[0], tuple(step.split()))
    return opened.nodes[-1]


_PLANES = np.random.default_rng(SEED).standard_normal((4096, PATH)).astype(np.float32)
_SUMS: dict[int, np.ndarray] = {ROOT.key: np.zeros(PATH, np.float32)}
_VECTORS: dict[int, np.ndarray] = {}


def _plane(word: str) -> np.ndarray:
    return _PLANES[zlib.crc32(word.encode()) % 4096]


def path_vector(node: Node) -> np.ndarray:
    """Sum of random vectors of the hashed elements and words of the path, the last element apart."""
    if (v := _VECTORS.get(node.key)) is None:
        if len(_SUMS) > 50_000:
            _SUMS.clear()
            _VECTORS.clear()
            _SUMS[ROOT.key] = np.zeros(PATH, np.float32)
        chain, at = [], node
        while at.key not in _SUMS:
            chain.append(at)
            at = at.up
        total = _SUMS[at.key]
        for at in reversed(chain):
            total = _SUMS[at.key] = sum((_plane(w) for w in at.fresh), total)
        v = _VECTORS[node.key] = np.tanh(sum((_plane(f"last:{w}") for w in sorted(set(node.words))), total))
    return v


def features(leaves: list[tuple[Node, str]]) -> np.ndarray:
    """Vectors of the blocks of a page: path, hashed words, shape."""
    out = np.zeros((len(leaves), SIZE), np.float32)
    texts = [text.encode() for _, text in leaves]
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    at[-1] = len(data)
    starts, ends, before = spans(data, at)
    n_words = np.diff(before)
    block = np.repeat(np.arange(len(leaves)), n_words)
    slot = (word_hashes(data, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    bag = np.bincount(block * WORDS + slot, minlength=len(leaves) * WORDS).reshape(-1, WORDS)
    out[:, PATH : PATH + WORDS] = bag / (np.linalg.norm(bag, axis=1, keepdims=True) + 1e-6)
    for i, (node, text) in enumerate(leaves):
        out[i, :PATH] = path_vector(node)
        words = max(1, int(n_words[i]))
        marks = text.count(".") + text.count(",")
        out[i, PATH + WORDS :] = (np.log1p(len(text)) / 8, words / (words + 20), marks / words, text[-1] in ".!?", i / len(leaves), 1.0)
    return out


class Labeller:
    """Bidirectional LSTM; each direction has its own weights, both states feed one logistic unit."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": draw(SIZE, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.w |= {"o": draw(2 * HIDDEN + SIZE, 1)[:, 0], "ob": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, inside: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, pages, hidden) of one direction; x and inside are in its reading order."""
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out = np.empty((steps, pages, HIDDEN), np.float32)
        for t in range(steps):
            if t % STRETCH == 0:
                pre = x[t : t + STRETCH] @ self.w[f"x{d}"] + self.w[f"c{d}"]
            z = pre[t % STRETCH] + h @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            here = inside[t][:, None]
            new_c = np.where(here, f * c + i * g, c)
            tc = np.tanh(new_c)
            new_h = np.where(here, o * tc, h)
            if keep is not None:
                keep.append((h, c, i, f, o, g, tc, here))
            h, c = new_h, new_c
            out[t] = h
        return out

    def scores(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        forward = self._run(x, inside, "f")
        backward = self._run(x[::-1], inside[::-1], "b")[::-1]
        o = self.w["o"]
        return forward @ o[:HIDDEN] + backward @ o[HIDDEN : 2 * HIDDEN] + x @ o[2 * HIDDEN :] + self.w["ob"]

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> float:
        """Adam on batches of pages of like length; accuracy of the last epoch."""
        pages = sorted(pages, key=lambda p: len(p[1]))
        batches = [padded([pages[k] for k in own]) for own in dealt([len(p[1]) for p in pages], 64)]
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step, right, total = 0, 0, 1
        for epoch in range(EPOCHS):
            right = total = 0
            for x, inside, y in batches:
                grad, hits = self._gradient(x, inside, y)
                right, total, step = right + hits, total + int(inside.sum()), step + 1
                rate = 0.01 if epoch < EPOCHS * 3 // 4 else 0.003
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return right / max(1, total)

    def _gradient(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
        kept: dict[str, list] = {"f": [], "b": []}
        forward = self._run(x, inside, "f", kept["f"])
        backward = self._run(x[::-1], inside[::-1], "b", kept["b"])[::-1]
        seen = np.concatenate((forward, backward, x), axis=2)
        z = seen @ self.w["o"] + self.w["ob"]
        p = 1 / (1 + np.exp(-z))
        dz = np.where(inside, p - y, 0).astype(np.float32) / max(1, inside.sum())
        grad = {"o": np.tensordot(dz, seen, ([0, 1], [0, 1])), "ob": np.array([dz.sum()], np.float32)}
        ds = dz[..., None] * self.w["o"][: 2 * HIDDEN]
        for d, up, own in (("f", ds[..., :HIDDEN], x), ("b", ds[::-1, :, HIDDEN:], x[::-1])):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            gate = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            for t in range(x.shape[0] - 1, -1, -1):
                h, c, i, f, o, g, tc, here = kept[d][t]
                dh = dh + up[t]
                own_dh = np.where(here, dh, 0)
                new_dc = np.where(here, dc, 0) + own_dh * o * (1 - tc * tc)
                da = np.concatenate((new_dc * g * i * (1 - i), new_dc * c * f * (1 - f), own_dh * tc * o * (1 - o), new_dc * i * (1 - g * g)), axis=1)
                gate[t] = da
                gh += h.T @ da
                dh = np.where(here, 0, dh) + da @ self.w[f"h{d}"].T
                dc = np.where(here, new_dc * f, dc)
            grad |= {f"x{d}": np.tensordot(own, gate, ([0, 1], [0, 1])), f"h{d}": gh, f"c{d}": gate.sum(axis=(0, 1))}
        return grad, int((((z > 0) == (y > 0.5)) & inside).sum())


def dealt(sizes: list[int], most: int) -> list[list[int]]:
    """Numbers of the pages, shortest first, at most ``most`` to a batch and SLOTS padded blocks, or one page."""
    out: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if not out or len(out[-1]) >= most or sizes[k] * (len(out[-1]) + 1) > SLOTS:
            out.append([])
        out[-1].append(k)
    return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x, y = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), np.float32)
    inside = np.zeros((steps, len(pages)), bool)
    for k, (a, b) in enumerate(pages):
        x[: len(b), k], y[: len(b), k], inside[: len(b), k] = a, b, True
    return x, inside, y


def semantic_labels(leaves: list[tuple[Node, str]]) -> np.ndarray | None:
    """1 for article blocks, where the page has an article or main element; else None."""
    if not any(node.inner for node, _ in leaves):
        return None
    return np.array([float(node.article) for node, _ in leaves])


def made_pages(n: int = MADE_PAGES) -> list[tuple[list[tuple[Node, str]], np.ndarray]]:
    """Layouts with known labels: (blocks, labels)."""
    rng = np.random.default_rng(SEED)
    letters = np.array(list("etaoinshrdlucmfwypvbgk"))
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b))).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])
    pick = lambda *x: x[rng.integers(len(x))]
    pages = []
    for _ in range(n):
        leaves: list[tuple[Node, str]] = []
        label: list[int] = []

        def add(path: str, low: int, high: int, good: int, times: int = 1, leaves: list = leaves, label: list = label) -> None:
            for _ in range(times):
                leaves.append((path_node(path), say(low, high)))
                label.append(good)

        root = pick("html/body", "html/body", "html/body/div wrapper", "html/body/div page", "html/body/div id container")
        some = lambda p: rng.random() < p
        if some(0.6):
            add(f"{root}/{pick('header', 'div header', 'header site header', 'div top bar')}/{pick('p', 'div', 'h1', 'a')}".removesuffix("/a"), 1, 8, 0, rng.integers(1, 3))
        if some(0.8):
            add(f"{root}/{pick('nav', 'nav', 'div menu', 'div nav', 'header/nav', 'ul menu', 'div navigation')}/ul/li", 1, 3, 0, rng.integers(2, 8))
        if some(0.5):
            add(f"{root}/div {pick('ad', 'ads', 'advert', 'banner', 'promo', 'advertisement', 'sponsored')}", 2, 16, 0)
        if some(0.3):
            add(f"{root}/div {pick('cookie notice', 'notice', 'cookie banner', 'consent', 'alert')}/{pick('p', 'div')}", 4, 24, 0)
        hold = pick("article", "article", "article", "main", "main/article", "article post", "div content", "div id content", "div article body", "div main", "div post", "section", "div entry content", "div story")
        inner = f"{root}/{hold}"
        if some(0.8):
            add(f"{inner}/{pick('h1', 'h1', 'h2', 'header/h1')}", 3, 14, 1)
        for _ in range(rng.integers(1, 16)):
            kind = rng.random()
            if kind < 0.72:
                add(f"{inner}/{pick('p', 'p', 'p', 'div', 'section/p')}", *pick((1, 6), (5, 30), (20, 90), (60, 160)), 1)
            elif kind < 0.8:
                add(f"{inner}/{pick('h2', 'h3')}", 2, 9, 1)
            elif kind < 0.87:
                add(f"{inner}/{pick('ul', 'ol')}/li", 2, 14, 1, rng.integers(1, 5))
            elif kind < 0.9:
                add(f"{inner}/{pick('blockquote', 'blockquote/p', 'pre', 'table/tr/td', 'figure/figcaption')}", 4, 30, 1)
            elif kind < 0.95:
                add(f"{inner}/{pick('div ad', 'aside', 'aside/p', 'div share', 'div related/ul/li', 'div promo', 'div newsletter', 'aside related')}", 2, 18, 0)
        if some(0.5):
            place = pick(root, root, inner)
            add(f"{place}/{pick('section comments', 'div comments', 'div id comments', 'ol comment list/li', 'div comment')}/{pick('p', 'div comment', 'div comment/p', 'li', 'h3')}", 3, 40, 0, rng.integers(1, 6))
        if some(0.5):
            add(f"{root}/{pick('aside', 'aside sidebar', 'div sidebar', 'div id sidebar', 'div widget')}/{pick('p', 'ul/li', 'div', 'h3')}", 2, 22, 0, rng.integers(1, 6))
        if some(0.3):
            add(f"{root}/{pick('form', 'form search', 'div login/form', 'form subscribe')}/{pick('p', 'div', 'fieldset')}", 1, 9, 0, rng.integers(1, 3))
        if some(0.85):
            add(f"{root}/{pick('footer', 'footer', 'div footer', 'div id footer', 'footer site footer')}" + pick("", "", "/p", "/ul/li", "/div"), 3, 20, 0, rng.integers(1, 4))
        pages.append((leaves, np.array(label, float)))
    return pages


def fitted(pages: DataFrame) -> Labeller:
    """A labeller from the sample of ``pages`` and the generated layouts."""
    small = pages.filter(F.length("html") <= SAMPLE_CHARS)
    ids = [r[0] for r in small.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()]
    rows = small.filter(F.col("page_id").isin(ids)).select("page_id", "html").orderBy("page_id", "html").limit(2 * SAMPLE_PAGES).collect()
    known = []
    for r in sorted(rows, key=lambda r: (r["page_id"] or 0, r["html"])):
        leaves = blocks(r["html"])
        labels = semantic_labels(leaves)
        if leaves and labels is not None:
            known.append((features(leaves), labels))
    known += [(features(leaves), labels) for leaves, labels in made_pages()]
    model = Labeller()
    model.fit(known)
    return model


def _extract(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = batch.slice(i, 128)
                leaves = [blocks(h or "") for h in rows.column(2).to_pylist()]
                texts = [""] * len(leaves)
                some = [k for k, x in enumerate(leaves) if x]
                for batch_of in dealt([len(leaves[k]) for k in some], 32):
                    own = [some[j] for j in batch_of]
                    x, inside, _ = padded([(features(leaves[k]), np.zeros(len(leaves[k]))) for k in own])
                    good = (model.scores(x, inside) > 0) & inside
                    for n, k in enumerate(own):
                        texts[k] = "\n".join(t for (_, t), g in zip(leaves[k], good[: len(leaves[k]), n].tolist(), strict=True) if g)
                sizes = [len(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    small_batches(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id AS bigint) AS page_id", "url", "html")
    return rows.mapInArrow(_extract(fitted(rows)), "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
