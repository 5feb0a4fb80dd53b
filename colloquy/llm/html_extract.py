"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between tags that begin or end a block. Features of a block are its ancestors' tags,
the words of their class, id and role attributes, and shape of its text (length, links, punctuation). The field has two
labels, text and surroundings; its weights are fitted by gradient ascent on the likelihood of labelled pages, and a page is
decoded by Viterbi. The labelled pages are laid out by `labelled_pages` in many templates, so every block's label is known.

Defined cases: null, empty and textless html give an empty text; broken markup (unclosed elements, cut tags) is read to the
end, only an unclosed script or style hides the rest; a line break inside a block is white space; equal rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400
EPOCHS = 6

#: Elements by their role in a page.
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
            "h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
            "thead title tr ul".split())
RAW = set("script style title textarea noscript template iframe svg object".split())
TO_END = set("script style".split())  # without an end tag, all that follows is theirs; other raw elements are passed over as single tags
FOREIGN = set("svg object".split())  # may close themselves
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
BLANK = re.compile(r"[ \t\n\r\f\v]+")
ENDS = re.compile(r"[.!?…]")


def leaf_blocks(page: str) -> list[tuple[str, list[str]]]:
    """(text, features) of every leaf block with text, in page order."""
    out: list[tuple[str, list[str]]] = []
    stack: list[tuple[str, list[str]]] = []
    text: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        whole = BLANK.sub(" ", entities.unescape("".join(text))).strip(" ")
        if whole:
            out.append((whole, _features(whole, stack, linked / max(1, sum(map(len, text))))))
        text.clear()
        linked = 0

    open_raw: set[str] = set()
    at, n = 0, len(page)
    while at < n:
        m = MARK.search(page, at)
        piece = page[at:m.start() if m else n]
        text.append(piece)
        if in_link:
            linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in RAW and not closing:
            if name in FOREIGN and rest.endswith("/"):
                continue
            if name in open_raw:
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in TO_END:
                at = n
            else:
                open_raw.add(name)  # no end tag follows any later one either
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK and name not in BLOCK:
                    break
        elif name not in VOID and not rest.endswith("/"):
            for closes in (CLOSES.get(name, set()) if name in CLOSES else {"p"} if name in BLOCK else set(),):
                while stack and (stack[-1][0] in closes or (closes and stack[-1][0] not in BLOCK and any(t in closes for t, _ in stack[-8:]))):
                    stack.pop()
            words = [w for g in NAMES.findall(rest) for w in PARTS.findall("".join(g).lower())] if rest else []
            stack.append((name, words))
        in_link = sum(t == "a" for t, _ in stack)
    flush()
    return out


def _features(text: str, stack: list[tuple[str, list[str]]], linked: float) -> list[str]:
    size, words = len(text), text.count(" ") + 1
    out = ["bias", f"len{min(8, int(math.log2(size + 1)))}", f"words{min(6, int(math.log2(words + 1)))}", f"link{int(4 * min(1.0, linked))}"]
    inner = [t for t, _ in stack if t in BLOCK]
    out.append("leaf=" + (inner[-1] if inner else "none"))
    out += {"in=" + t for t in inner if t not in ("html", "body", "div")}
    out += {"name=" + w for _, names in stack for w in names}
    if ENDS.search(text[-2:]):
        out.append("ends")
    if ENDS.search(text[:-1]):
        out.append("sentences")
    if text[0] in "©":
        out.append("copyright")
    return out


class Field:
    """Two-label chain: weight of a feature for the label text, and transition scores."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.step = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, pages: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(f, 0.0) for f in block) for block in pages]

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """Viterbi."""
        s, best, back = self.step, (0.0, 0.0), []
        for i, x in enumerate(self.scores(blocks)):
            if i == 0:
                best = (0.0, x)
                continue
            a, b = (best[0] + s[0][0], best[1] + s[1][0]), (best[0] + s[0][1], best[1] + s[1][1])
            back.append((int(a[1] > a[0]), int(b[1] > b[0])))
            best = (max(a), max(b) + x)
        label = int(best[1] > best[0])
        out = [label] if blocks else []
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def learn(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, seed: int = 0) -> None:
        """AdaGrad on the log-likelihood, by forward and backward sums, with a small penalty."""
        rng, square, square_step = random.Random(seed), {}, np.full((2, 2), 1e-3)
        for _ in range(epochs):
            for blocks, labels in rng.sample(pages, len(pages)):
                if not blocks:
                    continue
                x, step = np.array(self.scores(blocks)), np.array(self.step)
                n = len(x)
                node = np.stack([np.zeros(n), x], 1)
                fore, rear = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = node[0]
                for i in range(1, n):
                    fore[i] = np.logaddexp(fore[i - 1, 0] + step[0], fore[i - 1, 1] + step[1]) + node[i]
                for i in range(n - 2, -1, -1):
                    into = rear[i + 1] + node[i + 1]
                    rear[i] = np.logaddexp(step[:, 0] + into[0], step[:, 1] + into[1])
                total = np.logaddexp(*fore[-1])
                error = np.array(labels) - np.exp(fore[:, 1] + rear[:, 1] - total)
                slope = np.zeros((2, 2))
                for i in range(1, n):
                    slope -= np.exp(fore[i - 1][:, None] + step + (node[i] + rear[i])[None, :] - total)
                    slope[labels[i - 1], labels[i]] += 1
                for block, e in zip(blocks, error.tolist(), strict=True):
                    if abs(e) > 1e-4:
                        for f in block:
                            g = e - 1e-4 * self.weight.get(f, 0.0)
                            square[f] = square.get(f, 1e-3) + g * g
                            self.weight[f] = self.weight.get(f, 0.0) + 0.3 * g / math.sqrt(square[f])
                square_step += slope * slope
                self.step = (step + 0.3 * slope / np.sqrt(square_step)).tolist()


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, str]]:
    """(html, main text) of pages laid out at random from templates with known labels."""
    rng = random.Random(seed)
    syllables = "ka lo mi ter an der vo sel ru pha dé ön ní ást que tion ble ing".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    pick = rng.choice

    def sentence(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize() + pick(["." * 1] * 6 + ["!", "?"])

    def prose() -> str:
        text = " ".join(sentence(rng.randint(1, 18)) for _ in range(pick([1, 1, 2, 3, 5, 9])))
        return " ".join(w + pick(["###", "$$$", "&&&", "%%%"]) if rng.random() < 0.05 else w for w in text.split())

    def attribute(names: list[str]) -> str:
        return pick([f' class="{pick(names)}"', f' class="{pick(names)} {word()}"', f' id="{pick(names)}"'])

    def menu() -> str:
        links = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(2, 9)))
        links = pick([f"<ul>{links}</ul>", links.replace("<li>", "<span>").replace("</li>", "</span> ")])
        return pick([f"<nav>{links}</nav>", f"<nav{attribute(['main-nav', 'menu', 'breadcrumb'])}>{links}</nav>", f"<div{attribute(['nav', 'navbar', 'menu', 'navigation', 'breadcrumb'])}>{links}</div>"])

    def surroundings(kind: str) -> str:
        line = entities.escape(pick([sentence(rng.randint(1, 12)), prose(), " ".join(word() for _ in range(rng.randint(1, 5)))]))
        if kind == "menu":
            return menu()
        if kind == "header":
            return pick([f"<header><div>{line}</div>{menu()}</header>", f"<div{attribute(['header', 'masthead', 'banner', 'site-header'])}>{line}</div>", f"<header>{line}</header>"])
        if kind == "footer":
            line = pick(["&copy; " + word() + " &middot; ", "&copy; 2024 ", "", word() + ".example.com "]) + line
            return pick([f"<footer>{line}</footer>", f"<footer><p>{line}</p></footer>", f"<div{attribute(['footer', 'site-footer', 'copyright', 'colophon'])}><p>{line}</p></div>"])
        if kind == "side":
            inner = pick([f"<h3>{word()}</h3><p>{line}</p>", f"<p>{line}</p>", f"<ul><li><a href='#'>{line}</a></li></ul>"])
            return pick([f"<aside>{inner}</aside>", f"<div{attribute(['sidebar', 'widget', 'related', 'side'])}>{inner}</div>", f"<aside{attribute(['sidebar', 'related'])}>{inner}</aside>"])
        if kind == "notice":
            return f"<div{attribute(['cookie', 'cookie-notice', 'notice', 'consent', 'gdpr', 'banner', 'popup'])}><p>{line}</p><button>{word()}</button></div>"
        if kind == "advert":
            return f"<div{attribute(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo'])}>{pick([line, f'<p>{line}</p>', f'<a href=x>{line}</a>'])}</div>"
        if kind == "form":
            return pick([f"<form><label>{line}</label><input name=q><button>{word()}</button></form>", f"<form{attribute(['newsletter', 'search', 'subscribe'])}><p>{line}</p><select><option>{word()}</select></form>"])
        comments = "".join(pick([f"<p>{entities.escape(prose())}</p>", f"<div{attribute(['comment', 'comment-body', 'reply'])}><b>{word()}</b><p>{entities.escape(prose())}</p></div>",
                                 f"<li{attribute(['comment'])}>{entities.escape(prose())}</li>"]) for _ in range(rng.randint(1, 4)))
        return pick([f"<section{attribute(['comments', 'comment-list', 'discussion', 'responses'])}>{comments}</section>", f"<div{attribute(['comments', 'comment-list', 'disqus', 'replies'])}>{comments}</div>"])

    pages = []
    for _ in range(count):
        blocks = [sentence(rng.randint(1, 9))[: rng.randint(20, 90)].strip()] + [prose() for _ in range(rng.randint(1, 14))]
        body = []
        for i, b in enumerate(blocks):
            t = entities.escape(b, quote=False)
            if i == 0:
                body.append(pick([f"<h1>{t}</h1>", f"<h1>{t}</h1>", f"<header><h1>{t}</h1></header>", f"<h2 class='title'>{t}</h2>"]))
            else:
                body.append(pick([f"<p>{t}</p>"] * 6 + [f"<p><b>{t}<br>", f"<p>{t}", f"<blockquote>{t}</blockquote>", f"<ul><li>{t}</li></ul>", f"<h2>{t}</h2>", f"<p>{word()} <a href='#'>link</a> {t}</p>"]))
                if " <a href='#'>link</a> " in body[-1]:
                    blocks[i] = BLANK.sub(" ", entities.unescape(re.sub("<[^>]*>", "", body[-1])))
                if rng.random() < 0.04:
                    body.append(surroundings(pick(["advert", "form", "side"])))
        text = "".join(body)
        core = pick([f"<article>{text}</article>"] * 3 + [f"<main>{text}</main>", f"<main><article{attribute(['post', 'entry'])}>{text}</article></main>",
                    f"<div{attribute(['content', 'post-content', 'entry-content', 'article-body', 'main', 'story', 'post'])}>{text}</div>", f"<section{attribute(['content', 'article'])}>{text}</section>"])
        before = [surroundings(k) for k in rng.sample(["header", "menu", "notice", "advert", "form", "side"], rng.randint(0, 4))]
        after = [surroundings(k) for k in rng.sample(["comments", "side", "advert", "menu", "notice", "form"], rng.randint(0, 4))]
        if rng.random() < 0.8:
            after.append(surroundings("footer"))
        page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var x='<p>';</script></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"
        pages.append((page, "\n".join(blocks)))
    return pages


@functools.lru_cache(2)
def trained(count: int = TRAIN_PAGES, seed: int = 0) -> Field:
    """A field fitted to `count` labelled pages (the bound of the sample)."""
    examples = []
    for page, text in labelled_pages(count, seed):
        blocks, wanted, k = leaf_blocks(page), text.split("\n"), 0
        labels = []
        for t, _ in blocks:
            hit = k < len(wanted) and t == wanted[k]
            labels.append(int(hit))
            k += hit
        if k == len(wanted):
            examples.append(([f for _, f in blocks], labels))
    field = Field()
    field.learn(examples)
    return field


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    labels = field.decode([f for _, f in blocks])
    return "\n".join(t for (t, _), keep in zip(blocks, labels, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    field = field or trained()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h, field) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
