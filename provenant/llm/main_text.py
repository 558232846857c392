"""The main text of web pages, by the distribution of text over lines.

A page is cut into lines: a block's text is one, and where a container begins or ends there is an empty one. Lines that
are no article by their markup (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts) are
empty, too. The lengths of ``WINDOW`` lines from each line on are summed. A line where the sum surges to ``SURGE``
characters begins a passage, and one where it dives to nothing ends it; the text between is kept. So a short line
stays if its neighbours are text, and goes if it stands alone between empty ones.

* The title, a first heading, is worth a surge.
* On a page with an article (``article`` or ``main``) only lines in it count, and any text there is a surge.
* On others a line that is mostly links has no length. It stays where it stands between lines of text.
* A page on which nothing surges keeps its largest passage.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provenant.llm.shared import free_name, with_field

WINDOW = 3
SURGE = 80

#: Markup: comments, elements without markup inside, declarations, tags. A quote counts only after an equals sign.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is a line of its own; those of the second list are containers, too.
_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address tr td th caption figcaption hr summary legend center option".split())
_CONTAINER = frozenset("html body main article section div aside nav header footer form ul ol dl table blockquote figure fieldset details dialog menu search hgroup".split())
#: Elements that end where the next of its kind begins, and the containers that bound them.
_ENDS = {**dict.fromkeys("p h1 h2 h3 h4 h5 h6".split(), {"p"}), "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
#: Elements that are never of the article.
_DROPPED = frozenset("head nav aside footer form dialog menu search button select datalist svg canvas audio video object map progress meter".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id that name something else than the article.
_HINTS = frozenset(
    "nav navbar navigation menu submenu topbar header masthead footer sidebar aside ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond reply replies related recommended recommendations breadcrumb breadcrumbs pagination pager search widget toolbar skip".split()
)
_COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: Where the title of an article may stand.
_OWN = frozenset("article post entry content story".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")


def _foreign(name: str, attributes: str, in_article: bool, hints: bool) -> bool:
    """Whether an element is no part of an article."""
    if name in _DROPPED or name == "header" and not in_article:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if hints and key in ("class", "id") and name not in ("html", "body", "main"):
            for part in value.split():
                words = re.findall("[a-z]+", part.lower())
                words += [w.lower() for w in _WORD.findall(part)]  # sideBar
                if words[:1] in (["has"], ["no"], ["with"]):
                    continue
                if in_article or not _OWN.isdisjoint(words):
                    words = [w for w in words if w != "header"]
                if not (_COMMENTS if name == "article" or name[0] == "h" and name[1:].isdigit() else _HINTS).isdisjoint(words):
                    return True
    return False


class Line(NamedTuple):
    text: str = ""
    linked: int = 0  #: characters in links
    in_article: bool = False
    title: bool = False


def page_lines(page: str, hints: bool = True) -> list[Line]:
    """The lines of a page; empty ones where containers begin and end."""
    lines: list[Line] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, foreign, of an article
    links = 0

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                lines.append(Line(line, len(" ".join("".join(linked).split())), bool(stack) and stack[-1][2], any(e[0] == "h1" for e in stack)))
            text.clear()
            linked.clear()

    def gap() -> None:
        flush()
        lines.append(Line())

    def close(to: int) -> None:
        """Leaves all elements from this place of the stack on."""
        nonlocal links
        while len(stack) > to:
            name = stack[-1][0]
            within = len(stack) > 1 and stack[-2][1]
            if name in _CONTAINER and not within:
                gap()
            elif name in _BLOCK and not within:
                flush()
            links -= name == "a"
            stack.pop()

    def say(raw: str) -> None:
        if raw and not (stack and stack[-1][1]):
            raw = html.unescape(raw)
            text.append(raw)
            if links:
                linked.append(raw)

    at = 0
    for m in _MARKUP.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("table", "body", "html") and name not in ("table", "body", "html"):
                    break
            else:
                if name in _BLOCK:
                    flush()
            continue
        within, of_article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in ("br", "hr"):
            if not within:
                flush() if name == "hr" else text.append(" ")
            continue
        if name in _VOID:
            continue
        ends = _ENDS.get(name, {"p"} if name in _CONTAINER or name in _BLOCK else None)
        if ends:
            k = len(stack)
            while k and stack[k - 1][0] not in _CONTAINER:
                k -= 1
            for j in range(k, len(stack)):
                if stack[j][0] in ends:
                    close(j)
                    break
            within, of_article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        foreign = within or _foreign(name, m[4], of_article, hints)
        if not within:
            if name in _CONTAINER:
                gap()
            elif name in _BLOCK:
                flush()
        stack.append((name, foreign, of_article or name in ("article", "main")))
        links += name == "a"
    rest = page[at:]
    cut = re.compile("<[a-zA-Z/!?]").search(rest, rest.rfind(">") + 1)  # a tag that never ends
    say(rest[: cut.start()] if cut else rest)
    flush()
    return lines


def between(lengths: np.ndarray, surge: int) -> np.ndarray:
    """Which lines stand between a surge and the dive after it, by the sums over ``WINDOW`` lines from each on."""
    n = len(lengths)
    kept = np.zeros(n, bool)
    if not lengths.any():
        return kept
    upto = np.concatenate([[0], np.cumsum(lengths)])
    sums = upto[np.minimum(np.arange(n) + WINDOW, n)] - upto[:-1]
    surge = min(surge, int(sums.max()))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        high = np.flatnonzero(sums[begin:end] >= surge)
        if len(high):
            # the line of a surge may still be empty; the last sum above nothing begins at the last line with text
            kept[begin + int(high[0]) : end] = True
    return kept


def main_text(page: str) -> str:
    """The blocks of a page's article, one a line."""
    for hints in (True, False):  # a page that is all menu by its class names is read without them
        lines = page_lines(page, hints)
        if any(line.text for line in lines):
            break
    sizes = np.array([len(line.text) for line in lines], np.int64)
    marked = np.array([line.in_article for line in lines], bool)
    if sizes[marked].any():
        kept = between(np.where(marked, sizes, 0), 1) & marked
    else:
        links = np.array([line.linked for line in lines], np.int64)
        title = np.array([line.title for line in lines], bool) & (sizes > 0)
        kept = between(np.where(title, np.maximum(sizes, SURGE), np.where(2 * links > sizes, 0, sizes)), SURGE)
    return "\n".join(line.text for line, k in zip(lines, kept.tolist(), strict=True) if k and line.text)


def extract(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with a column of the main text of their markup, and ``n_chars`` of its code points.

    A null page is an empty one; a page without text has an empty string. Further columns and repeated rows are
    kept as they are, but a column that has the name of a new one is replaced; an empty table gives no rows. Rows
    are taken one at a time, each whole, so memory is that of the longest page.
    """
    pages = pages.withColumnRenamed(column, source := free_name(pages, "_markup")).drop(to, "n_chars")
    schema = with_field(pages.drop(source), to, "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(source)]
            rest = batch.drop_columns([source])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest.schema.names, to, "n_chars"])

    return pages.mapInArrow(run, schema)
