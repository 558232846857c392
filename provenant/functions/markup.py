"""What a page gives in one pass over its markup, without a tree.

All selectors of a plan are one automaton: a state for each compound of each selector, which an open element is in if it
fits and its predecessor is in the state before. States of the open elements are a stack of bit sets. Where an element
is in the last state of a selector, rows begin, fields take their text or an attribute, and scripts are cut out.
This runs inside Arrow batches of pages; nothing but its results leaves a page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

# Elements without an end, and the start tags that end an open element of the given name.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article form pre blockquote".split()), "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}
HIDDEN = frozenset({"script", "style", "noscript", "head"})

#: Comments, declarations, tags. A quote counts only after an equals sign.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style", "textarea", "title")}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag, the first of a name, with their references decoded."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        value = next(filter(None, values), "")
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


# ---------------------------------------------------------------- selectors

_PART = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)(?:=(\"[^\"]*\"|'[^']*'|[^\]]*))?\]|:nth-child\((\d+)\)|(\*)")


@dataclass(frozen=True)
class Compound:
    """What an element must have by itself."""

    name: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    values: tuple[tuple[str, str | None], ...] = ()
    nth: int | None = None

    def fits(self, place: int, found: dict[str, str]) -> bool:
        return (
            (self.nth is None or self.nth == place)
            and (self.id is None or found.get("id") == self.id)
            and all(k in found and (v is None or found[k] == v) for k, v in self.values)
            and (not self.classes or set(self.classes) <= set(found.get("class", "").split()))
        )

    @property
    def plain(self) -> bool:
        """Whether the name alone decides."""
        return not (self.id or self.classes or self.values or self.nth)


def compound(text: str) -> Compound:
    parts = list(_PART.finditer(text))
    if "".join(m[0] for m in parts) != text:
        raise ValueError(f"selector {text!r}")
    name = id_ = nth = None
    classes, values = [], []
    for sign, word, key, value, number, star in (m.groups() for m in parts):
        if number:
            nth = int(number)
        elif key:
            values.append((key.lower(), value.strip("\"'") if value is not None else None))
        elif sign == "#":
            id_ = word
        elif sign == ".":
            classes.append(word)
        elif not star:
            name = word.lower()
    return Compound(name, id_, tuple(classes), tuple(values), nth)


class Automaton:
    """Selectors of names, #id, .class, [attribute], [attribute=value], :nth-child(n), descent, > and commas."""

    def __init__(self, selectors: list[str]):
        #: Of each state: its compound, the bit of the state before (0 for none), whether that must be the parent, and its selectors.
        self.states: list[tuple[Compound, int, bool, int]] = []
        for k, selector in enumerate(selectors):
            for way in selector.split(","):
                steps = re.sub(r"\s*>\s*", " > ", way.strip()).split()
                before, child = 0, False
                for i, step in enumerate(steps):
                    if step == ">":
                        child = True
                        continue
                    self.states.append((compound(step), before, child, 1 << k if i == len(steps) - 1 else 0))
                    before, child = 1 << len(self.states) - 1, False
        self.by_name: dict[str, list[int]] = {}
        self.nameless = [i for i, s in enumerate(self.states) if s[0].name is None]
        for i, s in enumerate(self.states):
            if s[0].name:
                self.by_name.setdefault(s[0].name, sorted([*self.nameless, *(j for j, t in enumerate(self.states) if t[0].name == s[0].name)]))

    def step(self, name: str, raw: str, place: int, parent: int, above: int) -> tuple[int, int, dict[str, str] | None]:
        """(states, selectors, attributes if they were needed) of an element below one in ``parent``, and others in ``above``."""
        bits = found = 0
        attrs = None
        for i in self.by_name.get(name, self.nameless):
            c, before, child, selectors = self.states[i]
            if before and not before & (parent if child else above):
                continue
            if not c.plain:
                if attrs is None:
                    attrs = attributes(raw)
                if not c.fits(place, attrs):
                    continue
            bits |= 1 << i
            found |= selectors
        return bits, found, attrs


# ---------------------------------------------------------------- what is asked of a page


@dataclass(frozen=True)
class Rows:
    """A row for each match of ``row``, or one for the page; a field is the first match below of ``selector`` or ``selector@attribute``."""

    fields: dict[str, str]
    row: str | None = None


@dataclass(frozen=True)
class Texts:
    """The texts of all matches as they stand, e.g. scripts."""

    selector: str


@dataclass(frozen=True)
class Values:
    """An attribute of all matches that have something in it."""

    selector: str
    attribute: str


@dataclass(frozen=True)
class Facts:
    """Title, bytes of visible text, whether a refresh leads to a consent page, and which selectors match."""

    selectors: tuple[str, ...] = ()


@dataclass(frozen=True)
class Custom:
    """Rows that a function of the whole markup gives."""

    rows: Callable[[str], list[dict[str, object]]]


Ask = Rows | Texts | Values | Facts | Custom


@dataclass(eq=False)
class _Capture:
    """Text of an open element: its texts as they stand, or each stripped."""

    into: object
    key: object
    strip: bool
    parts: list[str] = field(default_factory=list)

    def close(self) -> None:
        text = "".join(p.strip() for p in self.parts) or None if self.strip else "".join(self.parts)
        self.into[self.key] = text  # type: ignore[index]


class Scan:
    """A plan of several asks, answered together for a page at a time."""

    def __init__(self, asks: list[Ask]):
        self.asks = asks
        selectors: list[str] = []

        def known(selector: str) -> int:
            if selector not in selectors:
                selectors.append(selector)
            return selectors.index(selector)

        #: What each selector that matches does: (ask, what, further).
        self.does: dict[int, list[tuple[int, str, object]]] = {}
        for a, ask in enumerate(asks):
            if isinstance(ask, Rows):
                for name, what in ask.fields.items():  # fields go before rows: an element is not below itself
                    selector, _, attribute = what.partition("@")
                    self.does.setdefault(known(selector), []).append((a, "field", (name, attribute.lower())))
                if ask.row:
                    self.does.setdefault(known(ask.row), []).append((a, "row", None))
            elif isinstance(ask, Facts):
                for s in ask.selectors:
                    self.does.setdefault(known(s), []).append((a, "match", s))
                self.does.setdefault(known("title"), []).append((a, "title", None))
                self.does.setdefault(known("meta"), []).append((a, "meta", None))
            elif not isinstance(ask, Custom):
                self.does.setdefault(known(ask.selector), []).append((a, "text" if isinstance(ask, Texts) else "value", getattr(ask, "attribute", None)))
        self.automaton = Automaton(selectors)
        for todo in self.does.values():
            todo.sort(key=lambda x: x[1] == "row")
        self.of_text = any(isinstance(a, Facts) for a in asks)

    def __call__(self, page: str | None) -> list[object]:
        """An answer for each ask: rows as dicts, texts, values, or a dict of facts."""
        page = page or ""
        step, does = self.automaton.step, self.does
        out: list = [[] if not isinstance(a, Facts) else {"title": None, "visible": 0, "consent": False, "matches": []} for a in self.asks]
        open_rows: list[list[dict]] = [[] for _ in self.asks]
        for a, ask in enumerate(self.asks):
            if isinstance(ask, Rows) and not ask.row:
                out[a].append({})
                open_rows[a].append(out[a][0])
        names: list[str] = [""]
        states, above, children = [0], [0], [0]
        captures: list[list[_Capture]] = [[]]  # that end with the element
        rows_of: list[list[int]] = [[]]
        active: list[_Capture] = []
        hidden, body_at, seen_body = 0, 0, False
        everything: list[str] = []
        body: list[str] = []

        def leave(to: int) -> None:
            nonlocal hidden, body_at
            while len(names) > to:
                for c in captures.pop():
                    c.close()
                    active.remove(c)
                for a in rows_of.pop():
                    open_rows[a].pop()
                hidden -= names.pop() in HIDDEN
                states.pop(), above.pop(), children.pop()
            if body_at and len(names) <= body_at:
                body_at = 0

        def say(text: str) -> None:
            for c in active:
                c.parts.append(text)
            if self.of_text and not hidden:
                everything.append(text)
                if body_at:
                    body.append(text)

        at = 0
        find = _TAG.search
        while m := find(page, at):
            if m.start() > at and (active or self.of_text):
                text = page[at : m.start()]
                say(html.unescape(text) if "&" in text else text)
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                if name in names:
                    leave(len(names) - 1 - names[::-1].index(name))
                continue
            while names[-1] in ENDS and name in ENDS[names[-1]]:
                leave(len(names) - 1)
            children[-1] += 1
            bits, found, attrs = step(name, m[3], children[-1], states[-1], above[-1])
            void = name in VOID
            mine: list[_Capture] = []
            own_rows: list[int] = []
            while found:
                low = found & -found
                found ^= low
                for a, what, more in does[low.bit_length() - 1]:
                    if what == "row":
                        row: dict = {}
                        out[a].append(row)
                        own_rows.append(a)
                        open_rows[a].append(row)
                        continue
                    if attrs is None and what in ("value", "meta") or what == "field" and more[1] and attrs is None:
                        attrs = attributes(m[3])
                    if what == "field":
                        key, attribute = more
                        # a row that this very element begins comes after it in the list
                        for row in open_rows[a][: len(open_rows[a]) - own_rows.count(a)]:
                            if key not in row:
                                row[key] = attrs.get(attribute) if attribute else None
                                if not attribute:
                                    mine.append(_Capture(row, key, True))
                    elif what == "text":
                        out[a].append("")
                        mine.append(_Capture(out[a], len(out[a]) - 1, False))
                    elif what == "value":
                        if attrs.get(more):
                            out[a].append(attrs[more])
                    elif what == "match":
                        if more not in out[a]["matches"]:
                            out[a]["matches"].append(more)
                    elif what == "title":
                        if out[a]["title"] is None:
                            out[a]["title"] = ""
                            mine.append(_Capture(out[a], "title", True))
                    elif attrs.get("http-equiv", "").lower() == "refresh":
                        content = attrs.get("content", "").lower()
                        out[a]["consent"] |= "consent" in content or "cookie" in content
            if void:
                for c in mine:
                    c.close()
                for a in own_rows:
                    open_rows[a].pop()
                continue
            if name == "body" and not seen_body:
                seen_body, body_at = True, len(names)
            names.append(name)
            states.append(bits)
            above.append(above[-1] | bits)
            children.append(0)
            captures.append(mine)
            active.extend(mine)
            rows_of.append(own_rows)
            hidden += name in HIDDEN
            if name in _RAW_END:
                end = _RAW_END[name].search(page, at)
                text = page[at : end.start() if end else len(page)]
                say(html.unescape(text) if name in ("title", "textarea") else text)
                at = end.end() if end else len(page)
                leave(len(names) - 1)
        if at < len(page):
            say(html.unescape(page[at:]))
        leave(1)
        for a, ask in enumerate(self.asks):
            if isinstance(ask, Rows):
                for row in out[a]:
                    for key in ask.fields:
                        row.setdefault(key, None)
            elif isinstance(ask, Custom):
                out[a] = ask.rows(page)
            elif isinstance(ask, Facts):
                out[a]["title"] = out[a]["title"] or ""
                out[a]["visible"] = len(" ".join("".join(body if seen_body else everything).split()).encode())
                out[a]["matches"] = [s for s in ask.selectors if s in out[a]["matches"]]
        return out


_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{}]', re.S)


def assigned(scripts: list[str], name: str) -> str | None:
    """The text of the array or object that the first script to do so assigns to a variable; null if none does, or it never ends."""
    start = re.compile(rf"(?:\b(?:var|let|const)\s+|\b(?:window|globalThis|self)\s*\.\s*){re.escape(name)}\s*=\s*(?=[\[{{])")
    for text in scripts:
        if m := start.search(text):
            depth = 0
            for b in _BRACKET.finditer(text, m.end()):
                depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(b[0], 0)
                if not depth:
                    return text[m.end() : b.end()]
            return None
    return None
