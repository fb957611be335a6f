"""Texts of the elements that CSS selectors name, for many selectors in one reading of a page."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without an end tag; elements that end where one of the others begins.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())}
ENDED_BY |= {"li": frozenset(["li"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: What bounds an element that is ended so.
SCOPE = {"li": ("ul", "ol"), "option": ("select",), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

_PART = re.compile(r"""\s*(?P<comb>[>+~])\s*|(?P<space>\s+)|(?P<any>\*)|[#](?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|:(?P<pseudo>first-child)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*(?P<flag>[iI])?\s*)?\]|(?P<tag>[\w-]+)""")


class Element:
    """An open element: its tag, attributes, and the children seen so far."""

    def __init__(self, tag: str, attrs: dict[str, str], place: int):
        self.tag, self.attrs, self.place, self.children = tag, attrs, place, []


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Callable[[Element], bool]:
    tests = {
        None: lambda has: True, "=": lambda has: has == value, "~=": lambda has: value in has.split(), "|=": lambda has: has == value or has.startswith(value + "-"),
        "^=": lambda has: value != "" and has.startswith(value), "$=": lambda has: value != "" and has.endswith(value), "*=": lambda has: value != "" and value in has,
    }
    value = value.lower() if fold else value
    test = tests[op]
    return lambda e: name in e.attrs and test(e.attrs[name].lower() if fold else e.attrs[name])


class Selector:
    """A compiled list of selectors: tag, *, #id, .class, [attr], [attr=v] (also ~= |= ^= $= *=, with i), :first-child, joined by blanks, >, + or ~.

    Anything else is a ValueError that names it.
    """

    def __init__(self, text: str):
        self.ways = [self._way(x.strip(), text) for x in self._split(text)]

    @staticmethod
    def _split(text: str) -> list[str]:
        return re.split(r""",(?=(?:[^"'\[\]]|"[^"]*"|'[^']*'|\[[^\]]*\])*$)""", text)

    @staticmethod
    def _way(text: str, whole: str) -> list[tuple[str, list[Callable[[Element], bool]]]]:
        steps, tests, comb, at = [], [], "", 0
        while at < len(text):
            m = _PART.match(text, at)
            if not m or (m["tag"] or m["any"]) and tests:
                raise ValueError(f"selector {whole!r}: {text[at:]!r} can't be read")
            at = m.end()
            if m["comb"] or m["space"]:
                if not tests:
                    raise ValueError(f"selector {whole!r}: nothing before {m[0]!r}")
                steps.append((comb, tests))
                tests, comb = [], m["comb"] or " "
            elif m["tag"]:
                tests.append(lambda e, t=m["tag"].lower(): e.tag == t)
            elif m["any"]:
                tests.append(lambda e: True)
            elif m["id"]:
                tests.append(lambda e, v=m["id"]: e.attrs.get("id") == v)
            elif m["cls"]:
                tests.append(lambda e, v=m["cls"]: v in e.attrs.get("class", "").split())
            elif m["pseudo"]:
                tests.append(lambda e: e.place == 0)
            else:
                tests.append(_attribute(m["attr"].lower(), m["op"], (m["val"] or "").strip("\"'"), bool(m["flag"])))
        if not tests:
            raise ValueError(f"selector {whole!r}: {text!r} names no element")
        return [*steps, (comb, tests)]

    def fits(self, path: list[Element]) -> bool:
        """Whether the last element of `path`, the open elements from the root on, is named."""
        return any(self._fits(way, len(way) - 1, path, len(path) - 1, None) for way in self.ways)

    def _fits(self, way: list, step: int, path: list[Element], at: int, sibling: int | None) -> bool:
        """`at`: the element in the path; with `sibling` that child of it instead."""
        element = path[at] if sibling is None else path[at].children[sibling]
        comb, tests = way[step]
        if not all(t(element) for t in tests):
            return False
        if not step:
            return True
        above = at if sibling is not None else at - 1
        if comb == ">":
            return above > 0 and self._fits(way, step - 1, path, above, None)
        if comb == " ":
            return any(self._fits(way, step - 1, path, k, None) for k in range(above, 0, -1))
        earlier = range(element.place - 1, -1, -1) if comb == "~" else [element.place - 1] * (element.place > 0)
        return above >= 0 and any(self._fits(way, step - 1, path, above, k) for k in earlier)


class Reader(HTMLParser):
    """Reads a page once; for each selector the texts of its elements, in the order in which they begin."""

    def __init__(self, selectors: list[Selector | None]):
        super().__init__()
        self.selectors = selectors
        self.path, self.found = [Element("", {}, 0)], [[] for _ in selectors]
        self.open: list[list[list[str]]] = [[]]

    def handle_starttag(self, tag, attrs):
        for own, enders in ENDED_BY.items():
            if tag in enders:
                bounds = SCOPE.get(own, ("td", "th", "button", "table"))
                for k in range(len(self.path) - 1, 0, -1):
                    if self.path[k].tag == own:
                        self._close(k)
                        break
                    if self.path[k].tag in bounds:
                        break
        parent = self.path[-1]
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, len(parent.children))
        parent.children.append(element)
        self.path.append(element)
        texts = []
        for selector, found in zip(self.selectors, self.found):
            if selector and selector.fits(self.path):
                found.append([])
                texts.append(found[-1])
        self.open.append(texts)
        if tag in VOID:
            self._close(len(self.path) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, at: int) -> None:
        del self.path[at:], self.open[at:]

    def handle_endtag(self, tag):
        for k in range(len(self.path) - 1, 0, -1):
            if self.path[k].tag == tag:
                self._close(k)
                break

    def handle_data(self, data):
        for texts in self.open:
            for text in texts:
                text.append(data)


def read_texts(page: str | None, selectors: list[Selector | None]) -> list[list[str]]:
    reader = Reader(selectors)
    reader.feed(page or "")
    reader.close()
    return [["".join(x) for x in found] for found in reader.found]


def texts_of(html: Column, selectors: dict[str, str | None]) -> Column:
    """struct of array<string>, a field for each name: texts of the elements that its selector names; none without a selector.

    Void elements hold nothing, unclosed paragraphs, items, rows and cells end where the next begins, an end tag closes what is open
    within. Built-in functions can't select elements.
    """
    compiled = [x and Selector(x) for x in selectors.values()]
    names = list(selectors)
    if not any(compiled):
        return F.struct(*[F.array().cast("array<string>").alias(n) for n in names])

    @F.pandas_udf(", ".join(f"`{n}` array<string>" for n in names))
    def of(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_texts(x, compiled) for x in pages], columns=names)

    return of(html)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", "")
