"""A small document tree: elements in page order, with their parents, attributes and strings.

Elements are numbered in page order, so what lies inside one of them is a range of numbers, and its strings are a range of
strings. Open elements end where HTML says so: a paragraph ends at the next block, a list item at the next item, a link at
the next link. An end tag closes the nearest open element of its name, unless a container of higher rank is in between.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = "address blockquote center dd dir div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li menu ol p pre table tbody td tfoot th thead tr ul"
#: Start tag -> open elements on top that it ends.
_ENDS = {tag: frozenset(["p"]) for tag in _BLOCKS.split()}
_ENDS |= {"li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "option": frozenset(["option"]), "a": frozenset(["a"])}
_ENDS |= {"td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "tr": frozenset(["p", "td", "th", "tr"]), "body": frozenset(["head"])}
_RANK = {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
_MIDDLE = 100
#: Attributes that hold a list of names.
_LISTS = frozenset(["class", "rel"])

Tests = tuple[tuple[str, str | None], ...]


class Page(HTMLParser):
    """A parsed page; element 0 stands for the whole of it."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = [""]
        self.attrs: list[dict[str, str]] = [{}]
        self.up: list[int] = [-1]
        #: First element and first string after the inside of each element.
        self.end: list[int] = [0]
        self.first_string: list[int] = [0]
        self.last_string: list[int] = [0]
        #: (text, whether readers see it).
        self.strings: list[tuple[str, bool]] = []
        self.named: dict[str, list[int]] = {}
        self._open = [0]
        self.feed(source)
        self.close()
        while self._open:
            self._shut()

    def _shut(self) -> None:
        node = self._open.pop()
        self.end[node], self.last_string[node] = len(self.tags), len(self.strings)

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        ended = _ENDS.get(tag, frozenset())
        while self.tags[self._open[-1]] in ended:
            self._shut()
        if tag == "a":
            self.handle_endtag("a")
        node = len(self.tags)
        self.tags.append(tag)
        # The first of attributes with one name counts.
        self.attrs.append({n: v or "" for n, v in reversed(attributes)})
        self.up.append(self._open[-1])
        self.end.append(node + 1)
        self.first_string.append(len(self.strings))
        self.last_string.append(len(self.strings))
        self.named.setdefault(tag, []).append(node)
        if tag not in _VOID:
            self._open.append(node)

    def handle_endtag(self, tag: str) -> None:
        rank = _RANK.get(tag, _MIDDLE)
        for k in range(len(self._open) - 1, 0, -1):
            name = self.tags[self._open[k]]
            if name == tag:
                while len(self._open) > k:
                    self._shut()
                return
            if _RANK.get(name, _MIDDLE) > rank:
                return

    def handle_data(self, data: str) -> None:
        self.strings.append((data, self.tags[self._open[-1]] not in ("script", "style")))

    def handle_comment(self, data: str) -> None:
        self.strings.append((data, False))

    def inside(self, node: int, tags: Iterable[str], tests: Tests) -> Iterator[int]:
        """Elements inside ``node`` with one of the tags that pass all tests, in page order."""
        found = []
        for tag in tags:
            at = self.named.get(tag, [])
            found += at[bisect_left(at, node + 1) : bisect_left(at, self.end[node])]
        return (x for x in sorted(found) if self.passes(x, tests))

    def passes(self, node: int, tests: Tests) -> bool:
        """A test is (attribute, pattern); without a pattern the attribute must be there. Lists are tried name by name, too."""
        attrs = self.attrs[node]
        for name, pattern in tests:
            if name not in attrs:
                return False
            if pattern is None:
                continue
            value = attrs[name]
            values = [*value.split(), value] if name in _LISTS else [value]
            if not any(re.search(pattern, v) for v in values):
                return False
        return True

    def around(self, node: int, tags: Iterable[str], tests: Tests) -> int | None:
        """The nearest element around ``node`` with one of the tags that passes all tests."""
        node = self.up[node]
        while node > 0:
            if self.tags[node] in tags and self.passes(node, tests):
                return node
            node = self.up[node]
        return None

    def seen(self, node: int) -> str:
        """What readers see of an element, trimmed."""
        return "".join(s for s, shown in self.strings[self.first_string[node] : self.last_string[node]] if shown).strip()

    def all_strings(self, node: int) -> list[str]:
        """Every string in an element, comments, scripts and styles included."""
        return [s for s, _ in self.strings[self.first_string[node] : self.last_string[node]]]
