"""Visible text of HTML, from the standard library's event parser.

Events stand for the tree a browser would build, as far as text goes: text outside the body's elements counts,
an unclosed head ends where body content begins, raw-text elements end at their own end tag only. Text of
mis-nested tables stays where it is written; a browser would move it before the table.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements by what becomes of their text.
SKIPPED = frozenset("head script style noscript template".split())
BLOCKS = frozenset(
    """p div section article header footer main aside nav figure figcaption blockquote pre hr ul ol li dl dt dd table
    caption tr h1 h2 h3 h4 h5 h6""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("base basefont bgsound link meta noscript script style template title noframes".split())
# An open element that a start tag of the set on the right closes.
_CLOSED_BY = {
    "p": BLOCKS - {"tr", "caption", "li", "dt", "dd"} | {"form", "fieldset", "address", "center", "details", "dialog", "dir", "menu", "summary", "hgroup", "search"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "option": {"option", "optgroup"},
    **{f"h{k}": {f"h{n}" for n in range(1, 7)} for k in range(1, 7)},
}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


class _Walker(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style", "xmp", "iframe", "noembed", "noframes")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.pre = False

    @property
    def hidden(self) -> bool:
        return any(t in SKIPPED for t in self.open)

    def flush(self) -> None:
        if self.text:
            data = "".join(self.text)
            self.text = []
            if data:
                self.out += [data, " "]

    def _pop_to(self, tag: str, stops: set[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == tag:
                self.flush()
                while len(self.open) > k:
                    if self.open.pop() in BLOCKS and not self.hidden:
                        self.out.append("\n\n")
                return
            if self.open[k] in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            self._leave_head()
            return
        if "head" in self.open and not set(self.open) & (SKIPPED - {"head"}) and tag not in _HEAD:
            self._leave_head()
        for element in [*self.open[::-1]]:
            if tag in _CLOSED_BY.get(element, ()):
                self._pop_to(element, _SCOPES.get(element, set()))
                break
            if element in _SCOPES.get(tag, ()) or element in ("table", "button", "template"):
                break
        self.flush()
        if self.hidden:
            if tag not in _VOID:
                self.open.append(tag)
            return
        if tag == "br":
            self.out.append("\n")
        elif tag in _VOID:
            if tag in BLOCKS:
                self.out.append("\n\n\n\n")
        else:
            self.open.append(tag)
            if tag in BLOCKS:
                self.out.append("\n\n")
            self.pre = tag in ("pre", "textarea", "listing")

    def _leave_head(self) -> None:
        if "head" in self.open:
            self._pop_to("head")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and "p" not in self.open:
            if not self.hidden:
                self.flush()
                self.out.append("\n\n\n\n")
        elif tag not in ("html", "body"):
            self._pop_to(tag, {"table"} if tag not in ("table", "template") and "table" in self.open and tag not in self._in_cell() else set())

    def _in_cell(self) -> set[str]:
        """Elements opened within the innermost table."""
        k = len(self.open) - 1 - self.open[::-1].index("table")
        return set(self.open[k:])

    def handle_data(self, data: str) -> None:
        if self.pre:
            self.pre = False
            data = data[1:] if data.startswith("\n") else data
        if "head" in self.open and not set(self.open) & {"script", "style", "title", "noscript", "template"} and data.strip():
            self._leave_head()
        if not self.hidden:
            self.text.append(data)

    def handle_comment(self, data: str) -> None:
        if not self.hidden:
            self.flush()

    def handle_decl(self, decl: str) -> None:
        pass

    def unknown_decl(self, data: str) -> None:
        self.handle_comment(data)

    def handle_pi(self, data: str) -> None:
        self.handle_comment(data)


def html_text(source: str | None) -> str:
    """The text a reader sees, block elements set apart by blank lines, not yet normalised."""
    walker = _Walker()
    walker.feed(re.sub("\r\n?", "\n", (source or "").replace("\x00", "�")))
    walker.close()
    walker.flush()
    return "".join(walker.out)
