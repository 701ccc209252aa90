"""HTML to text with the standard library's parser, for input that the expressions don't handle."""

from __future__ import annotations

from html.parser import HTMLParser

_HIDDEN = frozenset("noscript head header script style".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.parts.append(" ")
        if tag in _HIDDEN:
            self.inside.append(tag)
        elif tag == "body":
            self.inside = [t for t in self.inside if t != "head"]  # a head that wasn't closed

    def handle_endtag(self, tag: str) -> None:
        self.parts.append(" ")
        if tag in self.inside:
            del self.inside[self.inside.index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.parts.append(data)

    def handle_comment(self, data: str) -> None:
        self.parts.append(" ")


def text_of(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)
