"""Texts as bytes, cut between words into strips of bounded size."""

from __future__ import annotations

#: Bytes of text that are cut into words at once.
STRIP = 1 << 21
#: A-Z in lower case, other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def strips(text: bytes, fold: bytes = LOWER, size: int = STRIP):
    """Strips of the folded text; a cut is at a space or a line feed, so a word stays whole."""
    text, at = text.translate(fold), 0
    while at < len(text):
        end = len(text)
        if end - at > size:
            cut = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size))
            if cut <= at:  # a word longer than a strip
                cut = min((x for x in (text.find(b" ", at + 1), text.find(b"\n", at + 1)) if x > 0), default=end)
            end = cut
        yield text[at:end]
        at = end
