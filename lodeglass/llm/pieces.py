"""Texts in chunks that can be encoded apart, and a bounded memory of encoded chunks.

The usual pattern of byte-level vocabularies never lets a piece cross the place before a single blank that has other than white
space on both sides, and nothing before that place changes how the text behind it is cut. Chunks between such places
therefore encode independently, and since words repeat, most chunks of a text have been encoded before.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Fixed value: how byte-level vocabularies cut a text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_DOUBLE_SPACE = re.compile(r" \s|\s ")
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The chunks of a text; joined they give the text. An empty text has none."""
    if not text:
        return []
    if _DOUBLE_SPACE.search(text) or text[0] == " " or text[-1] == " ":
        first, *rest = _SINGLE_BLANK.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]]


class Remembered(dict):
    """A dictionary that makes missing values and holds at most twice ``most`` entries.

    When ``most`` is reached the present entries become the old generation; an old entry that is asked for again
    moves to the new one, so frequent chunks stay. Only speed depends on ``most``, never a result.
    """

    def __init__(self, make: Callable[[str], object], most: int) -> None:
        super().__init__()
        self._make, self._most, self._old = make, most, {}

    def __missing__(self, key: str) -> object:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others
    follow from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
