"""Splitting of texts into the pre-tokens of byte-level BPE."""

from __future__ import annotations

import re

import regex

#: The White_Space characters of Unicode and the splitting pattern of the vocabulary.
SPACE = "\t-\r \u0085   -     　"
GENERAL = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: The same over Latin text, where the classes of the standard module agree and it is faster.
LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


def pretokens(text: str) -> list[str]:
    return (GENERAL if _NOT_LATIN.search(text) else LATIN).findall(text)
