"""Views of one text in Python: what `text.normalise`, `decoded_variants`, `phonetic_fold` and `secret_core` give as columns, as ASCII bytes.

Arrow batches call these text by text, as most work is then done by whole-string operations.
"""

from __future__ import annotations

import binascii
import re
import unicodedata
from collections.abc import Iterator

from .text import CONFUSABLE, INVISIBLE, PHONETIC

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_LOWERED = bytes.maketrans(_UPPER, _LOWER)
_TURNED = bytes.maketrans(_UPPER + _LOWER, _UPPER[13:] + _UPPER[:13] + _LOWER[13:] + _LOWER[:13])
_TURN = dict(enumerate(_TURNED[:128].decode("ascii")))
_OTHERS = bytes(c for c in range(256) if c not in _LOWER + _DIGITS)
_WORDS = bytes.maketrans(_OTHERS, b" " * len(_OTHERS))
_CODED = _UPPER + _LOWER + _DIGITS + b"+/="
_RUNS = bytes(c if c in _CODED else 32 for c in range(256))
_SEPARATORS = b" \t\n\x0b\f\r-_.,|"
LEAST_RUN = 24
_LATIN = {**dict(CONFUSABLE), **dict.fromkeys(INVISIBLE, "")}
_SPELLED = {**{k.encode(): v.encode() for k, v in PHONETIC.items()}, **{bytes([d]): bytes([d]) for d in _DIGITS}}
_DIGIT = re.compile(rb"[0-9]")


def folded(text: str) -> bytes:
    """The normalised text in lower case; what is then not ASCII stands as `?`."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        for c in _LATIN.keys() & set(text):  # few of a text's distinct characters; a pattern or translate() takes ten times as long
            text = text.replace(c, _LATIN[c])
        text = unicodedata.normalize("NFKD", text)
        for c in filter(unicodedata.combining, set(text)):
            text = text.replace(c, "")
    return text.encode("ascii", "replace").translate(_LOWERED)


def decoded(text: str) -> Iterator[bytes]:
    """The decoded variants of a text, folded."""
    if text.isascii():
        plain = folded(text)
        yield plain.translate(_TURNED)
        yield plain[::-1]
    else:
        yield folded(text.translate(_TURN))
        yield folded(text[::-1])
    raw = text.encode()
    for shown in (raw.translate(_RUNS), raw.translate(_RUNS, _SEPARATORS)):
        for run in shown.split():
            if len(run) >= LEAST_RUN:
                body = run.replace(b"=", b"")
                if len(body) % 4 != 1:
                    hidden = binascii.a2b_base64(body + b"=" * (-len(body) % 4))
                    yield folded(hidden.decode("utf-8", "ignore").replace("\ufffd", ""))


def with_decoded(text: str) -> Iterator[bytes]:
    yield folded(text)
    yield from decoded(text)


def spelled(plain: bytes) -> bytes:
    """The letters and digits that a folded text spells in words, one after another."""
    words = _DIGIT.sub(rb" \g<0> ", plain).translate(_WORDS).split()
    return b"".join([x for x in map(_SPELLED.get, words) if x])


def cores(text: str) -> Iterator[bytes]:
    """The secret cores of a text, of its spelled characters and of its decoded variants."""
    plain = folded(text)
    yield plain.translate(None, _OTHERS)
    yield spelled(plain)
    for view in decoded(text):
        yield view.translate(None, _OTHERS)
