"""Texts as words that stay the same under case, accents, spacing, line layout, punctuation and the way a character is written or encoded."""

from __future__ import annotations

import html
import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁩︀-️﻿]")
#: A word parted by a hyphen at a line's end.
PARTED = re.compile("(?<=[^\\W\\d_])[-‐]\\r?\\n[ \\t]*(?=[^\\W\\d_])")
HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")
#: Letters of other scripts that look like Latin ones, fixed values.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁһӏԛԝьгп" + "αβεικνορτυχγη",
    "abekmhopctyxijsdhlqwbrn" + "abeikvoptuxyn",
)
MAX_MEMO = 400_000


def clean(text: str) -> str:
    """Undo entities, invisible characters, parted words and decomposed letters; the common text passes the tests unchanged."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    if "-\n" in text or "-\r" in text or "‐" in text:
        text = PARTED.sub("", text)
    return text


def plain(word: str) -> str:
    if word.isascii():
        return word.lower()
    w = unicodedata.normalize("NFKD", word).casefold()
    w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    return w.translate(LOOKALIKES)


class Forms(dict):
    """Word to its plain form; computed when first asked for."""

    def __missing__(self, word: str) -> str:
        if len(self) > MAX_MEMO:
            self.clear()
        self[word] = w = plain(word)
        return w

    def written(self, text: str | None, split_han: bool = False) -> list[str]:
        """Words as they are written, cleaned."""
        if not text:
            return []
        text = clean(text)
        if split_han and not text.isascii():
            text = HAN.sub(r" \g<0> ", text)
        return WORD.findall(text)

    def words(self, text: str | None, split_han: bool = False) -> list[str]:
        return list(map(self.__getitem__, self.written(text, split_han)))


FORMS = Forms()
