"""Words as a reader sees them: whatever the case, punctuation, white space, mark-up, line breaks or letter encoding."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|mark|a|code|sub|sup|small|font|tt|q|wbr)(?:\s[^<>]*)?/?>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s\"[^\"]*\")?\)")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011\u00ac][^\S\n]*\r?\n[ \t>|*#]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")


def _bare(text: str) -> str:
    """Compatibility form, folded, without marks that stay apart after composition."""
    text = unicodedata.normalize("NFKC", text).casefold()
    text = unicodedata.normalize("NFC", text)
    return text if text.isascii() else "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Me"))


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of a text; none for null and empty texts."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _TAG_INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower() if text.isascii() else _bare(text))


_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”“’)\]]*\s+|\n\s*\n")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of a text; a sentence ends at a full stop, question or exclamation mark, or an empty line."""
    return [w for w in map(words, _SENTENCE_END.split(text or "")) if w]
