"""Statistics of one text, and the share of its characters that stands outside running sentences.

No word list is built in. What words and word pairs of sentences look like is learned from the corpus (`Lexicon`):

* Lines that are sentences by their form alone (an end mark, many varied words, hardly a figure or symbol) and lines
  that are none by their form (short, or full of figures, symbols, separators) are counted apart. A word's odds compare how
  often it stands in the one and in the other; function words of every language of the corpus get high odds.
* Pairs of neighbouring frequent words are counted. In strewn words most pairs that chance alone would have made common
  are hardly seen in the corpus; in sentences of any language few are.

A line belongs to running sentences when enough of its words have the odds of sentence words and when its stretch
of lines is not in broken order. Lines wrapped inside a sentence go with it. Lines of words that the corpus does not
know are judged by the form of their whole paragraph, whatever its line width.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np

_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_SPEAKER = re.compile(r"^[^\W\d_]: ")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[.!?…;:。！？]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-…’‘“”„«»‹›–—¿¡。、，！？「」]|_")
_PLAIN = bytes(c for c in range(128) if chr(c).isalnum() or chr(c).isspace() or chr(c) in ".,;:!?'\"()-")
_FIELD = re.compile(r"\t|\|| · | / | > |   +")
_MARK = re.compile(r"[.!?…。！？]+")
_CJK = re.compile("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
_UNSEEN = {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None}
STATS = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "broken_order", "outside")

#: Odds (natural logarithm) from which a word counts as one of sentences.
SENTENCE_WORD = 1.0
#: Least number of times that chance should have made a pair, for it to say something; and the part of it below which a pair is broken.
TESTABLE, BROKEN = 3.0, 0.2
#: Share of broken pairs from which a stretch of words is strewn, and the broken pairs it takes to say so.
STREWN, LEAST_BROKEN = 0.5, 6
#: Words of a window in which repetitions are counted.
WINDOW = 12


class Line:
    """One line without quote marks, speaker names and tags; `size` counts its characters but white space."""

    __slots__ = ("text", "size", "words", "digits", "symbols", "longest", "fields", "ends", "lower", "cjk", "typical")

    def __init__(self, raw: str) -> None:
        text = raw.lstrip(" >\t\xa0")
        if text[1:3] == ": ":
            text = _SPEAKER.sub("", text)
        if "<" in text:
            text = _TAG.sub(" ", text)
        self.size = len("".join(raw.split()))
        self.cjk = 0
        if text.isascii():
            flat = text.encode()
            self.digits = len(flat) - len(flat.translate(None, b"0123456789"))
            self.symbols = len(flat.translate(None, _PLAIN)) - 2 * flat.count(b"**")
        else:
            text = unicodedata.normalize("NFKC", text.translate(_UNSEEN))
            self.digits = sum(map(text.count, "0123456789"))
            self.symbols = len(_SYMBOL.findall(text.replace("**", "")))
            self.cjk = len(_CJK.findall(text))
        self.text = text
        self.words = _WORD.findall(text.lower())
        self.longest = max(map(len, text.split()), default=0)
        self.fields = len(_FIELD.findall(text.strip())) if "\t" in text or "|" in text or "   " in text or " · " in text or " / " in text or " > " in text else 0
        self.ends = text.rstrip(" \t\"'”“’»)]*")[-1:] in tuple(".!?…。！？")
        self.lower = text[:1].islower()

    def broken(self) -> bool:
        """Whether its form alone rules out sentences: figures, symbols, long strings, fields."""
        n = len(self.words)
        if not n or self.digits > 0.35 * self.size or self.symbols > max(2, 0.06 * self.size) or self.longest > 45 or self.fields > max(1, n // 8):
            return True
        return sum(map(len, self.words)) < 0.6 * self.size or (n >= WINDOW and _repeats(self.words))

    def sentence(self) -> bool:
        """Whether its form alone says that it is sentences."""
        n = len(self.words)
        return self.ends and n >= 8 and _natural(self.words, self.text, self.symbols, self.digits)


def _repeats(words: list[str]) -> bool:
    """Whether the same few words come again and again: less than WINDOW / 3 different ones in a window on average, or every fifth word twice in a row."""
    starts = range(0, len(words) - WINDOW + 1, WINDOW)
    return 3 * sum(len(set(words[k : k + WINDOW])) for k in starts) < WINDOW * len(starts) or 5 * sum(map(eq, words, words[1:])) > len(words)


def _natural(words: list[str], text: str, symbols: int, digits: int) -> bool:
    """Words as varied and short as those of sentences, with few commas, symbols and figures."""
    n, short = len(words), sum(len(w) <= 3 for w in words)
    return 0.1 * n <= short <= 0.75 * n and len(set(words)) > min(n, 60) ** 0.85 and text.count(",") <= n / 5 and symbols <= n / 20 and digits <= n / 2


def lines_of(text: str | None) -> list[Line]:
    return [Line(x) for x in _LINE.split(text or "") if x and not x.isspace()]


def pair_lines(text: str | None) -> str:
    """The lines of a text that are long enough to hold pairs of words in order."""
    rows = [x for x in _LINE.split(text or "") if x.count(" ") >= 5]
    out = "\n".join(rows)
    return out if out.isascii() else unicodedata.normalize("NFKC", out.translate(_UNSEEN))


def seeds(lines: list[Line]) -> Iterator[tuple[bool, list[str]]]:
    """(in a sentence, words) of the lines whose form alone tells."""
    for line in lines:
        if line.words:
            if line.broken() or len(line.words) < 5:
                yield False, line.words
            elif line.sentence():
                yield True, line.words


@dataclass
class Lexicon:
    """What is learned from a corpus.

    odds: of words, the logarithm of how much more often they stand in sentences. frequent: ids of the words whose pairs are
    counted. codes, counts: sorted pair codes (left id * number of words + right id) and how often each stands in the corpus. left,
    right: how often each word stands as left and right part of a pair, a row per language group. languages, known, rates: names of the groups, row
    numbers of words, and per row the logarithm of the share of documents with the word in each group; prior: logarithm of the groups' shares.
    """

    odds: dict[str, float] = field(default_factory=dict)
    frequent: dict[str, int] = field(default_factory=dict)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    right: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    languages: list[str] = field(default_factory=list)
    known: dict[str, int] = field(default_factory=dict)
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    typical: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.typical = frozenset(w for w, x in self.odds.items() if x >= SENTENCE_WORD)

    def pair_codes(self, text: str) -> list[int]:
        """The codes of the pairs of neighbouring frequent words of a text; figures and marks part them."""
        get, k = self.frequent.get, len(self.frequent)
        ids = [get(t, -1) for t in _TOKEN.findall(text.lower())]
        return [a * k + b for a, b in zip(ids, ids[1:]) if a >= 0 <= b]

    def language(self, words: set[str]) -> str:
        """The group whose documents have such words; `other` where no word is known."""
        known = [self.known[w] for w in words if w in self.known]
        return self.languages[int(np.argmax(self.rates[known].sum(axis=0) + self.prior))] if known else "other"

    def order(self, codes: list[int], language: str) -> tuple[np.ndarray, np.ndarray]:
        """Which of a text's pairs say something, and which of these are broken.

        Chance is that of the documents of the language group, the count that of the whole corpus; the text's own pairs are left out.
        """
        if not codes or not len(self.counts):
            return np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        code, back, often = np.unique(np.array(codes), return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        seen = np.where(self.codes[at] == code, self.counts[at], 0.0) - often
        a, b = np.divmod(code, len(self.frequent))
        g = self.languages.index(language) if language in self.languages else slice(None)
        left, right = (np.atleast_2d(x[g]).sum(axis=0) for x in (self.left, self.right))
        by_chance = np.maximum(0, left[a] - often) * np.maximum(0, right[b] - often) / max(1.0, left.sum())
        tells = by_chance >= TESTABLE
        return tells[back], (tells & (seen < BROKEN * by_chance))[back]


def _prose(line: Line, lex: Lexicon) -> float | None:
    """1 for a line of running sentences, 0 for another, between where the line alone doesn't tell, None where its words are unknown."""
    n = len(line.words)
    if line.cjk * 2 > line.size:
        return None
    if line.broken():
        return 0.0
    known = sum(map(lex.odds.__contains__, line.words))
    if known < 0.4 * n:
        return None
    share = line.typical / (known + (n - known) / 4)
    if n >= 12:
        return float(share >= 0.4 or (share >= 0.25 and line.sentence()))
    if n >= 5:
        return 1.0 if share >= 0.5 else 0.5 if share >= 0.3 else 0.25 if share else 0.1
    return 0.5 if share >= 0.5 else 0.1


def _paragraph(lines: list[Line]) -> bool:
    """Whether a paragraph of unknown words has the form of sentences: marks every few words, varied words, no figures or symbols."""
    text = " ".join(x.text for x in lines)
    if any(x.cjk for x in lines):
        marks = len(_MARK.findall(text)) + text.count("，") + text.count("、")
        return _CJK.search(text) is not None and marks >= 1 and marks * 60 >= sum(x.cjk for x in lines)
    words = [w for x in lines for w in x.words]
    marks = len(_MARK.findall(text))
    ends = sum(x.ends for x in lines)
    if len(words) < 5 or not marks or len(words) > 60 * marks or (len(lines) > 2 and len(words) < 4 * len(lines) and ends > len(lines) / 2):
        return False
    return _natural(words, text, sum(x.symbols for x in lines), sum(x.digits for x in lines)) and not any(x.broken() for x in lines)


def measure(text: str | None, lex: Lexicon) -> tuple[str, dict[str, float]]:
    """The language group a text looks like, and its statistics; all 0 for null, empty and blank texts.

    Shares have four digits, `outside` the next higher ones so that it stays on its side of a limit; words have three digits that count.
    So a statistic has a bounded number of values.
    """
    raw = _LINE.split(text or "")
    lines, block = [], []  # block: the paragraph of each line
    b = 0
    for x in raw:
        if x and not x.isspace():
            lines.append(Line(x))
            block.append(b)
        else:
            b += 1
    total = sum([x.size for x in lines])
    if not total:
        return "none", dict.fromkeys(STATS, 0.0)
    typical = lex.typical.__contains__
    for x in lines:
        x.typical = sum(map(typical, x.words))
    score = [_prose(x, lex) for x in lines]
    # paragraphs of unknown words go by their form
    k = 0
    while k < len(lines):
        if score[k] is None:
            end = k
            while end < len(lines) and block[end] == block[k] and score[end] is None:
                end += 1
            score[k:end] = [float(_paragraph(lines[k:end]))] * (end - k)
            k = end
        else:
            k += 1
    words = [w for x in lines for w in x.words]
    # lines wrapped inside a sentence: a doubtful line goes with the sentence before or after it
    kept = [s >= 1.0 for s in score]
    for k, s in enumerate(score):
        if 0 < s < 1 and not kept[k]:
            before = k > 0 and kept[k - 1] and not lines[k - 1].ends
            after = k + 1 < len(lines) and score[k + 1] >= 1.0 and not lines[k].ends and lines[k + 1].lower
            kept[k] = (before and (s >= 0.25 or lines[k].lower or lines[k].ends)) or (s >= 0.25 and after) or (s >= 0.5 and lines[k].ends)
    # order of the words, by unbroken stretch of such lines within a paragraph
    stretches, codes = [], []
    k = 0
    while k < len(lines):
        if not kept[k]:
            k += 1
            continue
        end = k
        while end < len(lines) and kept[end] and block[end] == block[k] and (end == k or not lines[end - 1].ends):
            end += 1
        mine = lex.pair_codes("\n".join(x.text for x in lines[k:end]))
        stretches.append((k, end, len(codes), len(codes) + len(mine)))
        codes += mine
        k = end
    language = lex.language(set(words))
    tells, bad = lex.order(codes, language)
    for k, end, first, last in stretches:
        if bad[first:last].sum() >= max(LEAST_BROKEN, STREWN * tells[first:last].sum()):
            kept[k:end] = [False] * (end - k)
    tested, wrong = int(tells.sum()), int(bad.sum())
    n_words = len(words)
    return language, {
        "words": float(f"{n_words:.3g}"),
        "mean_word_length": round(sum(map(len, words)) / n_words, 2) if n_words else 0.0,
        "symbol_ratio": round(sum(x.symbols for x in lines) / total, 4),
        "digit_ratio": round(sum(x.digits for x in lines) / total, 4),
        "punctuated_lines": round(sum(x.ends for x in lines) / len(lines), 4),
        "common_words": round(sum(x.typical for x in lines) / n_words, 4) if n_words else 0.0,
        "broken_order": round(wrong / tested, 4) if tested else 0.0,
        "outside": math.ceil(10000 * sum(x.size for x, p in zip(lines, kept) if not p) / total) / 10000,
    }


def log_odds(inside: float, outside: float, all_inside: float, all_outside: float) -> float:
    """How much more often a word stands in sentences than elsewhere."""
    return math.log((inside + 0.5) / (all_inside + 1)) - math.log((outside + 0.5) / (all_outside + 1))
