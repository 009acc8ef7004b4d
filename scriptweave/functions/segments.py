"""Words of scripts written without blanks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

MAX_WORDS = 1_000_000
# A list of at most so many letters becomes one pattern.
PATTERN_LETTERS = 20_000
_END = ""


class Trie:
    """Words by their letters."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[_END] = True

    def longest(self, text: str, at: int) -> int:
        """Length of the longest word that begins here and does not part a letter from its marks; 0: none."""
        node, best = self.root, 0
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            if _END in node and not (k + 1 < len(text) and is_mark(text[k + 1])):
                best = k + 1 - at
        return best


def is_mark(letter: str) -> bool:
    return unicodedata.category(letter)[0] == "M"


def is_katakana(letter: str) -> bool:
    """Katakana, its phonetic extensions and half-width forms, and the sign of a long vowel."""
    return "\u30a1" <= letter <= "\u30fa" or "\u30fc" <= letter <= "\u30ff" or "\u31f0" <= letter <= "\u31ff" or "\uff66" <= letter <= "\uff9d"


def is_unspaced(letter: str) -> bool:
    """Whether a stretch that begins so is of a script without blanks; stretches hold one kind only."""
    code = ord(letter)
    return is_katakana(letter) or any(a <= code <= b for a, b in _RANGES)


# Blocks of letters of Thai, Lao, Myanmar, Khmer, Hiragana and Han, and their further blocks.
_RANGES = [
    (0x0E01, 0x0E5B), (0x0E81, 0x0EDF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x2E80, 0x2FD5),
    (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3041, 0x309F), (0x3400, 0x9FFF), (0xA9E0, 0xA9FE),
    (0xAA60, 0xAA7F), (0xF900, 0xFAD9), (0x1B000, 0x1B16F), (0x1F200, 0x1F200), (0x20000, 0x3FFFF),
]


def segments(stretch: str, trie: Trie) -> Iterator[str]:
    """The words of a stretch between blanks of one kind of script."""
    if not stretch or not is_unspaced(stretch[0]):
        yield stretch
        return
    at = 0
    while at < len(stretch):
        n = trie.longest(stretch, at)
        if not n:
            n = 1
            if is_katakana(stretch[at]):
                while at + n < len(stretch) and is_katakana(stretch[at + n]) and not trie.longest(stretch, at + n):
                    n += 1
            while at + n < len(stretch) and is_mark(stretch[at + n]):
                n += 1
        yield stretch[at : at + n]
        at += n


def segmenter(trie: Trie):
    """Column function: the words of a text of stretches, blanks between them; null stays null."""

    @F.pandas_udf(T.StringType())
    def words(stretched: pd.Series) -> pd.Series:
        return stretched.map(lambda text: None if text is None else " ".join(w for x in text.split(" ") for w in segments(x, trie)))

    return words


def _code(letter: str) -> str:
    return rf"\x{{{ord(letter):X}}}"


def _choice(branches: list[tuple[str, str]]) -> str:
    """One of some patterns (first letter, pattern) by rising first letters: halved until few are left to try."""
    if len(branches) <= 8:
        return "|".join(pattern for _, pattern in branches)
    half = len(branches) // 2
    guard = f"[{_code(branches[0][0])}-{_code(branches[half - 1][0])}]"
    return f"(?={guard})(?:{_choice(branches[:half])})|{_choice(branches[half:])}"


def _below(node: dict) -> str:
    """Pattern of what may follow a node, the longest first; letters without a choice nest no group."""
    branches = []
    for letter in sorted(x for x in node if x != _END):
        run, child = _code(letter), node[letter]
        while len(child) == 1 and _END not in child:
            (following, child), = child.items()
            run += _code(following)
        branches.append((letter, run + _below(child)))
    if not branches:
        return ""
    return f"(?:{_choice(branches)}){'?' if _END in node else ''}"


def word_pattern(trie: Trie) -> str:
    """Pattern, for the JVM, of the words of a text of stretches with blanks between them: what ``segmenter`` finds."""
    kana = "\\x{30A1}-\\x{30FA}\\x{30FC}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{FF66}-\\x{FF9D}"
    unspaced = kana + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _RANGES)
    listed = _below(trie.root)
    word, no_word = (rf"{listed}(?!\p{{M}})|", rf"(?!{listed}(?!\p{{M}}))") if listed else ("", "")
    # possessive, so that a long run takes no depth
    run = rf"[{kana}](?:{no_word}[{kana}])*+\p{{M}}*"
    # at a blank only the first look is taken
    return rf"(?! )(?:(?<![^ ])[^ {unspaced}][^ ]*|{word}{run}|[^ ]\p{{M}}*)"
