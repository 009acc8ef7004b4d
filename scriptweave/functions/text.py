"""Text columns: cleaning, line type, speaker, tokens. All stay on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import constants as K

# Blanks trimmed at both ends, the no-break space among them.
BLANKS = " \t\n\r\f\u000b "

# The look-behind lets a match begin only where a run of blanks begins, so a long
# run without a newline is scanned once instead of once per position.
NEWLINE_RUN = r"(?<![ \t\r\f\n])[ \t\r\f\n]*\n[ \t\r\f\n]*"

# What cleaning deletes: all but letters, marks, punctuation, symbols, digits, blanks.
NOT_TEXT = r"[^\p{L}\p{M}\p{P}\p{S}0-9 \t]"

# Word boundaries after Unicode Annex 29: a joiner stays inside a word between two
# letters ("don't", "u.s.a") or between two digits ("1,000"); all else separates.
# One character per match and no repeated group: regex depth never grows with the text.
_LETTER = r"\p{L}\p{M}\p{Nl}"
_LETTER_JOINERS = "'.’‘·"
_DIGIT_JOINERS = "'.’‘,;"
_JOINERS = "'.’‘·,;"
SEPARATOR = (
    rf"[^{_LETTER}\p{{Nd}}_{_JOINERS}]"
    rf"|[{_JOINERS}](?!(?<=[{_LETTER}][{_LETTER_JOINERS}])[{_LETTER}]"
    rf"|(?<=\p{{Nd}}[{_DIGIT_JOINERS}])\p{{Nd}})"
)


def trim_blanks(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def clean(x: Column, newline: str = "space") -> Column:
    """Cleaned lower-case text. ``newline``: "space" sets a space where a line broke,
    "delete" glues the words on both sides."""
    if newline not in ("space", "delete"):
        raise ValueError(f"newline must be 'space' or 'delete', not {newline!r}")
    if newline == "space":
        x = F.regexp_replace(x, NEWLINE_RUN, " ")
    x = F.regexp_replace(x, NOT_TEXT, "")
    x = F.translate(x, 'Ââ"', "")
    return F.lower(trim_blanks(x))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def line_type(text: Column) -> Column:
    """Type of a cleaned line by the first rule that fits; NULL when none does."""
    scene = _any([text.startswith(K.SCENE_START)] + [text.contains(s) for s in K.SCENE_ANYWHERE])
    action = _any([text.startswith(K.ACTION_START)] + [text.contains(s) for s in K.ACTION_ANYWHERE])
    person = F.substring(text, 1, 1).between("a", "z") & text.contains(":")
    return (
        F.when(scene, "scene")
        .when(action, "action")
        .when(text.startswith(K.WRITTEN_START), "written")
        .when(person, "person")
    )


def speaker(text: Column) -> Column:
    return F.get(F.split(text, ":", -1), F.lit(0))


def spoken_text(text: Column, keep_rest: bool = False) -> Column:
    """Text after the first colon up to the second; with ``keep_rest`` up to the end.
    NULL when there is no colon or nothing behind it."""
    if keep_rest:
        rest = F.when(text.contains(":"), text.substr(F.locate(":", text) + 1, F.length(text)))
    else:
        rest = F.get(F.split(text, ":", -1), F.lit(1))
    return F.nullif(trim_blanks(rest), F.lit(""))


def id_from_name(name: Column) -> Column:
    """First four digits of a file name, or ``dddd-dddd`` when it holds a hyphen; a name
    without such digits stays as it is."""
    return F.when(
        name.contains("-"), F.regexp_replace(name, r"^.*?([0-9]{4}-[0-9]{4}).*$", "$1")
    ).otherwise(F.regexp_replace(name, r"^.*?([0-9]{4}).*$", "$1"))


def season_of(id_: Column) -> Column:
    return F.substring(id_, 1, 2)


def _spaced(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), SEPARATOR, " ")


def parted(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def tokens(line: Column) -> Column:
    """Lower-case words of a line. A NULL line gives one NULL word, a line without words none."""
    words = parted(_spaced(line))
    return F.when(line.isNull(), F.array(F.lit(None).cast("string"))).otherwise(words)


# Scripts that are written without blanks between words.
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + "ー"
# The range first: looking up a letter's script is slow.
UNSPACED = rf"[\x{{E00}}-\x{{10FFFF}}&&[{_UNSPACED}]]"
_UNSPACED_OR_MARK = rf"[\x{{300}}-\x{{10FFFF}}&&[{_UNSPACED}\p{{M}}]]"


def has_unspaced(line: Column) -> Column:
    return line.rlike(UNSPACED)


def stretched(line: Column) -> Column:
    """The words of a line with blanks between them, parted where a script without blanks begins or ends."""
    return F.regexp_replace(_spaced(line), f"{UNSPACED}{_UNSPACED_OR_MARK}*", " $0 ")
