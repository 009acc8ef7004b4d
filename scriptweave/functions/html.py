"""HTML columns: title, paragraphs, entities. Regular expressions on whole documents;
no document tree is built."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import trim_blanks

# What is never closed runs to the end, and a tag ends before the next one, so that no pattern reads
# on from each of many openings.
NOT_CONTENT = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
TITLE = r"(?is)<title\b[^<>]*>(.*?)(?:</title\s*>|\z)"
# Block elements, whose opening ends a paragraph.
BLOCKS = "address|article|aside|blockquote|center|div|dl|fieldset|form|h[1-6]|hr|ol|pre|section|table|ul"
# A paragraph ends at its closing tag, at the next paragraph or block element, or at the end.
PARAGRAPH_END = rf"<(?:p|{BLOCKS})\b[^<>]*>|</p\s*>"
PARAGRAPH = rf"(?is)<p\b[^<>]*>(.*?)(?={PARAGRAPH_END}|\z)"
BREAK = r"(?i)<br\b[^<>]*>"
TAG = r"</?[A-Za-z!][^<>]*>"
# An entity, a stretch without entities, or a lone ampersand: together they cover any text.
PIECE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"
# Elements that may stand inside a paragraph.
INLINE = ["a", "b", "i", "u", "em", "strong", "font", "span", "small", "big", "sup", "sub", "tt", "code"]
NODE = "\u0001"


def inline_element(tag: str) -> str:
    """A child element with its content; one that is never closed runs to the end."""
    return rf"(?is)<{tag}\b[^<>]*>.*?(?:</{tag}\s*>|\z)"


def _named_entities() -> Column:
    """Map from entity to character, made from one literal and folded to a constant."""
    pairs = "\n".join(f"&{name};\t{chr(code)}" for name, code in sorted(name2codepoint.items()))
    return F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))


def _character(digits: Column, base: int) -> Column:
    """The character of a code point given as digits; nothing when there is no such character."""
    code = F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("bigint"))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(valid, F.decode(utf32, "UTF-32")).otherwise(F.lit(""))


def decode_entities(x: Column) -> Column:
    """Entities replaced in one pass, so ``&amp;lt;`` gives ``&lt;``. Unknown names stay."""
    named = _named_entities()

    def one(piece: Column) -> Column:
        # digits without leading zeros, so their length bounds the code point
        hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]*);$", 1)
        decimal = F.regexp_extract(piece, r"^&#0*([0-9]*);$", 1)
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece.rlike("^&#[xX]"), _character(hexadecimal, 16))
            .when(piece.startswith("&#"), _character(decimal, 10))
            .otherwise(F.coalesce(F.try_element_at(named, piece), piece))
        )

    decoded = F.array_join(F.transform(F.regexp_extract_all(x, F.lit(PIECE), 0), one), "")
    return F.when(x.contains("&"), decoded).otherwise(x)


# Texts go through array steps one after the other: what a lambda is given is a finished
# value, so an expression used twice in a step is not evaluated twice.


def texts_of(fragments: Column) -> Column:
    """Texts of HTML fragments: tags removed, entities decoded, ends trimmed."""
    bare = F.transform(fragments, lambda x: F.regexp_replace(x, TAG, ""))
    return F.transform(bare, lambda x: trim_blanks(decode_entities(x)))


def title(html: Column) -> Column:
    """Document title with its entities decoded, otherwise as written; NULL when there is none."""
    return F.get(F.transform(F.regexp_extract_all(html, F.lit(TITLE), 1), decode_entities), F.lit(0))


def paragraph_bodies(html: Column) -> Column:
    content = F.regexp_replace(html, NOT_CONTENT, "")
    return F.regexp_extract_all(content, F.lit(PARAGRAPH), 1)


# -- crossed tags -------------------------------------------------------------------------

# Elements without content, those a new paragraph closes, and how firmly others hold what is in them.
VOID = ["area", "base", "br", "col", "hr", "img", "input", "link", "meta", "param"]
CLOSED_BY_PARAGRAPH = ["p", "head", "h1", "h2", "h3", "h4", "h5", "h6", "tt", "i", "b", "u", "s", "strike", "big", "small"]
PRIORITY = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
MAX_DEPTH = 64
_BLOCK_NAMES = BLOCKS.replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|")


def _priority(name: Column) -> Column:
    out = F.lit(100)
    for value in sorted(set(PRIORITY.values())):
        out = F.when(name.isin([n for n, v in PRIORITY.items() if v == value]), value).otherwise(out)
    return out


def crossed_paragraph_bodies(html: Column) -> Column:
    """Paragraphs of a document whose tags cross, as a parser with a stack of open elements finds them.

    An end tag closes its element and all opened inside it, a paragraph among them, unless one in between
    holds firmer; without an open element of its name it is left out. A paragraph ends too where the next one or
    a block begins, which first closes open elements of fonts. The stack holds the ``MAX_DEPTH`` innermost.
    The tags are folded in one pass, on the JVM side; only places of paragraphs are gathered.
    """
    content = F.regexp_replace(html, NOT_CONTENT, "")
    # pieces are tags, or texts between them
    return F.get(F.transform(F.array(F.split(content, r"(?=<)|(?<=>)", -1)), _bodies_of_pieces), F.lit(0))


def _bodies_of_pieces(pieces: Column) -> Column:
    name = r"^</?([A-Za-z][A-Za-z0-9]*)[^<>]*>$"
    tags = F.transform(pieces, lambda x, i: F.struct(F.lower(F.regexp_extract(x, name, 1)).alias("name"), x.startswith("</").alias("end"), i.alias("at")))
    tags = F.filter(tags, lambda t: (t["name"] != "") & ~t["name"].isin(VOID))
    spans = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(-1).alias("open"), spans.alias("spans"))

    def after(state: Column, stack: Column, closed: Column, opened: Column, tag: Column) -> Column:
        span = F.struct(state["open"].alias("a"), tag["at"].alias("b"))
        done = closed & (state["open"] >= 0)
        return F.struct(
            F.slice(stack, 1, MAX_DEPTH).alias("stack"),
            F.when(opened, tag["at"]).when(done, F.lit(-1)).otherwise(state["open"]).alias("open"),
            F.when(done, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    def step(state: Column, tag: Column) -> Column:
        stack, name = state["stack"], tag["name"]
        place = F.array_position(stack, name).cast("int")
        above = F.slice(stack, F.lit(1), F.greatest(place - 1, F.lit(0)))
        held = F.exists(above, lambda e: _priority(e) > _priority(name))
        pops = (place > 0) & ~held
        popped = F.when(pops, F.slice(stack, place + 1, F.lit(MAX_DEPTH))).otherwise(stack)
        ends = pops & ((name == "p") | F.array_contains(above, "p"))
        # the first open element, from the innermost, that a new paragraph leaves open
        stays = F.filter(F.transform(stack, lambda e, i: F.when(~e.isin(CLOSED_BY_PARAGRAPH), i)), lambda i: i.isNotNull())
        first = F.coalesce(F.get(stays, F.lit(0)), F.size(stack))
        cleared = F.slice(stack, first + 1, F.lit(MAX_DEPTH))
        inside = F.array_position(stack, "p").cast("int")
        at_block = F.when(inside > 0, F.slice(stack, inside + 1, F.lit(MAX_DEPTH))).otherwise(stack)
        none = F.lit(False)
        return (
            F.when(tag["end"], after(state, popped, ends, none, tag))
            .when(name == "p", after(state, F.concat(F.array(name), F.when(inside > first, at_block).otherwise(cleared)), F.lit(True), F.lit(True), tag))
            .when(name.isin(_BLOCK_NAMES), after(state, F.concat(F.array(name), at_block), inside > 0, none, tag))
            .otherwise(after(state, F.concat(F.array(name), stack), none, none, tag))
        )

    def finish(state: Column) -> Column:
        last = F.struct(state["open"].alias("a"), F.size(pieces).alias("b"))
        return F.when(state["open"] >= 0, F.concat(state["spans"], F.array(last))).otherwise(state["spans"])

    found = F.aggregate(tags, start, step, finish)
    return F.transform(found, lambda s: F.array_join(F.slice(pieces, s["a"] + 2, s["b"] - s["a"] - 1), ""))


def _without_elements(body: Column) -> Column:
    bare = body
    for tag in INLINE:
        bare = F.regexp_replace(bare, inline_element(tag), NODE)
    return F.when(body.contains("<"), bare).otherwise(body)


def _inner_nodes(segments: Column) -> Column:
    inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))
    return F.split(F.array_join(inner, NODE), NODE)


def text_between_breaks(bodies: Column) -> Column:
    """Text directly under a paragraph with a line break before and after it.

    Child elements go with their content; each one parts the text around it.
    """
    bare = F.transform(bodies, _without_elements)
    segments = F.transform(bare, lambda x: F.split(x, BREAK))
    return F.flatten(F.transform(segments, _inner_nodes))


def paragraphs_of(bodies: Column, min_paragraphs: int = K.MIN_PARAGRAPHS) -> Column:
    """Texts of all paragraphs; of the text between line breaks instead when a document
    has fewer than ``min_paragraphs``."""
    few = F.size(bodies) < min_paragraphs
    return texts_of(F.when(few, text_between_breaks(bodies)).otherwise(bodies))
