"""The catalogue's queries as SQL for DuckDB, to check the Spark plans against: plain windows,
regular expressions and joins. Shared with the Spark code are the title and entity patterns,
the entity table, the list of inline tags and the small tables."""

from __future__ import annotations

import math
from html.entities import name2codepoint

from ..functions import html as H
from . import inputs as I
from .catalog import TREND_BANDWIDTH


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(_str(n) for n in names) + ")"


def _literal(v) -> str:
    if isinstance(v, str):
        return _str(v)
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join(
        "(" + ", ".join(_literal(v) for v in r) + ")" for r in rows
    )
    return f"{name}({columns}) AS (VALUES {body})"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BLANKS = _str(" \t\n\r\f\u000b ")


def _trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def _clean(x: str, newline: str = "space") -> str:
    if newline == "space":
        x = rf"regexp_replace({x}, '[ \t\r\f\n]*\n[ \t\r\f\n]*', ' ', 'g')"
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{P}}\p{{S}}0-9 \t]', '', 'g')"
    x = f"replace(replace(replace({x}, 'Â', ''), 'â', ''), '\"', '')"
    return f"lower({_trim(x)})"


def _type(x: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, '^(\[sc)|(\(at)|(\[at)') THEN 'scene'
        WHEN regexp_matches({x}, '^(\()|(<)') THEN 'action'
        WHEN regexp_matches({x}, '^written') THEN 'written'
        WHEN regexp_matches({x}, '^[a-z](.*):') THEN 'person' END"""


def _person(x: str) -> str:
    return f"string_split({x}, ':')[1]"


def _line(x: str) -> str:
    return f"nullif({_trim(f'string_split({x}, chr(58))[2]')}, '')"


# words: runs of letters (joined inside by ' . and the like), of digits, of underscores
WORD = (
    r"(?:_+|\p{Nd}+(?:[''.’‘,;]\p{Nd}+)*"
    r"|[\p{L}\p{M}\p{Nl}]+(?:[''.’‘·][\p{L}\p{M}\p{Nl}]+)*)+"
)

# -- pages -------------------------------------------------------------------------------

_NAMED = "map {" + ", ".join(
    f"{_str(f'&{n};')}: {_str(chr(c))}" for n, c in sorted(name2codepoint.items())
) + "}"


def _decode(x: str) -> str:
    return rf"""CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(
        regexp_extract_all({x}, '{H.PIECE}'),
        lambda piece: CASE WHEN regexp_matches(piece, '^&#[0-9]+;$')
            THEN chr(CAST(regexp_extract(piece, '[0-9]+') AS INTEGER))
            WHEN regexp_matches(piece, '^&[A-Za-z]') THEN coalesce({_NAMED}[piece], piece)
            ELSE piece END), '') ELSE {x} END"""


def _text(x: str) -> str:
    bare = f"regexp_replace({x}, '</?[A-Za-z!][^<>]*>', '', 'g')"
    return _trim(_decode(bare))


def _content(html: str) -> str:
    return rf"regexp_replace({html}, '{H.NOT_CONTENT}', '', 'g')"


def _bodies(html: str) -> str:
    """Split at opening tags, the part before the first one dropped, each cut where a paragraph ends."""
    parts = rf"string_split_regex({_content(html)}, '(?i)<p\b[^<>]*>')"
    return rf"list_transform(({parts})[2:], lambda b: string_split_regex(b, '(?i){H.PARAGRAPH_END}')[1])"


def _bodies_cte(key: str, source: str) -> str:
    return f"bodies AS (SELECT {key}, {_bodies('html')} AS b FROM {source})"


def _explode(key: str, source: str, items: str, number: str) -> str:
    return f"SELECT {key}, unnest({items}) AS item, unnest(range(1, len({items}) + 1)) AS {number} FROM {source}"


def _nodes() -> str:
    x = "body"
    for tag in H.INLINE:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^<>]*>.*?(?:</{tag}\s*>|\z)', chr(1), 'g')"
    return x


def _chosen(key: str, source: str, minimum: int) -> str:
    """CTEs from a page source to ``chosen(key, item, para_no)``."""
    return ",\n".join(
        [
            _bodies_cte(key, source),
            f"body_rows AS ({_explode(key, 'bodies', 'b', 'body_no')})",
            f"sizes AS (SELECT {key}, len(b) AS n FROM bodies)",
            f"bared AS (SELECT {key}, body_no, string_split_regex(x, '(?i)<br\\b[^<>]*>') AS segs FROM ("
            f"SELECT {key}, body_no, {_nodes()} AS x FROM (SELECT {key}, body_no, item AS body FROM body_rows)))",
            f"seg_rows AS (SELECT {key}, body_no, unnest(segs) AS seg, unnest(range(1, len(segs) + 1)) AS seg_no,"
            " len(segs) AS n_segs FROM bared)",
            f"node_lists AS (SELECT {key}, body_no, seg_no, string_split(seg, chr(1)) AS nodes FROM seg_rows"
            " WHERE seg_no > 1 AND seg_no < n_segs)",
            f"node_rows AS (SELECT {key}, body_no, seg_no, unnest(nodes) AS item,"
            " unnest(range(1, len(nodes) + 1)) AS node_no FROM node_lists)",
            # a paragraph without inner text still counts as one empty node
            f"empty_rows AS (SELECT {key}, body_no, 0 AS seg_no, '' AS item, 0 AS node_no FROM bared WHERE len(segs) < 3)",
            f"all_nodes AS (SELECT * FROM node_rows UNION ALL SELECT {key}, body_no, seg_no, item, node_no FROM empty_rows)",
            f"chosen AS (SELECT r.{key}, r.item, r.body_no AS para_no FROM body_rows r JOIN sizes s ON r.{key} = s.{key}"
            f" WHERE s.n >= {minimum} UNION ALL SELECT a.{key}, a.item,"
            f" row_number() OVER (PARTITION BY a.{key} ORDER BY body_no, seg_no, node_no) AS para_no"
            f" FROM all_nodes a JOIN sizes s ON a.{key} = s.{key} WHERE s.n < {minimum})",
        ]
    )


_TITLE = (
    rf"CASE WHEN regexp_matches(html, '{H.TITLE}') THEN "
    + _decode(f"regexp_extract(html, '{H.TITLE}', 1)")
    + " END"
)


def _id_of(name: str) -> str:
    return rf"""CASE WHEN contains({name}, '-') THEN regexp_replace({name}, '^.*?([0-9]{{4}}-[0-9]{{4}}).*$', '\1')
        ELSE regexp_replace({name}, '^.*?([0-9]{{4}}).*$', '\1') END"""


def _page_lines(minimum: int, source: str = "src AS (SELECT page_id, url, html FROM pages)") -> str:
    """CTEs to ``page_rows``: lines numbered on over the pages of an id, by name and content."""
    return ",\n".join(
        [
            source,
            _chosen("page_id", "src", minimum),
            f"texts AS (SELECT page_id, CAST(para_no AS BIGINT) AS place, {_clean(_text('item'))} AS text FROM chosen)",
            f"""page_order AS (SELECT page_id, url, id, CAST(coalesce(sum(n) OVER (PARTITION BY id ORDER BY url, digest, page_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_lines
                FROM (SELECT s.page_id, s.url, {_id_of('s.url')} AS id, md5(s.html) AS digest,
                (SELECT count(*) FROM texts t WHERE t.page_id = s.page_id) AS n FROM src s))""",
            f"""page_rows AS (SELECT o.url AS source_file, o.id, o.before_lines + t.place AS line_no, t.text,
                {_type('t.text')} AS type, {_person('t.text')} AS person, {_line('t.text')} AS line, t.page_id
                FROM texts t JOIN page_order o ON t.page_id = o.page_id WHERE length(t.text) > 0)""",
        ]
    )


def _talks() -> str:
    """Pages made from conversations, as ``src``."""
    said = """CASE WHEN turn % 7 = 6 THEN '7th note ' || turn WHEN turn % 7 = 5 THEN '(' || role || ' waits)'
        ELSE '<b>' || CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'Asst'
        ELSE upper(role[1]) || lower(role[2:]) END || ':</b> ' || coalesce(text, '') END"""
    mark = "CASE WHEN turn % 3 = 1 THEN '[Scene: part ' || (turn // 3) || ']' || sep ELSE '' END"
    return f"""turns AS (SELECT conv_id, turn, {said} AS said,
        CASE WHEN conv_id % 5 = 0 THEN '<br>' ELSE '</p>' || chr(10) || '<p>' END AS sep, role, text FROM conversations),
    parts AS (SELECT conv_id, turn, {mark} || CASE WHEN conv_id % 5 = 0
        THEN regexp_replace(said, '</?b>', '', 'g') ELSE said END AS part, sep, text FROM turns),
    bodies_ AS (SELECT conv_id, 'Written by: crew ' || conv_id || any_value(sep) || CASE WHEN conv_id % 5 = 0
        THEN string_agg(part, '<br>' ORDER BY turn, text)
        ELSE string_agg(part, '</p>' || chr(10) || '<p>' ORDER BY turn, text) END AS body
        FROM parts GROUP BY conv_id),
    src AS (SELECT conv_id AS page_id, lpad(CAST(conv_id // 2 % 10000 AS VARCHAR), 4, '0')
        || CASE WHEN conv_id // 2 % 5 = 0 OR conv_id % 2 = 0 THEN '' ELSE 'b' END || '.html' AS url,
        '<html><head><title>Talk ' || conv_id || '</title></head><body>' || CASE WHEN conv_id % 5 = 0
        THEN '<p>start<br>' || body || '<br>end</p>' ELSE '<p>' || body || '</p>' END || '</body></html>' AS html FROM bodies_)"""


_TALK_LINES = _with(
    _page_lines(3, _talks()),
    _values("aliases", "alias, full_name", I.TALK_ALIASES),
    f"titles AS (SELECT page_id, {_TITLE} AS title FROM src)",
    """named AS (SELECT r.source_file, r.id, substr(r.id, 1, 2) AS season, t.title, r.line_no, r.type,
        coalesce(a.full_name, r.person) AS person, r.line FROM page_rows r JOIN titles t ON r.page_id = t.page_id
        LEFT JOIN aliases a ON r.person = a.alias)""",
    f"talk AS (SELECT * FROM named WHERE type = 'person' AND person IN {_in(I.TALK_MAIN)})",
).rstrip()
_SHARED = (
    _TALK_LINES
    + """ SELECT *, CAST(count(CASE WHEN type = 'scene' THEN 1 END) OVER (PARTITION BY id ORDER BY line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS scene FROM named"""
)


# -- event transcript --------------------------------------------------------------------

_RAW = """raw AS (SELECT CAST(user_id AS VARCHAR) AS id, user_id, ts, event_id AS line_no,
    lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') AS season,
    CASE event_type WHEN 'signup' THEN '[Scene: ' || props || ']' WHEN 'error' THEN '(error ' || props || ')'
    WHEN 'click' THEN 'Click: ' || props WHEN 'view' THEN 'View: ' || props
    ELSE CASE WHEN user_id % 3 = 0 THEN 'Purc: ' ELSE 'Purchase: ' END || props END AS raw_text FROM events)"""
_TEXTS = f"""texts AS (SELECT id, user_id, ts, line_no, season, text FROM (
    SELECT *, {_clean('raw_text')} AS text FROM raw) WHERE length(text) > 0)"""
_SPLIT = f"""split AS (SELECT id, user_id, ts, line_no, season, text, {_type('text')} AS type,
    {_person('text')} AS person, {_line('text')} AS line FROM texts)"""
_ALIASED = (
    _values("aliases", "alias, full_name", I.ALIASES)
    + """, lines AS (SELECT s.id, s.user_id, s.ts, s.line_no, s.season, s.text, s.type,
    coalesce(a.full_name, s.person) AS person, s.line FROM split s LEFT JOIN aliases a ON s.person = a.alias)"""
)
EVENTS = _with(_RAW, _TEXTS, _SPLIT, _ALIASED)
SCENES = EVENTS.rstrip() + """,
scenes AS (SELECT *, CAST(count(CASE WHEN type = 'scene' THEN 1 END) OVER (PARTITION BY id ORDER BY ts, line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS scene FROM lines)
"""
EVENT_MAIN = _in(I.EVENT_MAIN)

# -- documents ---------------------------------------------------------------------------

_DOCS = """doc_parts AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS season, source AS person,
    string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT id, season, person, unnest(parts) AS line,
    CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS line_no FROM doc_parts)"""
_SPOKEN = f"spoken AS (SELECT * FROM lines WHERE person IN {_in(I.DOCUMENT_MAIN)})"
_NUMBERED = """numbered AS (SELECT *,
    row_number() OVER (PARTITION BY person ORDER BY id, line_no) AS total_line,
    row_number() OVER (PARTITION BY season, person ORDER BY id, line_no) AS season_line,
    row_number() OVER (PARTITION BY id, person ORDER BY line_no) AS episode_line FROM spoken)"""
_WORDS = f"""token_lists AS (SELECT *, regexp_extract_all(lower(line), '{WORD}') AS toks FROM numbered),
words AS (SELECT id, season, person, line_no, total_line, season_line, episode_line,
    replace(unnest(toks), '''', '') AS word, CAST(unnest(range(1, len(toks) + 1)) AS BIGINT) AS word_no
    FROM token_lists)"""
_STOP = _values("stop_words", "word", I.STOP_WORDS)
_KEPT = "kept AS (SELECT * FROM words WHERE word NOT IN (SELECT word FROM stop_words))"
LINES = _with(_DOCS, _SPOKEN, _NUMBERED)
WORDS = _with(_DOCS, _SPOKEN, _NUMBERED, _WORDS)
KEPT = _with(_DOCS, _SPOKEN, _NUMBERED, _WORDS, _STOP, _KEPT)


def _hits(rows: list[tuple], column: str) -> str:
    return _with(
        _DOCS, _SPOKEN, _NUMBERED, _WORDS, _STOP, _KEPT,
        _values("lexicon", f"word, {column}", rows),
        f"hits AS (SELECT k.*, x.{column}, k.total_line // 30 AS bucket FROM kept k JOIN lexicon x ON k.word = x.word)",
    )


_SCORE = _hits(I.LEX_SCORE, "score")
_POLARITY = _hits(I.LEX_POLARITY, "sentiment")
_EMOTION = _hits(I.LEX_EMOTION, "sentiment")
_POLARITY_TABLE = """SELECT person, id, bucket, negative, positive, CAST(positive AS DOUBLE) / negative AS ratio,
    positive - negative AS diff FROM (SELECT person, id, bucket,
    nullif(count(CASE WHEN sentiment = 'negative' THEN 1 END), 0) AS negative,
    nullif(count(CASE WHEN sentiment = 'positive' THEN 1 END), 0) AS positive FROM hits GROUP BY person, id, bucket)"""


def _trend(series: str, group: str = "person", x: str = "bucket") -> str:
    """Range join of each x with the points nearer than the bandwidth."""
    h = float(TREND_BANDWIDTH)
    keys = [*group.split(", "), x]
    same = " AND ".join(f"a.{g} = b.{g}" for g in group.split(", "))
    return f"""SELECT {', '.join(keys)}, round(CASE WHEN s0 * s2 - s1 * s1 > 1e-9
        THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 6) AS trend FROM (
    SELECT {', '.join(keys)}, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1
    FROM (SELECT {', '.join(f'a.{k}' for k in keys)}, b.y, b.{x} - a.{x} AS d,
        pow(1 - pow(abs(b.{x} - a.{x}) / {h}, 3), 3) AS w
        FROM (SELECT DISTINCT {', '.join(keys)} FROM {series}) a JOIN {series} b
        ON {same} AND abs(a.{x} - b.{x}) < {TREND_BANDWIDTH}) GROUP BY {', '.join(keys)})"""


_DISTINCT = KEPT.rstrip() + f""",
line_totals AS (SELECT person, count(*) AS line_total_person, (SELECT count(*) FROM spoken) AS line_total
    FROM spoken GROUP BY person),
person_totals AS (SELECT person, count(*) AS person_words, (SELECT count(*) FROM kept) AS total_words
    FROM kept GROUP BY person),
word_totals AS (SELECT DISTINCT k.person, k.word, p.total_words, p.person_words
    FROM kept k JOIN person_totals p ON k.person = p.person),
counts AS (SELECT person, word, count(*) AS person_word FROM words WHERE word IS NOT NULL GROUP BY person, word),
anyone AS (SELECT word, CAST(sum(person_word) AS BIGINT) AS anyone_says_word FROM counts GROUP BY word),
weights AS (SELECT c.person, c.word, c.person_word, a.anyone_says_word, t.total_words, t.person_words,
    CAST(l.line_total AS DOUBLE) / l.line_total_person AS line_ratio,
    CAST(t.total_words AS DOUBLE) / t.person_words AS word_ratio,
    CAST(c.person_word * c.person_word AS DOUBLE) / a.anyone_says_word
        * (CAST(t.total_words AS DOUBLE) / t.person_words) AS weight,
    CAST(c.person_word * c.person_word * c.person_word AS DOUBLE) / a.anyone_says_word
        * (CAST(t.total_words AS DOUBLE) / t.person_words) AS weight3
    FROM counts c JOIN anyone a ON c.word = a.word
    LEFT JOIN word_totals t ON c.person = t.person AND c.word = t.word
    LEFT JOIN line_totals l ON c.person = l.person),
best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY word ORDER BY weight DESC NULLS LAST) AS r FROM weights)
    WHERE r = 1 AND weight IS NOT NULL AND word NOT IN {_in(I.EXTRA_STOP_WORDS)}),
top AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY person ORDER BY weight DESC) AS r2 FROM best) WHERE r2 <= 30)
"""

_PAY = _values("pay", "season, pay, pay_adj, n_groups", I.PAY)
_SALARY = """salary AS (SELECT season, pay, pay_adj, n_groups, pay * n_groups AS season_salary,
    pay_adj * n_groups AS season_salary_adj, sum(pay * n_groups) OVER () AS total_salary,
    sum(pay_adj * n_groups) OVER () AS total_salary_adj FROM pay)"""
_PAY_TABLE = _with(_DOCS, _SPOKEN, _NUMBERED, _WORDS, _PAY, _SALARY) .rstrip() + """,
per_line AS (SELECT person, season, n AS num_lines, CAST(sum(n) OVER () AS BIGINT) AS total_lines,
    CAST(sum(n) OVER (PARTITION BY person) AS BIGINT) AS total_lines_person
    FROM (SELECT person, season, count(*) AS n FROM spoken GROUP BY person, season)),
per_word AS (SELECT person, season, n AS num_words, CAST(sum(n) OVER () AS BIGINT) AS total_words,
    CAST(sum(n) OVER (PARTITION BY person) AS BIGINT) AS total_words_person
    FROM (SELECT person, season, count(*) AS n FROM words GROUP BY person, season)),
joined AS (SELECT coalesce(l.person, w.person) AS person, coalesce(l.season, w.season) AS season,
    num_lines, total_lines, total_lines_person, num_words, total_words, total_words_person
    FROM per_line l FULL JOIN per_word w ON l.person = w.person AND l.season = w.season),
pay_rows AS (SELECT b.person, coalesce(b.season, s.season) AS season, num_lines, total_lines, total_lines_person,
    num_words, total_words, total_words_person, pay, pay_adj, n_groups, season_salary, season_salary_adj,
    total_salary, total_salary_adj FROM joined b FULL JOIN salary s ON b.season = s.season),
""" + _values("display_names", "person, display", I.DISPLAY_NAMES) + "\n"

_SPEAKERS = """WITH totals AS (SELECT CAST(l_partkey AS VARCHAR) AS person, count(*) AS total_lines_person,
    (SELECT count(*) FROM lineitem) AS total_lines FROM lineitem GROUP BY l_partkey)
"""

_EVENT_TRIO = _in(I.EVENT_MAIN + ["purchase"])


def _pairs(present: str) -> str:
    """Self-join of distinct (scene, person), zero for pairs that never meet."""
    return f"""present AS ({present}),
people AS (SELECT DISTINCT person FROM present),
met AS (SELECT a.person AS person_a, b.person AS person_b, count(*) AS n FROM present a
    JOIN present b ON a.id = b.id AND a.scene = b.scene AND a.person > b.person GROUP BY a.person, b.person)
SELECT x.person AS person_a, y.person AS person_b, coalesce(m.n, 0) AS n FROM people x JOIN people y ON x.person > y.person
LEFT JOIN met m ON m.person_a = x.person AND m.person_b = y.person"""


_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー"
# the longer words first: the leftmost alternative that fits is taken
_SCRIPT_WORD = "|".join(sorted((w for (w,) in I.SCRIPT_WORDS), key=lambda w: (-len(w), w)))
_SCRIPT_WORD += rf"|[\p{{Katakana}}ー]+\p{{M}}*|[{_UNSPACED}]\p{{M}}*|[^{_UNSPACED}]+"

# Where a paragraph of the crossed pages ends: also at the font's end, and at that of an element around it.
_CROSSED_END = rf"{H.PARAGRAPH_END}|</(?:font|article|body|div|html|main|nav|section|aside|footer|header)\s*>"
_CROSSED = """replace(replace(html, '<p>', '<font size="3"><b>\n<p></b>'), '</p>', '</font> left out</p>')"""
_CROSSED_BODIES = rf"list_transform((string_split_regex({_content(_CROSSED)}, '(?i)<p\b[^<>]*>'))[2:], lambda b: string_split_regex(b, '(?i){_CROSSED_END}')[1])"

_NARROW = r"""regexp_replace(replace(html, '<meta charset="utf-8">', ''), '[^\x{0}-\x{7F}\x{A0}-\x{FF}]', '?', 'g')"""


def _span(series: str, span: float = 0.75, cell: float = 0.2) -> str:
    """Fits at vertices, and cubics between them. ``series`` has person, bucket, y."""
    cells = math.ceil(1 / (span * cell))
    t, width = "(p.bucket - f.v) / (f.v2 - f.v)", "(f.v2 - f.v)"
    return f""", pts AS (SELECT person, bucket, count(*) AS n, sum(y) AS y FROM {series} GROUP BY person, bucket),
    cum AS (SELECT *, sum(n) OVER w - n AS before, sum(n) OVER (PARTITION BY person) AS total,
        min(bucket) OVER (PARTITION BY person) AS lo, max(bucket) OVER (PARTITION BY person) AS hi
        FROM pts WINDOW w AS (PARTITION BY person ORDER BY bucket ROWS UNBOUNDED PRECEDING)),
    vert AS (SELECT person, CAST(bucket AS DOUBLE) AS v, least(total, greatest(2, floor({span} * total + 1e-9))) AS q FROM cum
        WHERE bucket IN (lo, hi) OR floor((before + n) * {cells} / total) > floor(before * {cells} / total)),
    far AS (SELECT v.person, v.v, v.q, p.bucket - v.v AS d, p.n, p.y FROM vert v JOIN pts p ON p.person = v.person),
    upto AS (SELECT *, sum(n) OVER (PARTITION BY person, v ORDER BY abs(d)) AS upto FROM far),
    wide AS (SELECT person, v, min(abs(d)) AS h FROM upto WHERE upto >= q GROUP BY person, v),
    near AS (SELECT f.*, CASE WHEN d = 0 THEN 1 ELSE pow(1 - pow(abs(d) / h, 3), 3) END AS w
        FROM far f JOIN wide u ON u.person = f.person AND u.v = f.v WHERE abs(d) < h OR d = 0),
    sums AS (SELECT person, v, sum(w * n) AS s0, sum(w * d * n) AS s1, sum(w * d * d * n) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1
        FROM near GROUP BY person, v),
    fits AS (SELECT person, v, CASE WHEN s0 * s2 - s1 * s1 > 1e-9 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS a,
        CASE WHEN s0 * s2 - s1 * s1 > 1e-9 THEN (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) ELSE 0 END AS b FROM sums),
    pairs AS (SELECT *, lead(v) OVER o AS v2, lead(a) OVER o AS a2, lead(b) OVER o AS b2 FROM fits WINDOW o AS (PARTITION BY person ORDER BY v))
    SELECT p.person, p.bucket, round(CASE WHEN v2 IS NULL THEN a ELSE (2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) * a
        + (pow({t}, 3) - 2 * pow({t}, 2) + {t}) * {width} * b + (3 * pow({t}, 2) - 2 * pow({t}, 3)) * a2
        + (pow({t}, 3) - pow({t}, 2)) * {width} * b2 END, 6) AS trend
    FROM pts p JOIN pairs f ON f.person = p.person AND p.bucket >= f.v AND (p.bucket < f.v2 OR (f.v2 IS NULL AND p.bucket = f.v))"""


ORACLE: dict[str, str] = {
    "html_crossed": _with(f"bodies AS (SELECT page_id, {_CROSSED_BODIES} AS b FROM pages)", f"rows_ AS ({_explode('page_id', 'bodies', 'b', 'no')})")
    + f"SELECT page_id, CAST(no AS BIGINT) AS para_no, {_text('item')} AS text FROM rows_",
    "page_charsets": f"""SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'iso-8859-1' WHEN 2 THEN 'windows-1252' WHEN 3 THEN 'windows-1252'
        ELSE 'utf-8' END AS charset, md5(CASE page_id % 5
        WHEN 0 THEN '<meta charset=utf-8>' || replace(html, '<meta charset="utf-8">', '')
        WHEN 1 THEN '<meta http-equiv=''Content-Type'' content=''text/html; charset=iso-8859-1''>' || {_NARROW}
        WHEN 2 THEN '<META CHARSET="Windows-1252">–' || {_NARROW} WHEN 3 THEN '–é' || {_NARROW}
        ELSE replace(html, '<meta charset="utf-8">', '') END) AS digest FROM pages""",
    "tokenize_scripts": _with(_DOCS, f"""lists AS (SELECT id, line_no, list_transform(
        regexp_extract_all(lower(translate(line, {_str(I.SCRIPT_LETTERS[0])}, {_str(I.SCRIPT_LETTERS[1])})), '{WORD}'),
        lambda w: regexp_extract_all(w, '{_SCRIPT_WORD}')) AS parted FROM lines)""")
    + """SELECT id, line_no, CAST(unnest(range(1, len(flatten(parted)) + 1)) AS BIGINT) AS word_no,
        replace(unnest(flatten(parted)), chr(39), '') AS word FROM lists""",
    "trend_span": _SCORE.rstrip()
    + ", series AS (SELECT person, bucket, CAST(sum(score) AS DOUBLE) AS y FROM hits GROUP BY person, bucket)\n"
    + _span("series"),
    "trend_season_numbers": EVENTS.rstrip()
    + f""", named AS (SELECT person, CASE WHEN CAST(id AS INTEGER) % 7 = 3 THEN 'pi' ELSE season END AS season FROM lines),
        series AS (SELECT person, TRY_CAST(season AS INTEGER) AS season, CAST(count(*) AS DOUBLE) AS y FROM named
        WHERE person IN {EVENT_MAIN} AND TRY_CAST(season AS INTEGER) IS NOT NULL GROUP BY person, TRY_CAST(season AS INTEGER))\n"""
    + _trend("series", x="season"),
    "cooccurrence_all": """WITH present AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS person FROM lineitem)
        SELECT a.person AS person_a, b.person AS person_b, count(*) AS n FROM present a JOIN present b ON a.id = b.id AND a.person > b.person
        GROUP BY a.person, b.person""",
    "lines_roundtrip_bad": EVENTS
    + """SELECT true AS good, type, count(*) AS n FROM lines GROUP BY type
        UNION ALL SELECT false, NULL, count(*) FROM events WHERE event_id % 50 = 0""",
    "scan_pages": f"""SELECT page_id, url AS file, CAST(length(html) AS BIGINT) AS n_chars FROM pages
        WHERE url NOT IN {_in(I.EXCLUDED_PAGES)}""",
    "html_paragraphs": _with(_bodies_cte("page_id", "pages"), f"rows_ AS ({_explode('page_id', 'bodies', 'b', 'no')})")
    + f"SELECT page_id, CAST(no AS BIGINT) AS para_no, {_text('item')} AS text FROM rows_",
    "html_br_fallback": _with(
        "src AS (SELECT page_id, replace(html, '</p><p>', '<br>') AS html FROM pages)", _chosen("page_id", "src", 20)
    )
    + f"SELECT page_id, CAST(para_no AS BIGINT) AS para_no, {_text('item')} AS text FROM chosen",
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "id_from_name": f"""SELECT page_id, name, id, substr(id, 1, 2) AS season FROM (
        SELECT page_id, name, {_id_of('name')} AS id FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url
        WHEN 1 THEN 'season/' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '.html'
        ELSE 'season/' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '-' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '.html'
        END AS name FROM pages))""",
    "page_lines": _with(_page_lines(20), f"titles AS (SELECT page_id, {_TITLE} AS title FROM src)")
    + """SELECT r.source_file, r.id, substr(r.id, 1, 2) AS season, t.title, r.line_no, r.type, r.person, r.line,
        CAST(count(CASE WHEN r.type = 'scene' THEN 1 END) OVER (PARTITION BY r.id ORDER BY r.line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS scene
        FROM page_rows r JOIN titles t ON r.page_id = t.page_id""",
    "page_lines_shared": _SHARED,
    "page_lines_added": _SHARED,
    "page_line_numbers": _TALK_LINES
    + """ SELECT id, season, person, line_no, row_number() OVER (PARTITION BY person ORDER BY id, line_no) AS total_line,
        row_number() OVER (PARTITION BY season, person ORDER BY id, line_no) AS season_line,
        row_number() OVER (PARTITION BY id, person ORDER BY line_no) AS episode_line FROM talk""",
    "page_token_recon": _TALK_LINES
    + f""", lists AS (SELECT *, CASE WHEN line IS NULL THEN [NULL] ELSE regexp_extract_all(lower(line), '{WORD}') END AS toks FROM talk),
        a AS (SELECT person, id, count(*) AS n_lines FROM talk GROUP BY person, id),
        b AS (SELECT person, id, count(DISTINCT line_no) AS n_token_lines FROM lists WHERE len(toks) > 0 GROUP BY person, id)
        SELECT person, id, n_lines, n_token_lines FROM a LEFT JOIN b USING (person, id)""",
    "untyped_lines": _TALK_LINES + " SELECT id, line_no, person, line FROM named WHERE type IS NULL",
    "clean_text": f"""SELECT * FROM (SELECT doc_id, {_clean('text', 'delete')} AS text FROM documents)
        WHERE length(text) > 0""",
    "clean_text_space": f"""SELECT * FROM (SELECT conv_id, turn, {_clean('text')} AS text FROM conversations)
        WHERE length(text) > 0""",
    "split_paragraphs": """SELECT conv_id, unnest(parts) AS text,
        CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS para_no FROM (SELECT conv_id,
        string_split(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), ''), chr(10) || chr(10)) AS parts
        FROM conversations GROUP BY conv_id)""",
    "classify_lines": EVENTS + "SELECT id, line_no, text, type FROM split",
    "split_speaker": EVENTS + "SELECT id, line_no, person, line FROM split",
    "split_speaker_keep_rest": EVENTS
    + f"""SELECT id, line_no, person, CASE WHEN contains(text, ':')
        THEN nullif({_trim("substr(text, strpos(text, ':') + 1)")}, '') END AS line FROM split""",
    "alias_map": EVENTS + "SELECT id, line_no, person, line, type FROM lines",
    "filter_alias_ids": EVENTS
    + """SELECT DISTINCT id FROM split WHERE type = 'person' AND regexp_matches(person, '^purc$')
        AND regexp_matches(id, '^[0-2]{2}')""",
    "two_part_ids": EVENTS
    + """SELECT DISTINCT season, id FROM (SELECT season, CASE WHEN user_id % 10 = 0
        THEN id || '-' || CAST(user_id + 1 AS VARCHAR) ELSE id END AS id FROM lines) WHERE contains(id, '-')""",
    "episode_count": EVENTS + "SELECT count(DISTINCT id) AS n FROM lines",
    "union_sources": _with(_DOCS)
    + """SELECT id, season, person, line_no, line, 'person' AS type FROM lines UNION ALL
        SELECT CAST(conv_id AS VARCHAR), NULL, role, turn, text, NULL FROM conversations""",
    "lines_roundtrip": SCENES + "SELECT season, type, person, count(*) AS n FROM scenes GROUP BY season, type, person",
    "lines_roundtrip_csv": SCENES + "SELECT season, type, person, count(*) AS n FROM scenes GROUP BY season, type, person",
    "numbers_from_buckets": EVENTS
    + """SELECT id, season, person, line_no,
        CAST(count(CASE WHEN type = 'scene' THEN 1 END) OVER (PARTITION BY id ORDER BY line_no) AS BIGINT) AS scene,
        row_number() OVER (PARTITION BY person ORDER BY id, line_no) AS total_line,
        row_number() OVER (PARTITION BY season, person ORDER BY id, line_no) AS season_line,
        row_number() OVER (PARTITION BY id, person ORDER BY line_no) AS episode_line FROM lines""",
    "scene_number": SCENES + "SELECT id, line_no, type, scene FROM scenes",
    "scenes_per_episode": SCENES + "SELECT id, max(scene) AS max_scene FROM scenes GROUP BY id",
    "avg_scenes": SCENES
    + "SELECT round(avg(m), 6) AS avg_scenes FROM (SELECT id, max(scene) AS m FROM scenes GROUP BY id)",
    "total_scenes": SCENES
    + "SELECT CAST(sum(m) AS BIGINT) AS num_scenes FROM (SELECT id, max(scene) AS m FROM scenes GROUP BY id)",
    "lines_per_episode": EVENTS + "SELECT id, count(*) AS n FROM lines WHERE type IN ('person', 'scene') GROUP BY id",
    "lines_by_person": EVENTS
    + f"""SELECT person, count(*) AS n, format('{{:,}}', count(*)) AS label FROM lines
        WHERE person IN {EVENT_MAIN} GROUP BY person""",
    "lines_by_person_season": EVENTS
    + f"""SELECT person, season, n, round(avg(n) OVER (PARTITION BY person), 6) AS avg_lines FROM (
        SELECT person, season, count(*) AS n FROM lines WHERE person IN {EVENT_MAIN} GROUP BY person, season)""",
    "lines_by_person_episode": EVENTS
    + f"SELECT person, id, count(*) AS n FROM lines WHERE person IN {EVENT_MAIN} GROUP BY person, id",
    "spoken_by_person_episode": EVENTS
    + f"""SELECT person, id, season, count(*) AS n FROM lines WHERE type = 'person' AND person IN {EVENT_MAIN}
        GROUP BY person, id, season""",
    "lines_per_scene": SCENES
    + f"""SELECT id, count(*) AS n_scenes, round(avg(n), 6) AS avg_lines FROM (SELECT id, scene, count(*) AS n
        FROM scenes WHERE person IN {EVENT_MAIN} GROUP BY id, scene) GROUP BY id""",
    "avg_lines_per_episode": EVENTS
    + f"""SELECT person, round(avg(n), 6) AS avg_lines FROM (SELECT person, id, count(*) AS n FROM lines
        WHERE person IN {EVENT_MAIN} GROUP BY person, id) GROUP BY person""",
    "line_totals": EVENTS
    + f"""SELECT person, count(*) AS line_total_person, (SELECT count(*) FROM lines WHERE person IN {EVENT_MAIN})
        AS line_total FROM lines WHERE person IN {EVENT_MAIN} GROUP BY person""",
    "speaker_totals": EVENTS
    + """SELECT person, count(*) AS total_lines_person, (SELECT count(*) FROM lines WHERE type = 'person')
        AS total_lines FROM lines WHERE type = 'person' GROUP BY person""",
    "top_speakers": _SPEAKERS
    + """SELECT person, total_lines_person, total_lines FROM (SELECT *, rank() OVER (ORDER BY total_lines_person DESC)
        AS r FROM totals) WHERE r <= 30""",
    "main_vs_recurring": _SPEAKERS
    + f"""SELECT CASE WHEN person IN {_in(I.PART_MAIN)} THEN 'main' ELSE 'recurr' END AS is_main,
        CAST(sum(total_lines_person) AS BIGINT) AS line_total_group FROM totals
        WHERE total_lines_person > (SELECT quantile_cont(total_lines_person, 0.95) FROM totals) GROUP BY 1""",
    "presence_matrix": SCENES
    + f"""SELECT id, scene, {', '.join(f"CAST(max(CASE WHEN person = {_str(p)} THEN 1 ELSE 0 END) AS BIGINT) AS {p}" for p in I.EVENT_MAIN)}
        FROM scenes WHERE person IN {EVENT_MAIN} GROUP BY id, scene""",
    "cooccurrence": "WITH "
    + _pairs(
        "SELECT DISTINCT l_orderkey AS id, 0 AS scene, p_brand AS person FROM lineitem JOIN part ON l_partkey = p_partkey"
    ),
    "cooccurrence_scenes": SCENES.rstrip()
    + ",\n"
    + _pairs(f"SELECT DISTINCT id, scene, person FROM scenes WHERE person IN {_EVENT_TRIO}"),
    "line_numbers": LINES + "SELECT id, season, person, line_no, total_line, season_line, episode_line FROM numbered",
    "tokenize": WORDS
    + "SELECT id, season, person, line_no, total_line, season_line, episode_line, word_no, word FROM words",
    "tokenize_edge": _with(
        """raw AS (SELECT event_id AS line_no, regexp_extract(props, '[0-9]+') AS k, event_type FROM events)""",
        """edge AS (SELECT line_no, CASE event_type WHEN 'click' THEN ['dont', 'go', k, 'kettles']
            WHEN 'view' THEN ['u.s.a', 'rocks', '1,' || k || '00.5', 'well', 'known', 'snake_case']
            WHEN 'signup' THEN ['a', '1', k, 'b', 'it’s', 'quoted'] WHEN 'error' THEN []
            ELSE [NULL] END AS toks FROM raw)""",
    )
    + "SELECT line_no, unnest(toks) AS word, CAST(unnest(range(1, len(toks) + 1)) AS BIGINT) AS word_no FROM edge",
    "token_line_recon": WORDS
    + """, a AS (SELECT person, id, count(*) AS n_lines FROM spoken GROUP BY person, id),
        b AS (SELECT person, id, count(DISTINCT episode_line) AS n_token_lines FROM words GROUP BY person, id)
        SELECT coalesce(a.person, b.person) AS person, coalesce(a.id, b.id) AS id, n_lines, n_token_lines
        FROM a FULL JOIN b ON a.person = b.person AND a.id = b.id""",
    "stop_anti_join": KEPT + "SELECT id, line_no, word_no, word FROM kept",
    "sent_score": _SCORE + "SELECT person, bucket, CAST(sum(score) AS BIGINT) AS sum_score FROM hits GROUP BY person, bucket",
    "season_bucket_end": _SCORE + "SELECT season, person, max(bucket) AS bucket FROM hits GROUP BY season, person",
    "sent_polarity": _POLARITY
    + f"SELECT person, id, bucket, negative, positive, round(ratio, 6) AS ratio, diff FROM ({_POLARITY_TABLE})",
    "sent_emotion": _EMOTION
    + "SELECT person, sentiment, id, bucket, count(*) AS n FROM hits GROUP BY person, sentiment, id, bucket",
    "trend_smooth": _SCORE.rstrip()
    + ", series AS (SELECT person, bucket, CAST(sum(score) AS DOUBLE) AS y FROM hits GROUP BY person, bucket)\n"
    + _trend("series"),
    "trend_smooth_ratio": _POLARITY.rstrip()
    + f", series AS (SELECT person, bucket, ratio AS y FROM ({_POLARITY_TABLE}) WHERE ratio IS NOT NULL)\n"
    + _trend("series"),
    "trend_emotion": _EMOTION.rstrip()
    + """, series AS (SELECT person, sentiment, bucket, CAST(count(*) AS DOUBLE) AS y FROM hits
        GROUP BY person, sentiment, id, bucket)\n"""
    + _trend("series", "person, sentiment"),
    "trend_lines_by_episode": EVENTS.rstrip()
    + f""", per AS (SELECT person, id, count(*) AS n FROM lines WHERE person IN {EVENT_MAIN} GROUP BY person, id),
        series AS (SELECT person, CAST(n AS DOUBLE) AS y, dense_rank() OVER (ORDER BY id) AS episode FROM per)\n"""
    + _trend("series", x="episode"),
    "trend_lines_by_season": EVENTS.rstrip()
    + f""", series AS (SELECT person, CAST(season AS INTEGER) AS season, CAST(count(*) AS DOUBLE) AS y FROM lines
        WHERE person IN {EVENT_MAIN} GROUP BY person, season)\n"""
    + _trend("series", x="season"),
    "trend_vocab_season": WORDS.rstrip()
    + """, per AS (SELECT person, season, avg(length(word)) AS y FROM (SELECT DISTINCT person, word, season FROM words)
        GROUP BY person, season),
        series AS (SELECT * FROM (SELECT person, y, dense_rank() OVER (ORDER BY season) AS place FROM per) WHERE y IS NOT NULL)\n"""
    + _trend("series", x="place"),
    "trend_vocab_episode": WORDS.rstrip()
    + """, per AS (SELECT person, id, avg(length(word)) AS y FROM words GROUP BY person, id),
        series AS (SELECT * FROM (SELECT person, y, dense_rank() OVER (ORDER BY id) AS episode FROM per) WHERE y IS NOT NULL)\n"""
    + _trend("series", x="episode"),
    "trend_nchar": WORDS.rstrip()
    + ", "
    + _PAY
    + """, per AS (SELECT w.person, w.season, total / n_groups AS y FROM (SELECT person, season, sum(length(word)) AS total
        FROM words GROUP BY person, season) w LEFT JOIN pay p ON w.season = p.season),
        series AS (SELECT * FROM (SELECT person, y, dense_rank() OVER (ORDER BY season) AS place FROM per) WHERE y IS NOT NULL)\n"""
    + _trend("series", x="place"),
    "sent_score_from_files": _SCORE
    + "SELECT person, bucket, CAST(sum(score) AS BIGINT) AS sum_score FROM hits GROUP BY person, bucket",
    "word_totals": _DISTINCT + "SELECT person, word, total_words, person_words FROM word_totals",
    "distinctive_words": _DISTINCT
    + """SELECT person, word, person_word, anyone_says_word, total_words, person_words,
        round(line_ratio, 6) AS line_ratio, round(word_ratio, 6) AS word_ratio, round(weight, 6) AS "unique",
        round(weight3, 6) AS unique3 FROM top""",
    "distinctive_words_ranked": _DISTINCT
    + """SELECT person, word, person_word, row_number() OVER (ORDER BY person, person_word, weight DESC, word) AS "order"
        FROM top""",
    "words_by_person_season": WORDS + "SELECT person, season, count(*) AS n FROM words GROUP BY person, season",
    "words_by_person": WORDS + "SELECT person, count(*) AS n FROM words GROUP BY person",
    "words_by_season": WORDS + "SELECT season, count(*) AS n FROM words GROUP BY season",
    "words_grouping_sets": WORDS
    + """SELECT person, season, 0 AS level, count(*) AS n FROM words GROUP BY person, season UNION ALL
        SELECT person, NULL, 1, count(*) FROM words GROUP BY person UNION ALL
        SELECT NULL, season, 2, count(*) FROM words GROUP BY season""",
    "words_season_mean": WORDS
    + """SELECT person, season, n, round(avg(n) OVER (PARTITION BY season), 6) AS avg_words FROM (
        SELECT person, season, count(*) AS n FROM words GROUP BY person, season)""",
    "vocab_distinct_length": WORDS
    + """SELECT person, season, count(*) AS n, round(avg(length(word)), 6) AS avg_char,
        round(stddev_samp(length(word)), 6) AS stdev_char FROM (SELECT DISTINCT person, word, season FROM words)
        GROUP BY person, season""",
    "vocab_episode_length": WORDS
    + """SELECT person, id, count(*) AS n, round(avg(length(word)), 6) AS avg_char,
        round(stddev_samp(length(word)), 6) AS stdev_char FROM words GROUP BY person, id""",
    "vocab_normalised": WORDS.rstrip()
    + ", "
    + _PAY
    + """ SELECT w.person, w.season, n, total_nchar, n_groups AS num_eps, round(total_nchar / n_groups, 6) AS total_nchar_norm
        FROM (SELECT person, season, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS total_nchar FROM words
        GROUP BY person, season) w LEFT JOIN pay p ON w.season = p.season""",
    "pay_table": _PAY_TABLE
    + """SELECT person, season, num_lines, total_lines, total_lines_person, num_words, total_words, total_words_person,
        pay, pay_adj, n_groups, round(season_salary, 6) AS season_salary, round(season_salary_adj, 6) AS season_salary_adj,
        round(total_salary, 6) AS total_salary, round(total_salary_adj, 6) AS total_salary_adj FROM pay_rows""",
    "salary_totals": _with(
        _PAY.replace("pay(season", "all_pay(season"),
        "pay AS (SELECT * FROM all_pay WHERE season IN (SELECT lang FROM documents))",
        _SALARY,
    )
    + """SELECT season, pay, pay_adj, n_groups, round(season_salary, 6) AS season_salary,
        round(season_salary_adj, 6) AS season_salary_adj, round(total_salary, 6) AS total_salary,
        round(total_salary_adj, 6) AS total_salary_adj FROM salary""",
    "pay_per_season": _PAY_TABLE
    + """SELECT DISTINCT coalesce(d.display, r.person) AS person, season,
        round(season_salary_adj / num_lines, 6) AS pay_per_line_per_season,
        round(season_salary_adj / num_words, 6) AS pay_per_word_per_season
        FROM pay_rows r LEFT JOIN display_names d ON r.person = d.person""",
    "pay_overall_long": _PAY_TABLE
    + """, overall AS (SELECT DISTINCT coalesce(d.display, r.person) AS person, total_salary_adj / total_lines_person AS a,
        total_salary_adj / total_words_person AS b FROM pay_rows r LEFT JOIN display_names d ON r.person = d.person)
        SELECT person, stat, round(v, 6) AS overall_pay, '$' || format('{:,}', CAST(round(v) AS BIGINT)) AS label FROM (
        SELECT person, 'USD Per Line' AS stat, a AS v FROM overall UNION ALL
        SELECT person, 'USD Per Word', b FROM overall)""",
}
