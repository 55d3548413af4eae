"""Secret scan: known key formats plus sliding-window entropy, in Spark SQL expressions only.

Positions come from splitting a text at a pattern: running sums over the lengths of the matches and of
the pieces between them are code point offsets. Candidate strings are runs over the alphabet of a
character class, less what a known format has already. A window of fixed width slides over each; its
symbol counts are kept in a string with one digit per ASCII code, of which each step changes two
places, and the sum of c * log2(c) follows from the changed counts alone. Each stretch that windows
over the class's threshold cover is a span, unless the allow-list knows the candidate.

Arrays are never grown one by one over a whole text, and long candidates are cut into overlapping parts,
so the work grows with the text: running sums are built in chunks, the sums of chunks in chunks again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

# The patterns of the known formats and the least length of what must match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WIDTH = 20
#: Character class: (kind, candidate strings, least entropy in bits of a window of WIDTH). Of random
#: keys of WIDTH symbols, 97 % of hex ones and 98 % of those of 62 or 64 symbols reach it.
CLASSES = (("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])", 2.95), ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 3.66))
#: Candidates that are no secrets: one letter case alone, digits alone, hex (a class of its own),
#: UUIDs, paths or words joined by signs, counting sequences, and declared examples.
ALLOWED = (
    r"^[a-z+/_=-]+$",
    r"^[A-Z+/_=-]+$",
    r"^[A-Z]?[a-z]+([A-Z][a-z]+)*$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))+$",
    r"(?i)0123456789|abcdefghij|example|placeholder|xxxxxx",
)
CHUNK = 64  # elements that are summed one by one
PART = 512  # window starts of one part of a candidate
FOUND = "array<struct<start: bigint, stop: bigint, m: string>>"
PAIR = "array<struct<start: bigint, stop: bigint>>"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(array: str, levels: int = 3) -> str:
    """Running sums of an array of BIGINT, whose name is given. With L levels, CHUNK ** L elements take
    about CHUNK steps each."""
    one = lambda a: f"aggregate({a}, CAST(array() AS array<bigint>), (s, x) -> array_append(s, coalesce(try_element_at(s, -1), 0L) + x))"
    if not levels:
        return one(array)
    n = levels
    chunks = f"transform(sequence(0, (size({array}) - 1) div {CHUNK}), c -> {one(f'slice({array}, c * {CHUNK} + 1, {CHUNK})')})"
    body = f"flatten(transform(i{n}, (x, k) -> IF(k = 0, x, transform(x, v -> v + c{n}[k - 1]))))"
    carried = _let(f"t{n}", f"transform(i{n}, x -> element_at(x, -1))", _let(f"c{n}", _running(f"t{n}", n - 1), body))
    return f"IF(size({array}) = 0, CAST(array() AS array<bigint>), {_let(f'i{n}', chunks, carried)})"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else "r\"" + pattern + '"' if '"' not in pattern else "concat(" + ", '\"', ".join("r\"" + p + '"' for p in pattern.split('"')) + ")"


def _matches(text: str, pattern: str) -> str:
    """Array of (start, stop, m): all leftmost matches that do not overlap, in code points."""
    p = _sql(pattern)
    both = f"zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, gap) -> named_struct('m', m, 'gap', CAST(length(gap) AS bigint), 'n', CAST(coalesce(length(m), 0) AS bigint)))"
    ends = "zip_with(z, e, (x, stop) -> named_struct('start', stop - x.n, 'stop', stop, 'm', x.m))"
    found = _let("z", both, _let("g", "transform(z, x -> x.gap + x.n)", _let("e", _running("g"), f"filter({ends}, x -> x.m IS NOT NULL)")))
    return f"CASE WHEN regexp_like({text}, {p}) THEN {found} ELSE CAST(array() AS {FOUND}) END"


def _joined(spans: str, reach: int = 0) -> str:
    """Spans in order of their start, those that overlap or touch (or lie within ``reach``) made one;
    the name of an array is given whose stops are in order too."""
    first = f"filter(sequence(0, size({spans}) - 1), k -> k = 0 OR {spans}[k].start > {spans}[k - 1].stop + {reach})"
    ends = f"transform(f, (k, j) -> named_struct('start', {spans}[k].start, 'stop', {spans}[IF(j + 1 < size(f), f[j + 1], size({spans})) - 1].stop))"
    return f"IF(size({spans}) = 0, CAST(array() AS {PAIR}), {_let('f', first, ends)})"


def _covered(spans: str) -> str:
    """What any of ``spans`` covers, as spans apart from each other."""
    events = f"array_sort(concat(transform({spans}, x -> named_struct('at', x.start, 'by', 1L)), transform({spans}, x -> named_struct('at', x.stop, 'by', -1L))))"
    # a stop sorts before a start at the same place, so what touches is apart; no window fits between
    open_ = "filter(sequence(0, size(ev) - 1), k -> d[k] = 1 AND ev[k].by = 1)"
    close = "filter(sequence(0, size(ev) - 1), k -> d[k] = 0)"
    pairs = f"zip_with({open_}, {close}, (a, b) -> named_struct('start', ev[a].at, 'stop', ev[b].at))"
    depth = _let("by", "transform(ev, x -> x.by)", _let("d", _running("by"), pairs))
    return f"IF(size({spans}) = 0, CAST(array() AS {PAIR}), {_let('ev', events, depth)})"


def _apart(words: str, taken: str) -> str:
    """(start, m): the parts of ``words`` (start, stop, m, in order, not overlapping) outside of ``taken``
    (start, stop, likewise) that hold a window. Both are names of arrays."""
    # one running sum counts words begun, and whether a word and a taken span are open
    word, span = 1 << 42, 1 << 21
    events = f"""array_sort(concat(
        flatten(transform({words}, x -> array(named_struct('at', x.start, 'by', {word + 1}L), named_struct('at', x.stop, 'by', -1L)))),
        flatten(transform({taken}, x -> array(named_struct('at', x.start, 'by', {span}L), named_struct('at', x.stop, 'by', -{span}L))))))"""
    free = f"filter(sequence(0, size(ev) - 2), k -> d[k] % {word} = 1 AND ev[k + 1].at - ev[k].at >= {WIDTH})"
    part = lambda w: f"named_struct('start', ev[k].at, 'm', substring({w}.m, CAST(ev[k].at - {w}.start AS int) + 1, CAST(ev[k + 1].at - ev[k].at AS int)))"
    parts = f"transform({free}, k -> {part(f'{words}[CAST(d[k] div {word} AS int) - 1]')})"
    cut = _let("ev", events, _let("by", "transform(ev, x -> x.by)", _let("d", _running("by"), parts)))
    whole = f"transform({words}, x -> named_struct('start', x.start, 'm', x.m))"
    return f"CASE WHEN size({taken}) = 0 OR size({words}) = 0 THEN {whole} ELSE {cut} END"


def _stretches(word: str, least: float) -> str:
    """Spans of a part of at most PART + WIDTH - 1 ASCII characters that windows of at least ``least``
    bits cover. Events add the symbol that enters a window and take the one that leaves."""
    events = f"""flatten(transform(sequence(1, size(q)), i -> IF(i > {WIDTH},
        array(named_struct('at', q[i - {WIDTH + 1}] + 1, 'by', -1, 'i', 0), named_struct('at', q[i - 1] + 1, 'by', 1, 'i', i)),
        array(named_struct('at', q[i - 1] + 1, 'by', 1, 'i', IF(i < {WIDTH}, 0, i))))))"""
    term = "array(" + ", ".join(f"{n * math.log2(max(n, 1))!r}D" for n in range(WIDTH + 1)) + ")"
    most = WIDTH * (math.log2(WIDTH) - least)  # of the sum of c * log2(c)
    passed = f"(e.i > 0 AND v <= {most!r}D)"
    apart = f"(s.first >= 0 AND e.i - {WIDTH} > s.last)"  # ``last``: where the last window that passed ends
    span = "named_struct('start', CAST(s.first AS bigint), 'stop', CAST(s.last AS bigint))"
    step = f"""named_struct('counts', overlay(s.counts PLACING char(n + e.by + 48) FROM e.at FOR 1), 'total', v,
            'first', IF({passed} AND (s.first < 0 OR {apart}), e.i - {WIDTH}, s.first), 'last', IF({passed}, e.i, s.last),
            'done', IF({passed} AND {apart}, array_append(s.done, {span}), s.done))"""
    step = _let("n", "ascii(substring(s.counts, e.at, 1)) - 48", _let("v", f"s.total + {term}[n + e.by] - {term}[n]", step))
    spans = f"""aggregate({events}, named_struct('counts', repeat('0', 128), 'total', 0D, 'first', -1, 'last', -1, 'done', CAST(array() AS {PAIR})),
        (s, e) -> {step}, s -> IF(s.first < 0, s.done, array_append(s.done, {span})))"""
    return _let("q", f"transform(split({word}, ''), c -> ascii(c))", spans)


def _entropy_spans(parts: str, least: float) -> str:
    """Spans of all ``parts`` (start, m), in order. Longer ones are scanned in pieces that share WIDTH - 1
    characters, and what passes on both sides of a cut is one span."""
    cut = f"regexp_extract_all(y.m, '(?s).{{1,{PART}}}', 0)"
    local = f"transform({_stretches('c', least)}, w -> named_struct('start', y.start + k * {PART} + w.start, 'stop', y.start + k * {PART} + w.stop))"
    pieces = f"transform(transform(p, (c, k) -> concat(c, substring(coalesce(get(p, k + 1), ''), 1, {WIDTH - 1}))), (c, k) -> IF(length(c) < {WIDTH}, CAST(array() AS {PAIR}), {local}))"
    of_part = _let("p", cut, _let("w", f"flatten({pieces})", _joined("w")))
    return f"flatten(transform({parts}, y -> {of_part}))"


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``base`` and ``found``: arrays of (start, rank, stop, kind), in order.

    Offsets are code points, ``stop`` is exclusive. ``base`` has the known formats (assign, access,
    hex), ``found`` those and the entropy spans, which no known format overlaps. Null and empty texts have
    empty arrays. Very long texts, matches and candidates are scanned whole, in time that grows with them. Each row is
    scanned alone, so repeated rows give repeated results; columns named ``base`` or ``found`` are
    replaced, others pass. An empty table gives an empty result.
    """
    t = "__text"
    kinds = ["assign", "access", "hex", *(c[0] for c in CLASSES)]
    span = lambda kind, x="x": f"named_struct('start', CAST({x}.start AS int), 'rank', {kinds.index(kind)}, 'stop', CAST({x}.stop AS int), 'kind', '{kind}')"
    value = f"length(regexp_extract(x.m, {_sql(ASSIGN)}, 1)) >= {ASSIGN_VALUE}"
    base = f"""array_sort(concat(
        transform(filter({_matches(t, ASSIGN)}, x -> {value}), x -> {span('assign')}),
        transform({_matches(t, ACCESS)}, x -> {span('access')}),
        transform({_matches(t, HEX)}, x -> {span('hex')})))"""
    out = with_columns(docs, __text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = with_columns(out, base=F.expr(base))
    # one step a column: the analyser resolves nested functions a level at a time
    out = with_columns(out, __taken=F.expr(_covered("base")))
    words, parts, added = {}, {}, []
    for i, (kind, pattern, least) in enumerate(CLASSES):
        allowed = [*ALLOWED, r"^[0-9A-Fa-f]+$"] if kind == "entropy_base64" else [r"^[0-9]+$", ALLOWED[-1]]
        clean = " AND ".join(f"NOT regexp_like(x.m, {_sql(a)})" for a in allowed)
        words[f"__words{i}"] = F.expr(f"filter({_matches(t, pattern)}, x -> {clean})")
        parts[f"__parts{i}"] = F.expr(_apart(f"__words{i}", "__taken"))
        added.append(f"transform({_entropy_spans(f'__parts{i}', least)}, x -> {span(kind)})")
    out = with_columns(with_columns(out, **words), **parts)
    out = with_columns(out, found=F.expr(f"array_sort(concat(base, {', '.join(added)}))"))
    return out.drop("__text", "__taken", *words, *parts)


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    listed = lambda c: f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    count = lambda kind: F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    found = scan_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.expr(f"sha2({listed('base')}, 256)").alias("base_sha256"), F.expr(listed("found")).alias("spans"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def matches(name, pattern):
        p = quoted(pattern)
        return f"""{name}_m AS (SELECT r, unnest(regexp_extract_all(text, {p})) AS m, generate_subscripts(regexp_extract_all(text, {p}), 1) AS i, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS ms FROM d),
{name} AS (SELECT r, m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start FROM {name}_m)"""

    def entropy(kind, name, least, allowed):
        clean = " AND ".join(f"NOT regexp_matches(m, {quoted(a)})" for a in allowed)
        return f"""{name}_w AS (SELECT r, start, m, unnest(range(1, length(m) - {WIDTH - 2})) AS i FROM {name} WHERE {clean}),
{name}_p AS (SELECT r, start, start + i - 1 AS pos FROM {name}_w WHERE list_aggregate(string_split(substring(m, i, {WIDTH}), ''), 'entropy') >= {least}),
{name}_f AS (SELECT * FROM {name}_p AS p WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.r = p.r AND b.start < p.pos + {WIDTH} AND p.pos < b.stop)),
{name}_n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY r, start ORDER BY pos) <= {WIDTH} THEN 0 ELSE 1 END AS new FROM {name}_f),
{name}_g AS (SELECT *, sum(new) OVER (PARTITION BY r, start ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM {name}_n),
{name}_s AS (SELECT r, min(pos) AS start, max(pos) + {WIDTH} AS stop, '{kind}' AS kind FROM {name}_g GROUP BY r, {name}_g.start, g)"""

    hexes, base64 = CLASSES
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)"""
    whole = assign.replace("((?:", "(?:", 1)[:-1] + r"[A-Za-z0-9+/_.=-]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{matches('a', whole)},
{matches('k', ACCESS)},
{matches('x', HEX)},
{matches('h', r'[0-9A-Za-z]{20,}')},
{matches('b', base64[1])},
base AS (
  SELECT r, start, start + length(m) AS stop, 'assign' AS kind, 0 AS rank FROM a WHERE length(regexp_extract(m, {quoted(assign + r'(.*)')}, 2)) >= {ASSIGN_VALUE}
  UNION ALL SELECT r, start, start + length(m), 'access', 1 FROM k UNION ALL SELECT r, start, start + length(m), 'hex', 2 FROM x),
hx AS (SELECT * FROM h WHERE regexp_full_match(m, '[0-9A-Fa-f]+')),
{entropy(hexes[0], 'hx', hexes[2], [r'^[0-9]+$', ALLOWED[-1]])},
{entropy(base64[0], 'b', base64[2], [*ALLOWED, r'^[0-9A-Fa-f]+$'])},
more AS (SELECT *, 3 AS rank FROM hx_s UNION ALL SELECT *, 4 FROM b_s),
found AS (SELECT * FROM base UNION ALL SELECT * FROM more),
s AS (SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)
"""


ORACLE = _oracle()
