"""DuckDB SQL with the same results as the operators, by plainer means."""

from __future__ import annotations

from terrane.llm.licenses import TEMPLATES
from terrane.llm.quality_rules import BASE_RULES, RULES, STOP_WORDS, Rule

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


#: The crc32 of the bytes of an ASCII column b, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(b)), lambda j: CAST(ascii(b[j // 8 + 1]) >> (j % 8) & 1 AS BIGINT))),
 lambda c, bit: CASE WHEN (c & 1) <> bit THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules() -> str:
    def failed(r: Rule) -> str:
        return f"({r.left_factor} * {r.left} {r.op} {r.right_factor} * {r.right})"

    stop = ", ".join(_quoted(w) for w in STOP_WORDS)
    base = " OR ".join(failed(r) for r in BASE_RULES)
    every = " OR ".join(failed(r) for r in (*BASE_RULES, *RULES))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
 CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals FROM d LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({every}) AS kept, n_lines, n_stop_words, n_capitals FROM m"""


def near_duplicates() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(text, '{upper}', '{lower}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM h),
r AS (SELECT s.* FROM s JOIN cls ON s.doc_id = cls.doc_id AND cls.doc_id = cls.class_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM cls WHERE doc_id = class_id UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.seen = e.a),
comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, d.doc_id = coalesce(comp.c, d.doc_id) AS kept, coalesce(cls.class_id, d.doc_id) AS class_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.node = cls.class_id"""


def repeated_words() -> str:
    return rf"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id),
cov AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM rep)),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def repeated_bytes() -> str:
    return """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, hash(s) AS h1, hash(reverse(s)) AS h2 FROM (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d))),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(g) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS g FROM rep)) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs UNION ALL SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def mixing(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 17) -> str:
    """Targets by the water level of sources in order of cap / weight; then all
    copies of all documents in one order of finish time, cut at the budget."""
    pick = f"[{', '.join(f'CAST({w} AS DOUBLE)' for w in weights)}]"
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size, md5(concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(text, ''))) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, {pick}[place % {len(weights)} + 1] AS weight, source_size * {float(epochs)} AS cap, (SELECT sum(source_size) FROM s) * CAST({share} AS DOUBLE) AS budget FROM s),
f AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
r AS (SELECT arg_min(level, cap / weight + place * 1e-9) AS level FROM f WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM r), CAST('inf' AS DOUBLE))) AS target FROM f),
q AS (SELECT doc_id, d.source, size, turn, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS own FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, (source_size * e + own) / target AS finish FROM q, range({epochs}) x(e) WHERE target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS spent FROM c),
l AS (SELECT coalesce(min(finish), CAST('inf' AS DOUBLE)) AS finish FROM o WHERE spent > (SELECT max(budget) FROM w)),
n AS (SELECT doc_id, turn, source, count(*) AS n FROM c WHERE finish < (SELECT finish FROM l) GROUP BY ALL)
SELECT q.doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.turn = n.turn AND q.source IS NOT DISTINCT FROM n.source"""


def licenses(threshold: float = 0.8) -> str:
    rows = ", ".join(f"({i}, {_quoted(name)}, {_quoted(kind)}, {_quoted(body)})" for i, (name, kind, body) in enumerate(TEMPLATES))
    tokens = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return rf"""
WITH t AS (SELECT *, {tokens.format("body")} AS w FROM (VALUES {rows}) v(template, license, kind, body)),
tb AS (SELECT DISTINCT template, license, kind, w[i] || ' ' || w[i+1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
tn AS (SELECT template, count(*) AS n FROM tb GROUP BY template),
p AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS s FROM documents
 UNION ALL SELECT doc_id, s FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n[ \t]*\r?\n\s*')) AS s FROM documents) WHERE contains(s, chr(10)))),
pw AS (SELECT doc_id, s, {tokens.format("s")} AS w FROM p),
pb AS (SELECT DISTINCT doc_id, s, w[i] || ' ' || w[i+1] AS g FROM (SELECT doc_id, s, w, unnest(range(1, len(w))) AS i FROM pw)),
pn AS (SELECT doc_id, s, count(*) AS n FROM pb GROUP BY doc_id, s),
shr AS (SELECT doc_id, s, template, license, kind, count(*) AS c FROM pb JOIN tb USING (g) GROUP BY ALL),
m AS (SELECT shr.doc_id, shr.s, license, kind, 2.0 * c / (pn.n + tn.n) AS dice FROM shr JOIN pn ON pn.doc_id = shr.doc_id AND pn.s = shr.s JOIN tn USING (template) WHERE 2.0 * c / (pn.n + tn.n) >= {threshold}),
lim AS (SELECT template, n, greatest(1, ceil(n * {threshold} / (2 - {threshold}) - 1e-9)) AS need, floor(n * (2 - {threshold}) / {threshold} + 1e-9) AS width FROM tn),
dw AS (SELECT doc_id, {tokens.format("coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM dw)),
hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY i) AS r FROM dg JOIN tb USING (g) JOIN lim USING (template)),
win AS (SELECT a.doc_id, a.template, a.license, a.kind, a.n, a.i AS a, e.i AS e FROM hit a JOIN hit e ON e.doc_id = a.doc_id AND e.template = a.template AND e.r - a.r + 1 >= a.need AND e.i - a.i < a.width),
scored AS (SELECT win.doc_id, template, license, kind, a, e, 2.0 * len(list_intersect(list(DISTINCT dg.g), any_value(known))) / (count(DISTINCT dg.g) + any_value(n)) AS d
 FROM win JOIN (SELECT template, list(g) AS known FROM tb GROUP BY template) USING (template) JOIN dg ON dg.doc_id = win.doc_id AND dg.i BETWEEN a AND e GROUP BY ALL),
best AS (SELECT * FROM scored WHERE d >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, template, a ORDER BY d DESC, e) = 1),
apart AS (SELECT doc_id, list_reduce(list([{{'a': a, 'e': e}}] ORDER BY -d, a - e, a, e, license, kind),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda v: v.a <= x[1].e + 1 AND x[1].a <= v.e + 1)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM best GROUP BY doc_id),
wm AS (SELECT doc_id, array_to_string(w[a:e+1], ' ') AS words, list_contains(kept, {{'a': a, 'e': e}}) AS own, license, kind, d FROM best JOIN apart USING (doc_id) JOIN dw USING (doc_id)),
every AS (SELECT doc_id, s, license, kind, dice FROM m UNION ALL SELECT doc_id, CASE WHEN own THEN words END, license, kind, d FROM wm WHERE NOT EXISTS
 (SELECT 1 FROM m JOIN pw ON pw.doc_id = m.doc_id AND pw.s = m.s WHERE m.doc_id = wm.doc_id AND m.license = wm.license AND contains(' ' || array_to_string(pw.w, ' ') || ' ', ' ' || wm.words || ' '))),
f AS (SELECT doc_id, count(DISTINCT s) AS n, min({{'d': -dice, 'l': license, 'k': kind}}) AS b, array_to_string(list_sort(list(DISTINCT license)), ',') AS ls FROM every GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, b.l AS license, b.k AS kind, round(-b.d, 6) AS dice, ls AS licenses FROM documents LEFT JOIN f USING (doc_id)"""


def repeated_lines(min_chars: int = 40, min_docs: int = 5) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    space = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {space}), '{upper}', '{lower}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
s AS (SELECT doc_id, i, line, coalesce(doc_id < top, FALSE) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM s GROUP BY doc_id"""


def conversations() -> str:
    """Rows from the last to the first, the best edits of all four states beside
    one another: a way is its cost in six digits and its letters, so that the
    least string is the cheapest and, of those, the ASCII-least."""
    after = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
    expects = {0: "u", 1: "u", 2: "a", 3: "u"}
    role = {"u": "user", "a": "assistant"}

    def way(to: int, cost: str, letter: str, line: str | None) -> str:
        text = f"f{to}.t" if line is None else f"{line} || CASE WHEN f{to}.t = '' THEN '' ELSE chr(10) || f{to}.t END"
        return f"{{'k': lpad(CAST(CAST(f{to}.k[1:6] AS INT) + {cost} AS VARCHAR), 6, '0') || '{letter}' || f{to}.k[7:], 't': {text}}}"

    def own(s: int) -> str:
        ways = [way(s, "3", "D", None)]
        to = after[s][-1]
        must = "fault IN ('blank', 'duplicate')"
        never = "{'k': '900000', 't': ''}"
        extra = "CAST(fault = 'truncated' AS INT)"
        ways.append(f"CASE WHEN {must} THEN {never} ELSE {way(to, '2 + ' + extra, 'R', _quoted(role[expects[s]] + ':') + ' || text')} END")
        kept = f"CASE WHEN {must} THEN {never} WHEN role[1] = '{expects[s]}' THEN {way(to, extra, 'K', 'role || chr(58) || text')}"
        kept += f" WHEN role[1] = 's' THEN {way(1, extra, 'K', 'role || chr(58) || text')}" if s == 0 else ""
        ways.append(kept + f" ELSE {never} END")
        return f"list_sort([{', '.join(ways)}])[1] AS f{s}"

    def inserted(source: str) -> str:
        now = source
        for _ in range(3):
            states = ", ".join(f"list_sort([f{s}, {way(after[s][-1], '2', 'I', _quoted(role[expects[s]] + ':'))}])[1] AS f{s}" for s in range(4))
            now = f"(SELECT conv_id, i, {states} FROM {now})"
        return now

    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    last = r"regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1)"
    end = "(SELECT conv_id, max(i) + 1 AS i, {'k': '000000', 't': ''} AS f0, {'k': '900000', 't': ''} AS f1, {'k': '900000', 't': ''} AS f2, {'k': '000000', 't': ''} AS f3 FROM g GROUP BY conv_id)"
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS b FROM conversations),
z AS (SELECT * EXCLUDE (b), {CRC32} % 20 AS d FROM o),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE d <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM m),
g AS (SELECT conv_id, turn, role, text, i, CASE WHEN {blank} THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN {last} NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
 lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two FROM n),
w(conv_id, i, f0, f1, f2, f3) AS (SELECT * FROM {inserted(end)}
 UNION ALL SELECT * FROM {inserted("(SELECT g.conv_id, g.i, " + ", ".join(own(s) for s in range(4)) + " FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i - 1)")}),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
r AS (SELECT conv_id, f0 FROM w WHERE i = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(f0.k[1:6], '0') AS BIGINT) AS cost, coalesce(f0.k[7:], '') AS audit, sha256(coalesce(f0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id"""


def periodic_runs() -> str:
    """Every pair of equal words at most a quarter of the text apart; stretches
    of such pairs of one distance are runs."""
    return rf"""
WITH b AS (SELECT doc_id, {WORDS.format("text")} AS w, CAST(doc_id AS VARCHAR) AS b FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, {CRC32} AS h FROM b),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
i AS (SELECT doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda x: CASE WHEN x < a THEN x ELSE a + (x - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END) ELSE range(n) END AS src FROM a),
v AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(src) AS k, w FROM i),
x AS MATERIALIZED (SELECT doc_id, n, i, w[k + 1] AS x FROM v),
e AS (SELECT p.doc_id, p.i, q.i - p.i AS q FROM x p JOIN x q ON p.doc_id = q.doc_id AND p.x = q.x AND q.i > p.i AND q.i - p.i <= p.n // 4),
g AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, l, min(q) AS q FROM g GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_runs, min({{'l': -l, 's': s, 'q': q}}) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM r GROUP BY doc_id)
SELECT i.doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.q AS period, 1000 * -b.l // b.q AS exponent_milli,
 sha256(coalesce(f.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256 FROM i LEFT JOIN f USING (doc_id) LEFT JOIN kept USING (doc_id)"""
