"""SQL twins, written from the contracts and in another shape than the queries."""

from __future__ import annotations

from cohortlane.llm.licenses import COMMENT, ENDS, LEAD, NAMED, OPEN, RULES, SCRIPT, SENTENCES, VERSION
from cohortlane.llm.quality_rules import BOILERPLATE, NAVIGATION
from cohortlane.llm.quality_rules import ENDS as ENDS_OF_LINES

_NAV = ", ".join("'" + x.replace("'", "''") + "'" for x in NAVIGATION)
_ENDS7 = ENDS_OF_LINES.replace("'", "''")

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), named AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM windows),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM named) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)
), judged AS (
  SELECT doc_id, line, pos, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS solid,
    length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
    length(regexp_replace(line, '[^!#*$%&|<>~^]', '', 'g')) AS noise,
    length(regexp_replace(line, '[^|»›•]', '', 'g')) AS seps,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
    lower(line) AS low
  FROM lines
), menus AS (
  SELECT *, (n BETWEEN 1 AND 3 AND NOT regexp_matches(rtrim(line, ' '), '[{_ENDS7}]$'))::INT AS item FROM judged
), runs AS (
  SELECT *, pos - sum(item) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM menus
), sized AS (
  SELECT *, CASE WHEN item = 1 THEN sum(item) OVER (PARTITION BY doc_id, run, item) ELSE 0 END AS items FROM runs
), failing AS (
  SELECT *, (noise >= 3 AND noise * 100 > chars * 15) OR (seps >= 3 AND seps * 4 >= n)
    OR trim(low) IN ({_NAV}) OR (n <= 15 AND regexp_matches(low, '{"|".join(BOILERPLATE)}')) OR items >= 4 AS fails
  FROM sized
), by_doc AS (
  SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(DISTINCT line) FILTER (solid) AS n_distinct,
    count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost_chars
  FROM failing GROUP BY doc_id
), figures AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (n_lines - n_distinct)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    n_lines, n_failed_lines, lost_chars
  FROM w JOIN by_doc USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars * 100 <= word_chars * 40 AS kept
FROM figures
"""

_CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
             "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>")


def _escaped_chars(column: str) -> str:
    broken = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
    return f"length({column}) + length({column}) - length(replace({column}, chr(92), '')) + {broken}"


OP1 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_escaped_chars("role")} + {_escaped_chars("text")} + 33)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

# Lower-cases A-Z alone, as the contract says.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS5 = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS5} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS5} AS ws FROM benchmark),
places AS (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 12) AS g, least(13, len(ws)) AS n FROM places),
spread AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
pieces AS (
  SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS g
  FROM spread, (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(ws)
),
hits AS (SELECT doc_id, i, item_id, windows.n FROM pieces JOIN windows ON pieces.g = windows.g AND pieces.n = windows.n),
words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM hits), (SELECT unnest(range(0, 13)) AS k) WHERE k < n GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), places AS (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM d WHERE len(ws) > 0),
grams AS (SELECT DISTINCT doc_id, hash(list_slice(ws, i, i + 3)) AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM ways UNION SELECT node, b FROM reach JOIN ways ON other = a),
lowest AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON lowest.node = d.doc_id
"""

def _license_rules() -> str:
    """One step per rule: the text that is left, and the licences so far."""
    steps = ["r0 AS (SELECT doc_id, ' ' || spaced || ' ' AS seq, []::VARCHAR[] AS names FROM found)"]
    for i, (name, rule) in enumerate(RULES):
        p = "".join(f"( {w[:-1]} )?" if w.endswith("?") else f" {w} " for w in rule.split())
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT doc_id, regexp_replace(seq, '{p}', ' | ', 'g') AS seq, "
            f"CASE WHEN regexp_matches(seq, '{p}') AND NOT list_contains(names, '{name}') "
            f"THEN list_append(names, '{name}') ELSE names END AS names FROM r{i})"
        )
    return ",\n".join(steps)


def _bare(text: str) -> str:
    plain = (
        f"trim(regexp_replace(replace(replace(lower({text}), 'licence', 'license'), 'https', 'http'), "
        "'[^a-z0-9.+-]+', ' ', 'g'))"
    )
    bare = f"trim(regexp_replace(regexp_replace({plain}, '([.+-]+( |$))|(^[.+-]+)', ' ', 'g'), ' +', ' ', 'g'))"
    bare = f"regexp_replace({bare}, '{LEAD}', 'under ')"
    for form, instead in NAMED:
        bare = f"regexp_replace({bare}, '{form}', '{instead}')"
    return bare


_KNOWN = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
_PLAIN8 = "replace(coalesce(text, ''), chr(13), '')"
for _form, _instead in ((SCRIPT, "\n"), (COMMENT, "\\1"), (VERSION, "\\1 \\2"), (ENDS, "\\1\n")):
    _PLAIN8 = f"regexp_replace({_PLAIN8}, '{_form}', '{_instead}', 'g')"
OP8 = f"""
WITH known(sentence, id) AS (VALUES {_KNOWN}),
d AS (SELECT doc_id, string_split({_PLAIN8}, chr(10)) AS ps FROM documents),
piece AS (SELECT doc_id, unnest(list_transform(ps, lambda x: trim(x))) AS p, unnest(range(len(ps))) AS i FROM d),
ended AS (
  SELECT doc_id, i, CASE WHEN id IS NOT NULL THEN chr(10) || p || chr(10)
    WHEN p = '' OR regexp_matches(p, '[.!?;:]$') THEN p || chr(10) ELSE p || ' ' END AS part
  FROM piece LEFT JOIN known ON sentence = {_bare("p")}
),
whole AS (SELECT doc_id, string_split(string_agg(part, '' ORDER BY i), chr(10)) AS ss FROM ended GROUP BY doc_id),
spread AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM whole),
named AS (SELECT doc_id, i, id FROM spread JOIN known ON sentence = {_bare("s")}),
found AS (
  SELECT doc_id, string_agg(id, ' ' ORDER BY i) AS ids, string_agg(id, '  ' ORDER BY i) AS spaced, count(*) AS n
  FROM named GROUP BY doc_id
),
{_license_rules()}
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentences,
  coalesce(array_to_string(names, ','), '') AS licenses,
  coalesce(len(names) > 0 AND len(list_filter(names, lambda x: x NOT IN ({", ".join(f"'{x}'" for x in OPEN)}))) = 0, false) AS open
FROM documents LEFT JOIN found USING (doc_id) LEFT JOIN r{len(RULES)} USING (doc_id)
"""

# CRC-32 of a text's UTF-8 bytes: its table by the polynomial's rule, then a step per byte.
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) r(i)
)"""


def _crc(text: str) -> str:
    digits = f"hex(encode({text}))"
    values = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr({digits}, 2 * k + 1, 2))::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {values}), "
        "lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295)"
    )


OP11 = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_WORDS5} AS ws FROM documents),
feats AS (SELECT doc_id, unnest(ws) AS w FROM d),
wanted AS (SELECT unnest({_WORDS5}) AS w FROM benchmark),
named AS (SELECT w FROM feats UNION SELECT w FROM wanted),
bucket AS MATERIALIZED (SELECT w, {_crc("w")} % 10000 AS b FROM named, crc),
s AS (SELECT b, count(*) AS s FROM feats JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM wanted JOIN bucket USING (w) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM feats)::DOUBLE AS s, (SELECT count(*) FROM wanted)::DOUBLE AS t),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (total.s + 10000)
    / ((coalesce(s.s, 0) + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g
  FROM s FULL JOIN t USING (b), total
),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM feats JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)
),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS r, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

_LEFT_OUT = "left(w, i::INT - 1) || substr(w, i::INT + 1)"

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[a-z\u00C0-\u00FF]+')) AS w FROM documents
),
own AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT w, n, {_crc("(doc_id || ':' || w)")} AS h FROM own, crc WHERE length(w) >= 7),
mended AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, n
  FROM hashed
),
words AS MATERIALIZED (
  SELECT w, sum(n)::BIGINT AS n FROM mended WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2
),
places AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words),
shorter AS MATERIALIZED (SELECT w, i, {_LEFT_OUT} AS x FROM places),
near AS MATERIALIZED (
  SELECT DISTINCT a.w AS w, b.w AS v FROM shorter a JOIN shorter b ON a.i = b.i AND a.x = b.x AND a.w <> b.w
  UNION SELECT w, x FROM shorter SEMI JOIN words y ON shorter.x = y.w
  UNION SELECT x, w FROM shorter SEMI JOIN words y ON shorter.x = y.w
),
best AS (
  SELECT near.w, count(*) AS n_near,  min(struct_pack(m := -words.n, v := v)) AS b
  FROM near JOIN words ON words.w = near.v GROUP BY near.w
),
formed AS MATERIALIZED (
  SELECT words.w, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN -b.m >= 10 * words.n THEN b.v END AS form, CASE WHEN -b.m >= 10 * words.n THEN -b.m END AS form_n
  FROM words LEFT JOIN best USING (w)
),
paths(w, place) AS (
  SELECT w, w FROM formed
  UNION ALL SELECT paths.w, formed.form FROM paths JOIN formed ON formed.w = paths.place WHERE formed.form IS NOT NULL
),
roots AS (SELECT paths.w, paths.place AS root FROM paths JOIN formed ON formed.w = paths.place WHERE formed.form IS NULL)
SELECT w AS word, form, root, n, n_near, form_n FROM formed JOIN roots USING (w)
"""

ORACLES: dict[str, str] = {
    "op1_chat": OP1,
    "op5_decontaminate": OP5,
    "op6_jaccard": OP6,
    "op7_line_rules": OP7,
    "op8_licenses": OP8,
    "op11_resample": OP11,
    "op12_spelling": OP12,
}
