"""SQL twins of the registered queries, in DuckDB's dialect, where SQL can express them."""

from __future__ import annotations

from wordloom.llm import audit, chat, collocations, jaccard, quality, substrings

_WORD = r"[^\x20\x09-\x0D]+"


_LETTERS, _DIGITS, _SPACES, _POINTS = r"[^\p{L}]+", r"[^\p{N}]+", r"[^ \x09-\x0D]+", "[^.,;:!?''\"()-]+"


def _class_count(pattern: str) -> str:
    return f"length(regexp_replace(t, '{pattern}', '', 'g'))"


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists."""

    def toward(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"

    a, b = f"{p}[i]", f"{q}[i]"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({toward(a, b)} + {toward(b, a)}) / 2)), 0))"


OP1 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws
  FROM documents),
classed AS (
  SELECT doc_id, lang, t, ws,
    {_class_count('[^a-z]+')} AS lo, {_class_count('[^A-Z]+')} AS up, {_class_count(_LETTERS)} AS le,
    {_class_count(_DIGITS)} AS di, {_class_count(_POINTS)} AS po, {_class_count('[^#*$%&|<>]+')} AS sy,
    {_class_count(_SPACES)} AS wh
  FROM base),
counted AS (
  SELECT *, [lo, up, le - lo - up, di, po, sy, wh, length(t) - le - di - po - sy - wh] AS c FROM classed),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base)),
twins AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twins, range(5) r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, lang, ws, c, len(ws)::BIGINT AS n_words, (length(t) - wh)::BIGINT AS word_chars, sy::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM counted d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN covered v ON v.doc_id = d.doc_id),
freq AS (
  SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM base) GROUP BY lang, w),
totals AS (SELECT lang, sum(n) AS total FROM freq GROUP BY lang HAVING sum(n) >= {quality.MIN_REFERENCE_WORDS}),
ranked AS (
  SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(w)) AS r FROM freq WHERE n > 1),
tops AS (
  SELECT lang, list(w ORDER BY r) AS rw, list(n ORDER BY r) AS rn FROM ranked WHERE r <= {quality.COMMON_WORDS} GROUP BY lang),
class_refs AS (
  SELECT lang, list(s ORDER BY k) AS rc
  FROM (SELECT lang, k, sum(c[k]) AS s FROM counted, range(1, 9) r(k) GROUP BY lang, k) GROUP BY lang),
refs AS (
  SELECT lang, rw, list_transform(list_append(rn, total - list_sum(rn)), lambda x: x / total) AS rp,
         list_transform(rc, lambda x: x / list_sum(rc)) AS rq,
         list_transform(range(1, len(rw) + 2), lambda i: CASE WHEN i > len(rw) THEN 1.0 ELSE 0.0 END) AS rz
  FROM tops JOIN totals USING (lang) JOIN class_refs USING (lang)),
shares AS (
  SELECT m.*, rw, rp, rq, rz,
    list_transform(rw, lambda r: len(list_filter(ws, lambda x: x = r))) AS own,
    CASE WHEN word_chars >= {quality.MIN_CLASS_CHARS} THEN list_transform(c, lambda x: x / list_sum(c)) END AS cs
  FROM measured m LEFT JOIN refs USING (lang)),
distances AS (
  SELECT *,
    CASE WHEN rw IS NOT NULL AND cs IS NOT NULL THEN {_js('cs', 'rq')} END AS cd,
    CASE WHEN rw IS NOT NULL AND n_words >= {quality.MIN_HISTOGRAM_WORDS} THEN {_js("wsh", "rp")} END AS wd,
    least({quality.MAX_WORD_DISTANCE}, {quality.MAX_WORD_SHARE} * {_js("rz", "rp")}) AS most_wd
  FROM (SELECT *, list_transform(list_append(own, n_words - list_sum(own)), lambda x: x / n_words) AS wsh FROM shares)),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM distances)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
       NOT base_failed AND coalesce(cd, 0) <= {quality.MAX_CLASS_DISTANCE} AND (wd IS NULL OR wd <= most_wd) AS kept
FROM judged
"""


def _escaped(column: str) -> str:
    """Backslashes doubled, one more in each control string; twice for '<<', which may overlap."""
    out = f"replace({column}, '\\', '\\\\')"
    for text in ("<|", "</", "<s", "<<", "<<", "[INST]", "[/INST]"):
        out = f"replace({out}, '{text}', '{text[0]}\\{text[1:]}')"
    return out


OP3 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {chat.EXAMPLE_ID}, 0, 'user', '{chat.EXAMPLE_TEXT}'
  UNION ALL SELECT {chat.EXAMPLE_ID}, 1, 'assistant', '{chat.EXAMPLE_TEXT}'),
shaped AS (
  SELECT *, length({_escaped('text')}) + length(replace({_escaped('role')}, chr(10), '\' || chr(10)))
            + {len(chat.START) + len(chat.END) + 2} AS chars FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS everything,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned
  FROM shaped GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars
FROM joined
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP6 = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {jaccard.WIDTH - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {jaccard.WIDTH - 2}, 2))) AS i FROM base WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {jaccard.PERCENT} * (x.n + y.n - k)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

OP8 = f"""
WITH base AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p, substr(h, 2 * p - 1, {2 * substrings.LENGTH}) AS s
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - {substrings.LENGTH - 2})) AS p FROM base)),
repeated AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id),
bytes AS (
  SELECT b.doc_id, b.i, b.x, max(CASE WHEN r.p IS NULL THEN 0 ELSE 1 END)
           OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN {substrings.LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM base)) b
  LEFT JOIN repeated r ON r.doc_id = b.doc_id AND r.p = b.i),
runs AS (
  SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM bytes),
summed AS (
  SELECT doc_id, count(*) AS n, sum(gone) AS g, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS spans,
         coalesce(string_agg(CASE WHEN gone = 0 THEN x END, '' ORDER BY i), '') AS kept
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(g, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM base d LEFT JOIN summed USING (doc_id)
"""

OP11 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
failed AS (
  SELECT doc_id, part,
    len(ws) < {audit.MIN_WORDS} AS a, 100 * len(list_distinct(ws)) < {audit.MIN_DISTINCT_PERCENT} * len(ws) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {audit.MAX_UPPER_PERCENT} * length(t) AS c,
    regexp_matches(t, '{audit.SYMBOLS}') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM base),
masked AS (
  SELECT part, (a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT) AS mask,
         coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic
  FROM failed f LEFT JOIN labels l ON l.doc_id = f.doc_id),
sets AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT substr('{audit.FILTERS}', i + 1, 1) AS x, (1 << i)::INT AS bit FROM range(5) r(i)),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (
  SELECT filter_order, k::INT AS step, (SELECT bit FROM letters WHERE x = substr(filter_order, k, 1)) AS own
  FROM orders, range(1, 6) r(k)),
placed AS (
  SELECT *, coalesce(sum(own) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before
  FROM steps),
counted AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM placed, sets GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""

_CUTS = r"[.,;:!?\x0A-\x0D]"
OP13 = rf"""
WITH pieces AS (
  SELECT lang, p, row_number() OVER () AS id
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_CUTS}')) AS p
        FROM documents)),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded WHERE len(ws) > 0),
counted AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM placed, range(1, {collocations.MAX_WORDS + 1}) r(k) WHERE i + k - 1 <= len(ws) GROUP BY lang, k, phrase HAVING count(*) >= {collocations.MIN_COUNT}),
split AS (SELECT *, string_split(phrase, ' ') AS ws FROM counted),
cuts AS (
  SELECT s.lang, s.phrase, s.k, s.a, c, x.a AS l, y.a AS r,
         ({collocations.SCORE_SCALE}::HUGEINT * s.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM split WHERE k > 1) s
  JOIN counted x ON x.lang = s.lang AND x.phrase = array_to_string(s.ws[1:c], ' ')
  JOIN counted y ON y.lang = s.lang AND y.phrase = array_to_string(s.ws[c + 1:s.k], ' ')),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS t FROM cuts) WHERE t = 1),
inner_parts AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM split, range(2, {collocations.MAX_WORDS}) q(m), range(1, {collocations.MAX_WORDS}) p(i)
  WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
kept AS (
  SELECT w.* FROM lowest w LEFT JOIN inner_parts p ON p.lang = w.lang AND p.phrase = w.phrase
  WHERE p.longer IS NULL OR 100 * p.longer::HUGEINT < {collocations.CONTAINED_PERCENT} * w.a::HUGEINT),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= {collocations.TOP}
"""

ORACLES = {"op1_quality": OP1, "op3_chat": OP3, "op6_jaccard": OP6, "op8_substrings": OP8, "op11_audit": OP11, "op13_collocations": OP13}
