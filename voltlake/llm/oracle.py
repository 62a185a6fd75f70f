"""DuckDB SQL for the corpus queries that SQL can express."""

from voltlake.llm import quality_rules as rules, spelling, warc
from voltlake.llm.licenses import LEAST_DICE, TEMPLATES
from voltlake.llm.text import LOWER, UPPER

EXACT_DEDUP = f"""
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
), classes AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM norm JOIN classes USING (norm)
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') AS key FROM lines
), repeats AS (
  SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, coalesce(keep_id <> doc_id, FALSE) AS gone
  FROM keyed LEFT JOIN repeats USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""

# All pairs that share a shingle, then the least doc_id that paths of links reach.
NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * k >= 75 * (x.n + y.n - k)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _without(sql: str, pattern: str) -> str:
    return f"regexp_replace({sql}, {_text(pattern)}, '', 'g')"


_NAMES = "[" + ", ".join(_text(name) for name in warc.NAMED) + "]"
_CHARACTERS = "[" + ", ".join(_text(c) for c in warc.NAMED.values()) + "]"
_CODES = list(warc.WINDOWS)
_MEANT = "[" + ", ".join(_text(c) for c in warc.WINDOWS.values()) + "]"


def _uuid(*parts: str) -> str:
    digest = f"sha256(concat_ws('|', {', '.join(parts)}))"
    cuts = ", ".join(f"{digest}[{a}:{b}]" for a, b in ((1, 8), (9, 12), (13, 16), (17, 20), (21, 32)))
    return f"'<urn:uuid:' || concat_ws('-', {cuts}) || '>'"


_RUN = "'[ \\t\\r\\n\\f]+'"
_BODY = f"regexp_replace({_without('shown', warc.HEAD)}, {_RUN}, ' ', 'g')"
_LINED = _without(f"regexp_replace({_BODY}, {_text(warc.BREAK)}, chr(10), 'g')", warc.TAG)
_LINE_ENDS = "'[\\r\\n]', '', 'g'"
_CRLF = "chr(13) || chr(10)"

# Texts are cut at ampersands; what follows one begins with a reference or does not.
WARC = f"""
WITH pages_ AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html
  FROM pages
), responses AS (
  SELECT r, page_id, strlen(html) AS size, {_without("html", warc.HIDDEN)} AS shown,
         regexp_replace(url, {_LINE_ENDS}) AS target_uri, 'sha256:' || sha256(html) AS payload_digest,
         {_uuid("'response'", "coalesce(page_id::VARCHAR, 'null')", "url", "sha256(html)")} AS id
  FROM pages_
), links AS (
  SELECT r, regexp_extract_all(shown, {_text(warc.LINK)}, 1) AS found FROM responses
), attributes AS (
  SELECT r, 'lang' AS kind, 0 AS n, regexp_extract(shown, {_text(warc.LANG)}, 1) AS x FROM responses
  UNION ALL SELECT r, 'link', generate_subscripts(found, 1), unnest(found) FROM links
), written AS (
  SELECT r, 'title' AS kind, 0 AS n, regexp_extract(shown, {_text(warc.TITLE)}, 1) AS x FROM responses
  UNION ALL SELECT r, 'text', 0, {_LINED} FROM responses
  UNION ALL SELECT r, kind, n, CASE WHEN x[1] IN (chr(34), chr(39)) THEN x[2:length(x) - 1] ELSE x END
  FROM attributes
), parts AS (
  SELECT r, kind, n, unnest(string_split(x, '&')) AS part,
         generate_subscripts(string_split(x, '&'), 1) AS i FROM written
), named AS (
  SELECT *, string_split(part, ';')[1] AS name FROM parts
), numbered AS (
  SELECT *, CASE WHEN regexp_matches(name, '{warc.DECIMAL}') THEN name[2:]::INTEGER
    WHEN regexp_matches(name, '{warc.HEXADECIMAL}') THEN ('0x' || name[3:])::INTEGER END AS code
  FROM named
), known AS (
  SELECT *, CASE WHEN code IS NULL THEN {_CHARACTERS}[list_position({_NAMES}, name)]
    WHEN code BETWEEN 1 AND 32 OR code = 160 THEN ' '
    WHEN code BETWEEN 128 AND 159 THEN {_MEANT}[list_position({_CODES}, code)]
    WHEN code BETWEEN 33 AND 55295 OR code BETWEEN 57344 AND 1114111 THEN chr(code) END AS c
  FROM numbered
), decoded AS (
  SELECT r, kind, n, string_agg(CASE WHEN i = 1 THEN part
    WHEN contains(part, ';') AND length(name) <= 10 AND c IS NOT NULL THEN c || part[length(name) + 2:]
    ELSE '&' || part END, '' ORDER BY i) AS x
  FROM known GROUP BY r, kind, n
), read AS (
  SELECT r, max(x) FILTER (kind = 'title') AS title, max(x) FILTER (kind = 'text') AS text,
    regexp_replace(max(x) FILTER (kind = 'lang'), {_LINE_ENDS}) AS lang,
    coalesce(string_agg('outlink: ' || regexp_replace(x, {_LINE_ENDS}) || {_CRLF}, '' ORDER BY n)
      FILTER (kind = 'link'), '') AS outlinks
  FROM decoded GROUP BY r
), blocks AS (
  SELECT responses.*, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace(title, {_RUN}, ' ', 'g'), ' ') || {_CRLF} ||
    'languages-declared: ' || lang || {_CRLF} || 'sourceLength: ' || size || {_CRLF} ||
    'sourceDigest: ' || payload_digest || {_CRLF} || outlinks AS block
  FROM responses JOIN read USING (r)
  UNION ALL
  SELECT responses.*, 'conversion', 'text/plain',
    trim(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))
  FROM responses JOIN read USING (r)
)
SELECT page_id, warc_type, {_uuid("warc_type", "id")} AS record_id, id AS refers_to, target_uri,
       '{warc.FETCHED}' AS warc_date, content_type, payload_digest,
       'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length, block
FROM blocks
"""

_TEMPLATES = ", ".join(f"({i}, {_text(n)}, {_text(t)})" for i, (n, t) in enumerate(TEMPLATES))


def _word_list(sql: str) -> str:
    plain = f"regexp_replace(translate({sql}, '{UPPER}', '{LOWER}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    return f"string_split(trim({plain}, ' '), ' ')"


def _bigrams(words: str) -> str:
    return (
        f"CASE WHEN len({words}) > 1 THEN list_transform(range(1, len({words})), "
        f"lambda i: {words}[i] || ' ' || {words}[i + 1]) ELSE {words} END"
    )


_LEAST_SIZE = f"ceil(n * {LEAST_DICE} / {2 - LEAST_DICE} - 1e-9)"

def _best_in_turn(found: str, name: str, keys: str) -> str:
    """Best rows of stretches in which each middle lies before the end of an earlier one."""
    order = f"PARTITION BY {keys} ORDER BY start, n_words DESC, id ROWS"
    return f"""{name}_opened AS (
  SELECT *, coalesce(start + n_words // 2 >= max(start + n_words) OVER (
    {order} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)::INTEGER AS opens FROM {found}
), {name}_stretches AS (
  SELECT *, sum(opens) OVER ({order} UNBOUNDED PRECEDING) AS stretch FROM {name}_opened
), {name} AS (
  SELECT * EXCLUDE (opens, stretch) FROM {name}_stretches QUALIFY row_number() OVER (
    PARTITION BY {keys}, stretch ORDER BY common DESC, dice DESC, license_id, start, n_words, id) = 1
)"""


# Every place of a template's telling bigrams gives a window; no bound on sizes.
LICENSES = f"""
WITH templates(id, license_id, text) AS (VALUES {_TEMPLATES}),
worded AS (SELECT id, license_id, {_word_list("text")} AS w FROM templates),
listed AS (SELECT *, len(w) AS width, {_bigrams("w")} AS p FROM worded),
known AS (SELECT *, list_distinct(p) AS own, len(list_distinct(p)) AS n FROM listed),
ranked AS (
  SELECT id, n, pair, row_number() OVER (PARTITION BY id ORDER BY common, -length(pair), pair) AS k
  FROM (SELECT id, n, unnest(own) AS pair FROM known)
  JOIN (SELECT unnest(own) AS pair, count(*) AS common FROM known GROUP BY 1) USING (pair)
), telling AS (
  SELECT id, pair FROM ranked WHERE k <= n - ceil({LEAST_DICE} * (n + {_LEAST_SIZE}) / 2 - 1e-9) + 1
), places AS (
  SELECT id, pair, off FROM (
    SELECT id, unnest(p) AS pair, unnest(range(len(p))) AS off FROM known) JOIN telling USING (id, pair)
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_word_list("coalesce(text, '')")} AS w FROM documents
), pairs AS (
  SELECT row, unnest({_bigrams("w")}) AS pair, unnest(range(greatest(len(w) - 1, 1))) AS i FROM docs
), begun AS (
  SELECT DISTINCT row, id, i - off AS s FROM pairs JOIN places USING (pair)
), placed AS (
  SELECT row, doc_id, id, license_id, own, n AS nt, greatest(s, 0) AS start,
         least(s + width, len(docs.w)) - greatest(s, 0) AS n_words, docs.w[greatest(s, 0) + 1:s + width] AS x
  FROM begun JOIN known USING (id) JOIN docs USING (row)
), compared AS (
  SELECT DISTINCT * EXCLUDE (x), list_distinct({_bigrams("x")}) AS p FROM placed
), alike AS (
  SELECT row, doc_id, id, license_id, start, n_words, len(p) AS n, len(list_intersect(p, own)) AS common,
         2e0 * common / (len(p) + nt) AS dice
  FROM compared WHERE dice >= {LEAST_DICE}
), {_best_in_turn("alike", "per_template", "row, id")}, {_best_in_turn("per_template", "notices", "row")}
SELECT doc_id, start, n_words, license_id, dice, n AS n_bigrams FROM notices
"""


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
# The checksum of the bytes of a text, from a table of what each byte does.
_CRC_TABLE = """
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32; a column t with the table has to be at hand."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || {digits}[2 * i - 1:2 * i])::UBIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INTEGER + 1])), 4294967295::UBIGINT)::BIGINT"
    )


_MARKS = "".join("\\" + c for c in rules.SENTENCE_MARKS).replace("'", "''")
# Characters of each class: what is left of the words without all others.
_CLASS_PATTERNS = (
    "\\p{Lu}",
    "\\p{Ll}",
    "\\p{Lt}\\p{Lo}\\p{Lm}\\p{M}",
    "\\p{N}",
    _MARKS,
)


def _divergence(of: str, other: str) -> str:
    """One cell's share of the divergence, in bits."""
    return f"CASE WHEN {of} > 0 THEN {of} * log2({of} / (({of} + {other}) / 2)) ELSE 0 END"


def _near(largest: float, cells: str, n: str) -> str:
    return f"sqrt(pow({largest}, 2) + {rules.CHANCE} * ({cells} - 1) / (8 * {n} * ln(2)))"


QUALITY_RULES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w
  FROM documents
), words AS (
  SELECT row, unnest(w) AS word, unnest(range(len(w))) AS pos, unnest(list_transform(
    range(1, len(w) + 1), lambda i: CASE WHEN i + 7 <= len(w) THEN w[i:i + 7] END)) AS win
  FROM docs
), found AS (
  SELECT row, pos, win IS NOT NULL AND count(*) OVER (PARTITION BY row, win) > 1 AS again FROM words
), covered AS (
  SELECT row, bool_or(again) OVER (
    PARTITION BY row ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside
  FROM found
), repeats AS (
  SELECT row, count(*) FILTER (inside) AS n_repeat_words FROM covered GROUP BY row
), lines AS (
  SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs
), dups AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE trim(line, {_SPACES}) <> '' GROUP BY row
), plain AS (
  SELECT docs.*, len(w) AS n_words,
    length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN dups USING (row) LEFT JOIN repeats USING (row)
), judged AS (
  SELECT *, n_words < {rules.LEAST_WORDS}
    OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed
  FROM plain
), classes AS (
  SELECT row, lang, base_failed, word_chars, k, n FROM (
    SELECT row, lang, base_failed, word_chars,
      unnest([{", ".join(f"length(regexp_replace(text, '[^{p}]', '', 'g'))" for p in _CLASS_PATTERNS)},
        word_chars - length(regexp_replace(text, '[^{"".join(_CLASS_PATTERNS)}]', '', 'g'))]) AS n,
      unnest(range({len(rules.CLASSES)})) AS k
    FROM judged)
), class_refs AS (
  SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q
  FROM classes WHERE NOT base_failed GROUP BY lang, k
), by_class AS (
  SELECT row, sqrt(greatest(0, sum({_divergence("p", "q")}) + sum({_divergence("q", "p")})) / 2) AS d
  FROM (SELECT row, n / word_chars AS p, q FROM classes c JOIN class_refs r
        ON c.lang IS NOT DISTINCT FROM r.lang AND c.k = r.k WHERE word_chars > 0)
  GROUP BY row
), tokens AS (
  SELECT row, lang, base_failed, n_words,
    unnest(list_transform(w, lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS word
  FROM judged
), sizes AS (
  SELECT lang, sum(n_words) AS n_lang FROM judged WHERE NOT base_failed GROUP BY lang
), common AS (
  SELECT lang, word, count(*) AS n FROM tokens WHERE NOT base_failed GROUP BY lang, word
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {rules.COMMON_WORDS}
), word_refs AS (
  SELECT common.lang, word, n / n_lang AS q FROM common JOIN sizes ON common.lang IS NOT DISTINCT FROM sizes.lang
  UNION ALL
  SELECT s.lang, NULL, (any_value(n_lang) - coalesce(sum(n), 0)) / any_value(n_lang)
  FROM sizes s LEFT JOIN common c ON s.lang IS NOT DISTINCT FROM c.lang GROUP BY s.lang
), uses AS (
  SELECT row, c.word, count(*) AS n FROM tokens t LEFT JOIN common c
    ON t.lang IS NOT DISTINCT FROM c.lang AND t.word = c.word GROUP BY row, c.word
), by_word AS (
  SELECT row, count(*) AS cells,
    sqrt(greatest(0, sum({_divergence("p", "q")}) + sum({_divergence("q", "p")})) / 2) AS d
  FROM (
    SELECT j.row, coalesce(n, 0) / n_words AS p, q
    FROM judged j JOIN word_refs r ON j.lang IS NOT DISTINCT FROM r.lang
    LEFT JOIN uses u ON u.row = j.row AND u.word IS NOT DISTINCT FROM r.word
    WHERE n_words > 0)
  GROUP BY row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (coalesce(n_lang, 0) < {rules.LEAST_LANGUAGE} OR (
    (word_chars < {rules.LEAST_CHARS} OR by_class.d <= {_near(rules.CHARS_LIMIT, str(len(rules.CLASSES)), "word_chars")})
    AND (n_words < {rules.LEAST_COUNTED} OR by_word.d <= {_near(rules.WORDS_LIMIT, "cells", "n_words")})
  )) AS kept
FROM judged LEFT JOIN sizes ON judged.lang IS NOT DISTINCT FROM sizes.lang
LEFT JOIN by_class USING (row) LEFT JOIN by_word USING (row)
"""

# Pairs one edit apart are found by the texts that words leave without one letter.
SPELLING_GROUPS = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(
    coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs GROUP BY id, run HAVING length(run) >= {spelling.LEAST_CHARS}
), hashed AS (
  SELECT run, n, {_crc32("id || ':' || run")} AS h FROM counted, crc
), slips AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END
    AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= {spelling.LEAST_CHARS}
  GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}
), without AS (
  SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word AS a, b.word AS b FROM without a JOIN without b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT without.word, words.word FROM without JOIN words ON rest = words.word
  UNION SELECT words.word, without.word FROM without JOIN words ON rest = words.word
), best AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n
  FROM near JOIN words ON b = words.word GROUP BY a
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN form_n >= {spelling.RATIO} * n THEN form END AS form,
    CASE WHEN form_n >= {spelling.RATIO} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT followed.word, form FROM followed JOIN forms ON root = forms.word WHERE form IS NOT NULL
), last AS (
  SELECT followed.word, root FROM followed JOIN forms ON root = forms.word WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""

# Every period is tried at every place.
PERIODIC_RUNS = f"""
WITH crc AS ({_CRC_TABLE}), docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
), hashed AS (
  SELECT row, doc_id, w, len(w) AS n, {_crc32("doc_id::VARCHAR")} AS h FROM docs, crc
), planned AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed
), stretched AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM planned
), changed AS (
  SELECT row, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    w[1:a] || list_transform(range(n - a), lambda i: w[a + i % p + 1]) END AS w
  FROM stretched
), tried AS (
  SELECT row, n, w, unnest(range(1, n // 4 + 1)) AS q FROM changed
), equal AS (
  SELECT row, q, unnest(list_filter(range(1, n - q + 1), lambda i: w[i] = w[i + q])) - 1 AS i FROM tried
), grouped AS (
  SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS part FROM equal
), stretches AS (
  SELECT row, q, min(i) AS start, count(*) + q AS length FROM grouped GROUP BY row, q, part
), runs AS (
  SELECT row, start, length, min(q) AS period FROM stretches
  WHERE length >= 6 AND length >= 4 * q GROUP BY row, start, length
), listed AS (
  SELECT row, count(*) AS n_runs,
    arg_min((start, length, period), (-length, start, period)) AS top,
    string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row
), gone AS (
  SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
), rest AS (
  SELECT c.row, string_agg(c.word, ' ' ORDER BY c.i) AS words
  FROM (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i FROM changed) c
  ANTI JOIN gone g ON c.row = g.row AND c.i = g.i GROUP BY c.row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[1] AS start, top[2] AS length, top[3] AS period,
  1000 * top[2] // top[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(words, '')) AS collapsed_sha256
FROM changed LEFT JOIN listed USING (row) LEFT JOIN rest USING (row)
"""
