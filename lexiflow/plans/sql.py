"""DuckDB SQL of the queries, from the same dictionaries; its \\b is ASCII.  White space in it, \\s, is spelled out by the catalog."""

from __future__ import annotations

import re

from lexiflow.functions import text as T
from lexiflow.functions import values as V
from lexiflow.functions.patterns import PATTERNS
from lexiflow.operators import lexicon as L
from lexiflow.operators.tagging import ENDINGS, ENTITY, WORDS


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


STOPS, STARTERS = among(V.STOP_WORDS), among(V.STARTERS)
CLEAN = "lower(regexp_replace({0}, '[^a-zA-Z''-]', '', 'g'))"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: Lower case with final sigmas and a dot on the letter i, which ``lower`` leaves out.  Marks between letters are no letters here.
LOWER = r"lower(replace(regexp_replace({0}, '(\pL)Σ(\PL|$)', '\1ς\2', 'g'), 'İ', 'i̇'))"


def ascii_case(pattern: str) -> str:
    """A pattern that leaves the case of ASCII letters aside, and of these alone."""
    if not pattern.startswith("(?i)"):
        return pattern
    both = lambda m: f"[{m[0]}{m[0].swapcase()}]" if len(m[0]) == 1 else m[0]
    return re.sub(r"\\.|\[[^\]]*\]|[A-Za-z]", both, pattern[4:])



def _paras(documents: str) -> str:
    return rf"""paras AS (SELECT doc_id, i - 1 AS para_idx, {TRIM.format('t')} AS text
  FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents})))"""


ENGLISH, EVERY = "documents WHERE lang = 'en'", "documents"
PARAS = _paras(ENGLISH)
TOKENS = r"""toks AS (SELECT doc_id, para_idx, ctx, i - 1 AS tok_idx, raw, (para_idx << 32) + i - 1 AS place
  FROM (SELECT doc_id, para_idx, text AS ctx, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split_regex(text, '\s+') AS l FROM paras)))"""
FREQ = rf"""freq AS (SELECT word, (row_number() OVER (ORDER BY n DESC, word) - 1)::BIGINT AS rank FROM (
  SELECT {CLEAN.format('raw')} AS word, count(*) AS n FROM toks GROUP BY 1) WHERE word <> '')"""
_B = list(V.BRANCH_WEIGHTS)
VOCAB = f"""vocab AS (SELECT word AS term, [{', '.join(map(quoted, _B))}][((rank // 50) % {len(_B)} + 1)::INT] AS branch,
  [{', '.join(f'{V.BRANCH_WEIGHTS[b]}::DOUBLE' for b in _B)}][((rank // 50) % {len(_B)} + 1)::INT] AS weight FROM freq WHERE rank % 50 = 0 AND length(word) >= 5)"""
FULL = "full_texts AS (SELECT doc_id, string_agg(text, ' ' ORDER BY para_idx) AS text FROM paras GROUP BY doc_id)"
BASE = f"WITH {PARAS}, {TOKENS}, {FREQ}, {VOCAB}, {FULL}"
ALL_LANGUAGES = f"WITH {_paras(EVERY)}"
WITH_TEXTS = f"WITH {PARAS}, {FULL}"

_DECODED = "{0}"
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _DECODED = f"regexp_replace({_DECODED}, '{_entity}?', '{_char}', 'g')"  # the semicolon may be missing
#: Raw texts of the paragraphs of a page's article: from each <p> to its end tag, the next one, or the article's end.
PAGE_PARAS = rf"""raw_paras AS (SELECT page_id, i - 1 AS p, string_split(part, '</p>')[1] AS inner_html FROM (SELECT page_id, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM (
  SELECT page_id, string_split(string_split(string_split(html, '<article>')[2], '</article>')[1], '<p>') AS l FROM pages)) WHERE i > 1),
page_paras AS (SELECT page_id, p, {TRIM.format(_DECODED.format("regexp_replace(inner_html, '<[^>]*>', '', 'g')"))} AS text FROM raw_paras)"""


def page_gate(least: int) -> str:
    return rf"""WITH {PAGE_PARAS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p)::BIGINT AS para_no, 'p' AS tag, text FROM page_paras
WHERE text <> '' AND len(string_split_regex(text, '\s+')) >= {least}"""


#: Text nodes of what is left of a page without scripts, styles, navigation and footer; blocks split it, inline tags split blocks.
PAGE_NODES = rf"""bodies AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(string_split(html, '<body>')[2], '(?s)<!--.*?-->', '', 'g'), '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*?</footer>', '', 'g') AS body FROM pages),
segments AS (SELECT page_id, unnest(l) AS seg, generate_subscripts(l, 1) AS b, tags FROM (SELECT page_id, string_split_regex(body, '</?(?:p|div|article|h1|body|html)(?: [^>]*)?>') AS l,
  regexp_extract_all(body, '<(/?(?:p|div|article|h1|body|html))(?: [^>]*)?>', 1) AS tags FROM bodies)),
pieces AS (SELECT page_id, b, tags[b - 1] AS tag, {_DECODED.format('unnest(l)')} AS text, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split_regex(seg, '<[^>]*>') AS l FROM segments)),
nodes AS (SELECT *, (sum(length(text)) OVER (PARTITION BY page_id, b ORDER BY i) - length(text))::BIGINT AS "offset", (sum(length(text)) OVER (PARTITION BY page_id, b))::BIGINT AS n_chars
  FROM pieces WHERE text <> '')"""


def sentences(c: str) -> str:
    x = rf"regexp_replace({c}, '\s+', ' ', 'g')"
    x = rf"regexp_replace(trim({x}), '(^|\s)({ascii_case('(?i)' + '|'.join(V.ABBREVIATIONS))})\.', '\1\2' || chr(1), 'g')"
    x = rf"regexp_replace({x}, '([.!?])\s+([^a-z\s])', '\1' || chr(2) || '\2', 'g')"
    return f"list_filter(string_split(translate({x}, chr(1), '.'), chr(2)), lambda s: s <> '')"


def split_sentences(c: str) -> str:
    return f"list_filter({sentences(c)}, lambda s: regexp_matches(s, '[A-Za-z0-9]'))"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(pattern)}))"


def _syllables_word(w: str) -> str:
    n = count(f"lower({w})", "[aeiouy]+")
    return f"greatest(1, CASE WHEN lower({w}) LIKE '%e' AND {n} > 1 THEN {n} - 1 ELSE {n} END)"


def _chain(pairs, pattern: str) -> str:
    return "(CASE " + " ".join(f"WHEN word LIKE '{pattern.format(k)}' THEN {v}::DOUBLE" for k, v in pairs) + " ELSE 1.0::DOUBLE END)"


RARITY_BONUS = "(CASE WHEN rank IS NULL THEN 2.0::DOUBLE WHEN rank <= 1000 THEN 1.0::DOUBLE WHEN rank <= 5000 THEN 1.2::DOUBLE WHEN rank <= 20000 THEN 1.5::DOUBLE ELSE 1.8::DOUBLE END)"
_RARITY = "(CASE WHEN rank IS NULL THEN 2.0::DOUBLE WHEN rank <= 1000 THEN 1.0::DOUBLE WHEN rank <= 5000 THEN 1.2::DOUBLE WHEN rank <= 10000 THEN 1.3::DOUBLE WHEN rank <= 20000 THEN 1.4::DOUBLE ELSE 1.5::DOUBLE END)"
_SYLLABLE = f"(CASE WHEN {_syllables_word('word')} <= 1 THEN 1.0::DOUBLE WHEN {_syllables_word('word')} = 2 THEN 1.1::DOUBLE WHEN {_syllables_word('word')} = 3 THEN 1.3::DOUBLE ELSE 1.4::DOUBLE END)"
_CLUSTER = "greatest(1.0::DOUBLE, " + ", ".join(f"CASE WHEN regexp_matches(word, '{p}') THEN {v}::DOUBLE ELSE 1.0::DOUBLE END" for p, v in V.CLUSTERS) + ")"
COMPLEXITY = f"(CASE WHEN length(word) < 2 THEN 0.0::DOUBLE ELSE {_RARITY} * {_SYLLABLE} * {_chain(V.SUFFIXES, '%{0}')} * {_chain(V.PREFIXES, '{0}%')} * {_CLUSTER} END)"
TIER = f"(CASE WHEN {COMPLEXITY} >= 1.6::DOUBLE THEN CASE WHEN {COMPLEXITY} >= 1.5::DOUBLE THEN 'full' ELSE 'lite' END END)"

SCORED = rf"""measured AS (SELECT doc_id, para_idx, text, len({sentences('text')})::BIGINT AS sentence_count, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM paras),
sums AS (SELECT *, len(w)::DOUBLE AS n, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(regexp_replace(lower(x), '[.,!?()]', '', 'g'), '[aeiouy]+')))))::DOUBLE AS syl,
  list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[.,!?()]', '', 'g'))))::DOUBLE AS letters FROM measured WHERE len(w) > 0),
rates AS (SELECT *, letters / n AS avg_word_len, n / sentence_count::DOUBLE AS avg_sent_len, syl / n AS syllable_density FROM sums),
fleschs AS (SELECT *, floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * avg_sent_len - 84.6::DOUBLE * syllable_density)) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS flesch FROM rates),
scores AS (SELECT *, floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, flesch - 4.0::DOUBLE * greatest(0.0::DOUBLE, avg_word_len - 6.0::DOUBLE) - 1.5::DOUBLE * greatest(0.0::DOUBLE, avg_sent_len - 20.0::DOUBLE)
  - 8.0::DOUBLE * greatest(0.0::DOUBLE, syllable_density - 2.0::DOUBLE))) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS score FROM fleschs),
scored AS (SELECT *, CASE WHEN score < 40 THEN 'llm' WHEN score < 60 THEN 'split' ELSE 'none' END AS action FROM scores)"""

ACRONYMS = rf"""acr AS (SELECT doc_id, acronym, count(*)::BIGINT AS n, min(place)::BIGINT AS first FROM (
  SELECT doc_id, place, CASE WHEN regexp_matches(d, '^([A-Z]\.)+[A-Z]?$') THEN regexp_replace(lower(d), '\.$', '') || '.' WHEN regexp_matches(p, '^[A-Z]{{2,6}}$') THEN lower(p) END AS acronym
  FROM (SELECT doc_id, place, regexp_replace(raw, '^[^A-Z.]+|[^A-Z.]+$', '', 'g') AS d, regexp_replace(raw, '^[^A-Z]+|[^A-Z]+$', '', 'g') AS p FROM toks))
  WHERE acronym IS NOT NULL AND acronym NOT IN {STOPS} GROUP BY doc_id, acronym)"""


def science(names=None) -> str:
    parts = [f"SELECT doc_id, '{name}' AS kind, {LOWER.format('t')} AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(ascii_case(p))})) AS t FROM full_texts) WHERE length(t) >= {least}" for name, p, least in PATTERNS if names is None or name in names]
    return f"sci AS (SELECT doc_id, kind, term, count(*)::BIGINT AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"


#: Italics of pages that are species or names.
ITALICS = r"""italics AS (SELECT DISTINCT page_id, lower(t) AS term FROM (SELECT page_id, """ + TRIM.format("unnest(regexp_extract_all(html, '<(?:em|i)>([^<]*)</(?:em|i)>', 1))") + r""" AS t FROM pages)
  WHERE length(t) >= 3 AND (regexp_matches(t, '[A-Z][a-z]+\s+[a-z]{3,}') OR regexp_matches(t, '[A-Z]\.\s*[a-z]{3,}') OR regexp_matches(t, '^[A-Z][a-z]{4,}$')))"""


VOCAB_HITS = f"hits AS (SELECT DISTINCT t.doc_id, t.term FROM (SELECT doc_id, {CLEAN.format('raw')} AS term FROM toks) t JOIN vocab v USING (term) WHERE length(t.term) >= 2)"
ESCAPED = r"regexp_replace({0}, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g')"
FALSE_CAPITAL = rf"""(regexp_matches(raw, '^[A-Z]') AND NOT regexp_matches(raw, '^[A-Z]+$') AND len(regexp_extract_all(ctx, '(?:^|[.!?][\s\n]+)' || {ESCAPED.format('raw')})) > 0
  AND len(regexp_extract_all(ctx, '\b' || {ESCAPED.format('raw')} || '\b')) = len(regexp_extract_all(ctx, '(?:^|[.!?][\s\n]+)' || {ESCAPED.format('raw')})))"""
TERMS = rf"""terms AS (SELECT doc_id, term, count(*)::BIGINT AS n, min(place) AS first FROM (SELECT doc_id, place,
  CASE WHEN regexp_matches(trim(d), '{T.DOTTED}') THEN CASE WHEN regexp_replace(lower(d), '\.$', '') || '.' NOT IN {STOPS} THEN regexp_replace(lower(d), '\.$', '') || '.' END
    WHEN length(word) >= 3 AND word NOT IN {STOPS} AND word NOT IN {STARTERS} AND NOT {FALSE_CAPITAL} THEN word END AS term
  FROM (SELECT *, regexp_replace(raw, '^[^A-Za-z.]+|[^A-Za-z.]+$', '', 'g') AS d, {CLEAN.format('raw')} AS word FROM toks)) WHERE term IS NOT NULL GROUP BY doc_id, term)"""
_PARTS = r"string_split_regex(trim(term), '\s+')"
_PART = "regexp_replace(lower(t), '[^a-z''-]', '', 'g')"
CONTENT = f"len(list_filter({_PARTS}, lambda t: regexp_matches(trim(t), '{T.DOTTED}') OR (length({_PART}) >= 2 AND {_PART} NOT IN {STOPS}))) > 0"
NOT_ALL_STOP = f"len(list_filter({_PARTS}, lambda t: regexp_matches(trim(t), '{T.DOTTED}') OR {_PART} NOT IN {STOPS})) > 0"
ENTITIES = f"ents AS (SELECT DISTINCT doc_id, lower(term) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(ENTITY)}, 1)) AS term FROM paras))"
_KEPT = f"term NOT IN {STOPS} AND {CONTENT} AND {NOT_ALL_STOP}"
_FLAGS = f"""{ENTITIES}, sources AS (SELECT DISTINCT doc_id, acronym AS term, 'in_acronym' AS source, 2 AS r FROM acr UNION ALL SELECT DISTINCT doc_id, term, 'in_science', 3 FROM sci
  UNION ALL SELECT doc_id, term, 'in_science', 3 FROM more_science UNION ALL SELECT doc_id, term, 'in_vocabulary', 4 FROM hits UNION ALL SELECT doc_id, term, 'in_entity', 1 FROM ents WHERE length(term) >= 2 AND {_KEPT}),
flags AS (SELECT doc_id, term, bool_or(source = 'in_science') AS in_science, bool_or(source = 'in_acronym') AS in_acronym, bool_or(source = 'in_vocabulary') AS in_vocabulary,
  bool_or(source = 'in_entity') AS in_entity, min(r)::BIGINT AS source_rank FROM sources GROUP BY doc_id, term)"""
_NO_MORE = "more_science AS (SELECT NULL::BIGINT AS doc_id, NULL AS term WHERE false)"
FLAGS = f"{_NO_MORE}, {_FLAGS}"  # of rows with an id


def _keywords(more: str) -> str:
    return rf"""{ACRONYMS}, {science()}, {VOCAB_HITS}, {more}, {_FLAGS}, {TERMS},
merged AS (SELECT coalesce(t.doc_id, f.doc_id) AS doc_id, coalesce(t.term, f.term) AS term, t.n, t.first, coalesce(in_science, false) AS sci, coalesce(in_acronym, false) AS acr, coalesce(in_entity, false) AS ent, source_rank FROM terms t FULL JOIN flags f ON t.doc_id = f.doc_id AND t.term = f.term),
counted AS (SELECT m.* REPLACE (coalesce(m.n, greatest(1, len(regexp_extract_all({LOWER.format('x.text')}, '\b' || {ESCAPED.format('m.term')} || '\b'))))::BIGINT AS n) FROM merged m JOIN full_texts x USING (doc_id)),
looked AS (SELECT c.*, c.term AS word, f.rank, coalesce(v.weight, 1.0::DOUBLE) AS weight FROM counted c LEFT JOIN freq f ON c.term = f.word LEFT JOIN vocab v ON c.term = v.term
  WHERE {_KEPT.replace('term ', 'c.term ', 1).replace('trim(term)', 'trim(c.term)')}),
keyed AS (SELECT *, round(log2(n::DOUBLE + 1) * weight * (CASE WHEN weight > 1 OR sci OR ent OR acr THEN {RARITY_BONUS} ELSE greatest({COMPLEXITY}, 1.0::DOUBLE) END) * (CASE WHEN sci THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN ent THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN acr THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM looked),
keywords AS (SELECT doc_id, term, n, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, coalesce(source_rank, 0), coalesce(first, 1::BIGINT << 62), term)::BIGINT AS rank FROM keyed)"""


TOP_TERMS = f"""met AS (SELECT p.doc_id, p.para_idx, k.term, k.score, k.rank AS ord FROM paras p JOIN keywords k ON p.doc_id = k.doc_id
  WHERE p.text <> '' AND regexp_matches({LOWER.format('p.text')}, '\\b' || {ESCAPED.format('k.term')} || '\\b')),
top AS (SELECT * EXCLUDE (ord, n) FROM (SELECT doc_id, para_idx, term, score, row_number() OVER w AS rank, ord, count(*) OVER (PARTITION BY doc_id, para_idx) AS n FROM met
  WINDOW w AS (PARTITION BY doc_id, para_idx ORDER BY score DESC, ord)) WHERE rank <= greatest(1, ceil(n * 0.5::DOUBLE)))"""
_ASCII_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BARS, _TITLES = among(sorted(V.BREAKERS | V.DETERMINERS)), among(sorted(V.TITLES))
_RIGHT = r"-[a-zA-Z][a-zA-Z''-]*|[''’]s\s+[A-Z][a-zA-Z''-]*|\s+[A-Z][a-zA-Z''-]*"
#: The same of the text before, reversed.
_LEFT = r"-[a-zA-Z]+|\s+[a-zA-Z''-]+[A-Z]"
#: Whether text that goes on, reversed, with ``{0}`` ends a sentence.
_ENDS = rf"(CASE WHEN regexp_matches({{0}}, '^\s*[\n\r]') OR regexp_matches({{0}}, '^\s*$') THEN true WHEN regexp_matches({{0}}, '^\s*[!?]') THEN true WHEN NOT regexp_matches({{0}}, '^\s*\.') THEN false ELSE lower(reverse(regexp_extract({{0}}, '^\s*\.([a-zA-Z]*)', 1))) NOT IN {_TITLES} END)"
#: The steps of a list before the first that fails, ``{1}`` by number; ``{2}`` of each.
_UNTIL = "coalesce(list_position(list_transform(range(1, len({0}) + 1), lambda k: {1}), true) - 1, len({0}))"
_WORD_PART = r"regexp_extract_all({0}, '[a-zA-Z''-]+\s*|[^a-zA-Z''-]+')"
_STOPPED = "list_sum(list_transform(({0})[1:coalesce(list_position(list_transform({0}, lambda x: {1} IN " + STOPS + r"), false) - 1, len({0}))], lambda x: length(x)))"
_CITED = r"(regexp_matches(substr(raw, 1, {0}), '\([^()]*$') AND regexp_matches(substr(raw, {1} + 1), '^[^()]*\)') AND (regexp_matches({2}, '(?:^|[^0-9])(?:19|20)[0-9][0-9][^0-9]*$') OR regexp_matches({2}, '\b[eE][tT]\s+[aA][lL]\b')))"
_INNER = r"regexp_extract(substr(raw, 1, {0}), '\(([^()]*)$', 1) || substr(raw, {0} + 1, {1} - {0}) || regexp_extract(substr(raw, {1} + 1), '^([^()]*)\)', 1)"


def _span_sql() -> str:
    """CTEs from blocks (doc_id, para_idx, text, raw, offset, terms; other columns stay) to spans."""
    steps = lambda c: rf"regexp_extract_all(regexp_extract({c}, '^(?:{_RIGHT if c == 'rest' else _LEFT})*'), '{_RIGHT if c == 'rest' else _LEFT}')"
    total = lambda c, n: f"coalesce(list_sum(list_transform({c}[1:{n}], lambda x: length(x))), 0)::BIGINT"
    right = rf"regexp_matches(r[k], '^\s') AND (lower(regexp_extract(r[k], '[a-zA-Z''-]+')) IN {_BARS} OR regexp_matches(r[k], '^\s*[\n\r]') OR (k = 1 AND {_ENDS.format('reverse(substr(text, 1, e))')}))"
    left = rf"regexp_matches(l[k], '^\s') AND (lower(reverse(regexp_extract(l[k], '[a-zA-Z''-]+'))) IN {_BARS} OR {_ENDS.format('substr(rev, ' + total('l', 'k') + ' + 1)')})"
    lead = f"coalesce({_STOPPED.format(_WORD_PART.format('{0}'), 'regexp_replace(x, ' + chr(39) + chr(92) + 's+$' + chr(39) + ', ' + chr(39) + chr(39) + ')')}, 0)::BIGINT"
    tail = f"coalesce({_STOPPED.format(_WORD_PART.format('reverse({0})'), 'reverse(regexp_replace(x, ' + chr(39) + chr(92) + 's+$' + chr(39) + ', ' + chr(39) + chr(39) + '))')}, 0)::BIGINT"
    return rf"""numbered_blocks AS (SELECT *, row_number() OVER () AS bid, {_ASCII_LOW.format('text')} AS low FROM blocks),
cut AS (SELECT bid, low, length(t) AS size, t LIKE '% %' AS several, string_split(low, t) AS l, t FROM (SELECT bid, low, {_ASCII_LOW.format('unnest(terms)')} AS t FROM numbered_blocks)),
placed_terms AS (SELECT bid, low, size, several, t, (sum(length(piece) + size) OVER (PARTITION BY bid, t ORDER BY i) - size)::BIGINT AS s FROM (
  SELECT bid, low, size, several, t, unnest(l[1:len(l) - 1]) AS piece, generate_subscripts(l[1:len(l) - 1], 1) AS i FROM cut)),
ended AS (SELECT bid, s, size, CASE WHEN several THEN s + size
    WHEN regexp_matches(substr(low, s, 1), '[a-z0-9_]') = regexp_matches(t, '^[a-z0-9_]') AND s > 0 OR s = 0 AND NOT regexp_matches(t, '^[a-z0-9_]') THEN NULL
    WHEN regexp_matches(substr(low, s + size + 1, 3), '^[''’]s(?:[\s\-.,;:!?()\[\]]|$)') THEN s + size + 2
    WHEN regexp_matches(substr(low, s + size + 1, 1), '^(?:[\s\-.,;:!?()\[\]]|$)') THEN s + size END AS e FROM placed_terms),
seeds AS (SELECT bid, s, arg_max(e, size) AS e FROM ended WHERE e IS NOT NULL GROUP BY bid, s),
around AS (SELECT bid, s, e, text, substr(text, e + 1) AS rest, reverse(substr(text, 1, s)) AS rev FROM seeds JOIN numbered_blocks USING (bid)),
stepped AS (SELECT *, {steps('rest')} AS r, {steps('rev')} AS l FROM around),
grown AS (SELECT bid, s, s - {total('l', _UNTIL.format('l', left))} AS a, e + {total('r', _UNTIL.format('r', right))} AS b FROM stepped),
listed AS (SELECT bid, list({{'s': s, 'a': a::BIGINT, 'b': b::BIGINT, 'last': 0::BIGINT, 'past': 0::BIGINT, 'found': []::STRUCT("start" BIGINT, "end" BIGINT)[]}} ORDER BY s) AS seeds FROM grown GROUP BY bid),
walked AS (SELECT bid, list_reduce(seeds, lambda acc, x: CASE WHEN x.s < acc.past THEN acc ELSE list_transform([greatest(acc.last, x.a)], lambda first:
  list_transform([first + {lead.format('substr(text, first + 1, x.b - first)')}], lambda s0: list_transform([greatest(s0, x.b - {tail.format('substr(text, s0 + 1, x.b - s0)')})], lambda e0:
  list_transform([s0 < e0 AND NOT {_CITED.format('(s0 + "offset")', '(e0 + "offset")', _INNER.format('(s0 + "offset")', '(e0 + "offset")'))}], lambda ok:
    {{'s': x.s, 'a': x.a, 'b': x.b, 'last': CASE WHEN ok THEN e0 ELSE acc.last END, 'past': CASE WHEN e0 <= acc.past THEN greatest(e0, acc.past + 1) ELSE e0 END,
      'found': CASE WHEN ok THEN list_append(acc.found, {{'start': s0, 'end': e0}}) ELSE acc.found END}})[1])[1])[1])[1] END,
  {{'s': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT, 'last': 0::BIGINT, 'past': 0::BIGINT, 'found': []::STRUCT("start" BIGINT, "end" BIGINT)[]}}).found AS found
  FROM listed JOIN numbered_blocks USING (bid)),
spans AS (SELECT b.* EXCLUDE (bid, low, terms), f."start", f."end", substr(text, f."start" + 1, f."end" - f."start") AS phrase FROM (SELECT bid, unnest(found) AS f FROM walked) JOIN numbered_blocks b USING (bid))"""


SPANS = _span_sql()
KEYWORDS = _keywords(_NO_MORE)
_MORE = f"{ITALICS}, more_science AS (SELECT page_id AS doc_id, term FROM italics)"
#: Keywords of body paragraphs of pages, with ranks and vocabulary of the documents.
PAGE_KEYWORDS = rf"""WITH {PARAS}, {TOKENS}, {FREQ}, {VOCAB} SELECT * FROM (WITH {PAGE_PARAS},
paras AS (SELECT page_id AS doc_id, p AS para_idx, text FROM page_paras
  WHERE text <> '' AND len(string_split_regex(text, '\s+')) >= 30), {TOKENS}, {FULL}, {_keywords(_MORE)} SELECT doc_id AS page_id, term, n, score, rank FROM keywords)"""
#: Spans in text nodes of paragraphs of pages; terms as in their keywords.
PAGE_BOLD_SPANS = rf"""WITH {PARAS}, {TOKENS}, {FREQ}, {VOCAB} SELECT * FROM (WITH {PAGE_PARAS}, {PAGE_NODES},
whole AS (SELECT page_id, b, string_agg(text, '' ORDER BY i) AS raw, dense_rank() OVER (PARTITION BY page_id ORDER BY b) AS para_no FROM nodes WHERE tag = 'p' GROUP BY page_id, b),
paras AS (SELECT page_id AS doc_id, p AS para_idx, text FROM page_paras WHERE text <> '' AND len(string_split_regex(text, '\s+')) >= 30), {TOKENS}, {FULL}, {_keywords(_MORE)},
bold AS (SELECT page_id AS doc_id, b AS para_idx, {TRIM.format('raw')} AS text FROM whole), {TOP_TERMS.replace('paras p', 'bold p')},
blocks AS (SELECT n.page_id, w.para_no, row_number() OVER (PARTITION BY n.page_id, n.b ORDER BY n.i) AS node_no, n.text, w.raw, n."offset", t.terms
  FROM nodes n JOIN whole w USING (page_id, b) JOIN (SELECT doc_id, para_idx, list(term) AS terms FROM top GROUP BY ALL) t ON t.doc_id = n.page_id AND t.para_idx = n.b WHERE regexp_matches(n.text, '[A-Za-z]')),
{SPANS} SELECT page_id, para_no, node_no, "start", "end", phrase FROM spans)"""
#: Parts of speech by closed word lists and endings.
_PART = {"Verb": "verbs", "Adjective": "adjectives", "Noun": "nouns"}
_POS = " ".join(f"WHEN regexp_matches(low, '(?:{'|'.join(ends.split())})$') THEN '{_PART[tag]}'" for tag, ends in ENDINGS)
POS = f"""SELECT doc_id, para_idx, sent_idx, i - 1 AS term_idx, word AS text, pos FROM (SELECT *, CASE {_POS} ELSE 'nouns' END AS pos FROM (SELECT *, lower(word) AS low FROM (
  SELECT doc_id, para_idx, sent_idx, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(sentence, '[A-Za-z][A-Za-z''-]*') AS l FROM sents)))
  WHERE low NOT IN {among(WORDS)} AND length(regexp_replace(word, '[^a-zA-Z]', '', 'g')) >= 4)"""


def _by_ending(c: str, place: int, other: str) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches({c}, '(?:{'|'.join(e[2])})$') THEN '{e[place]}'" for e in L.ENDINGS) + f" ELSE '{other}' END)"


#: A lexicon from the words beside those of the vocabulary.
LEXICON = rf"""words AS (SELECT doc_id, para_idx, tok_idx, {CLEAN.format('raw')} AS w FROM toks),
pairs AS (SELECT first, second, count(*)::INT AS n FROM (SELECT w AS first, lead(w) OVER (PARTITION BY doc_id, para_idx ORDER BY tok_idx) AS second FROM words) WHERE first <> '' AND second <> '' GROUP BY ALL),
followers AS (SELECT first AS word, list({{'word': second, 'score': n, 'tags': [{_by_ending('second', 0, 'n')}]}} ORDER BY r) AS a FROM (
  SELECT *, row_number() OVER (PARTITION BY first ORDER BY n DESC, second) AS r FROM pairs WHERE first IN (SELECT term FROM vocab)) WHERE r <= {L.MOST_FOLLOWERS} GROUP BY first),
before AS (SELECT second AS word, list(first ORDER BY r) AS s FROM (
  SELECT *, row_number() OVER (PARTITION BY second ORDER BY n DESC, first) AS r FROM pairs WHERE second IN (SELECT term FROM vocab)) WHERE r <= {L.MOST_BEFORE} GROUP BY second),
held AS (SELECT w AS word, doc_id, para_idx, row_number() OVER (PARTITION BY w ORDER BY doc_id, para_idx) AS r FROM (SELECT DISTINCT w, doc_id, para_idx FROM words WHERE w IN (SELECT term FROM vocab))),
told_by AS (SELECT h.word, list({{'definition': p.text, 'synonyms': []::VARCHAR[]}} ORDER BY r) AS d FROM held h JOIN paras p ON h.doc_id = p.doc_id AND p.para_idx = h.para_idx + 1 WHERE r <= {L.MOST_PLACES} GROUP BY h.word),
lex AS (SELECT v.term AS word, to_json(f.a) AS a, CASE WHEN s.word IS NOT NULL THEN to_json([{{'meanings': [{{'partOfSpeech': {_by_ending('v.term', 1, 'Noun')}, 'synonyms': coalesce(s.s, []), 'definitions': coalesce(s.d, [])}}]}}]) END AS b
  FROM vocab v LEFT JOIN followers f ON f.word = v.term LEFT JOIN (SELECT coalesce(b.word, t.word) AS word, s, d FROM before b FULL JOIN told_by t ON b.word = t.word) s ON s.word = v.term)"""


def _cards() -> str:
    """CTEs from lex (word, a, b: JSON) and freq to cards (word, pos, synonyms, definition, entry)."""
    a = '[{"word":"VARCHAR","score":"INTEGER","tags":["VARCHAR"]}]'
    b = '[{"meanings":[{"partOfSpeech":"VARCHAR","synonyms":["VARCHAR"],"definitions":[{"definition":"VARCHAR","synonyms":["VARCHAR"]}]}]}]'
    tags = " ".join(f"WHEN list_contains(x.tags, '{k}') THEN '{v}'" for k, v in (("n", "noun"), ("v", "verb"), ("adj", "adjective"), ("adv", "adverb")))
    prefix = "length(word) >= 3 AND length(synonym) >= 3 AND substr(synonym, 1, 3) = substr(word, 1, 3)"
    unfit = rf"length(synonym) NOT BETWEEN 2 AND 20 OR synonym = word OR ({prefix}) OR contains(synonym, word) OR contains(word, synonym) OR len(string_split_regex(synonym, '\s+')) > 2"
    short = r"CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 200), '\s+\S*$', '') || '…' END"
    return rf"""ranks AS (SELECT word AS synonym, rank FROM freq),
first_source AS (SELECT word, CASE {tags} ELSE 'other' END AS pos, trim(lower(x.word)) AS synonym, i - 1 AS ord FROM (SELECT word, unnest(l) AS x, generate_subscripts(l, 1) AS i
  FROM (SELECT word, from_json(a, '{a}') AS l FROM lex WHERE a IS NOT NULL)) WHERE i <= 30),
entries AS (SELECT word, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS e FROM (SELECT word, from_json(b, '{b}') AS l FROM lex WHERE b IS NOT NULL)),
meanings AS (SELECT word, e, unnest(x.meanings) AS m, generate_subscripts(x.meanings, 1) - 1 AS k FROM entries),
senses AS (SELECT word, e, k, lower(coalesce(m.partOfSpeech, 'other')) AS pos, m.synonyms AS own, unnest(m.definitions) AS d, generate_subscripts(m.definitions, 1) - 1 AS j FROM meanings),
second_source AS (SELECT word, pos, trim(lower(unnest(l))) AS synonym, (((1 + e) * 1000 + k) * 1000 + j) * 1000 + generate_subscripts(l, 1) - 1 AS ord
  FROM (SELECT *, list_concat(coalesce(d.synonyms, []), coalesce(own, [])) AS l FROM senses)),
syns AS (SELECT word AS head, pos, synonym AS word, min(ord)::BIGINT AS ord FROM (SELECT * FROM first_source UNION ALL SELECT * FROM second_source)
  WHERE synonym <> '' AND NOT ({unfit}) GROUP BY ALL),
scored_syns AS (SELECT s.*, {COMPLEXITY} AS score FROM (SELECT s.*, r.rank FROM syns s LEFT JOIN ranks r ON r.synonym = s.word) s),
lists AS (SELECT head, pos, list(word ORDER BY score, ord, word) AS r, min(ord) AS first FROM scored_syns GROUP BY ALL),
lengths AS (SELECT *, list_transform(r, lambda x: length(x)) AS n FROM lists),
three AS (SELECT head, pos, first, CASE WHEN len(r) <= 3 THEN r ELSE list_filter([r[list_position(n, list_min(n))], r[1], r[list_position(n, list_max(n))]],
  lambda x, i: list_position([r[list_position(n, list_min(n))], r[1], r[list_position(n, list_max(n))]], x) = i) END AS synonyms FROM lengths),
told AS (SELECT word AS head, pos, arg_min({short}, e * 1000000 + k * 1000 + j) AS definition FROM (SELECT *, d.definition AS text FROM senses)
  WHERE coalesce(text, '') <> '' AND NOT regexp_matches(lower(text), '\b' || {ESCAPED.format('word')} || '\b') GROUP BY ALL),
cards AS (SELECT coalesce(t.head, d.head) AS word, coalesce(t.pos, d.pos) AS pos, coalesce(synonyms, []) AS synonyms, definition,
  row_number() OVER (PARTITION BY coalesce(t.head, d.head) ORDER BY (coalesce(t.pos, d.pos) IN ('noun', 'proper noun'))::INT, coalesce(first, 1::BIGINT << 62), coalesce(t.pos, d.pos))::BIGINT AS entry
  FROM three t FULL JOIN told d ON t.head = d.head AND t.pos = d.pos)"""


CARDS = _cards()
DICTIONARY = rf"""WITH rec AS (SELECT doc_id AS rec_ord, [substr('{L.BRANCHES}', (doc_id % {len(L.BRANCHES)} + 1)::INT, 1) || '04.' || (doc_id % 7), substr('{L.BRANCHES}', ((doc_id // {len(L.BRANCHES)}) % {len(L.BRANCHES)} + 1)::INT, 1) || '12'] AS trees,
  string_split_regex({TRIM.format("coalesce(text, '')")}, '\s+')[1:3] AS names FROM documents WHERE doc_id IS NOT NULL),
w(branch, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in V.BRANCH_WEIGHTS.items())}),
tree AS (SELECT rec_ord, unnest(trees) AS t, generate_subscripts(trees, 1) AS i FROM rec),
best AS (SELECT rec_ord, w.branch, weight FROM tree JOIN w ON w.branch = substr(t, 1, 1) QUALIFY row_number() OVER (PARTITION BY rec_ord ORDER BY weight DESC, i) = 1),
named AS (SELECT rec_ord, {LOWER.format('unnest(names)')} AS term, generate_subscripts(names, 1) AS i FROM rec)
SELECT term, branch, weight FROM named JOIN best USING (rec_ord) WHERE length(term) >= 2 AND NOT regexp_matches(term, '^\d+$') QUALIFY row_number() OVER (PARTITION BY term ORDER BY rec_ord, i) = 1"""
#: What a card shows, by tier.
SHOWN = r"""every AS (SELECT word, flatten(list(synonyms ORDER BY entry)) AS s, list(definition ORDER BY entry) FILTER (WHERE definition IS NOT NULL) AS d FROM cards GROUP BY word),
fit AS (SELECT word, list_filter(s, lambda x, i: list_position(s, x) = i) AS s, list_filter(coalesce(d, []), lambda t: len(s) <= 3 OR
  len(list_filter(string_split_regex(lower(t), '\W+'), lambda w: length(w) > length(substr(word, 1, 5)) AND contains(w, substr(word, 1, 5)))) = 0) AS d FROM every)
SELECT word, 'lite' AS tier, s[1:2] AS synonyms, d[1:1] AS definitions FROM fit UNION ALL SELECT word, 'full', s[1:4], d FROM fit"""
