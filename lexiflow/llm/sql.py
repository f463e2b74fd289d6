"""DuckDB SQL of the queries that SQL can express beside those in ``queries``; constants come from the operators."""

from __future__ import annotations

from lexiflow.llm import quality, secrets, urlfilter

_W = r"[^\x20\x09-\x0D]+"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _among(words) -> str:
    return "(" + ", ".join(map(_text, words)) + ")"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _places(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Rows (r, k, kind, first, past, value) of a pattern's matches whose group is long enough."""
    values = f"regexp_extract_all(text, {_text(pattern)}, {group})"
    return f"""SELECT r, {rank} AS k, '{kind}' AS kind, past - length(hit) AS first, past, value FROM (
  SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS past FROM (
    SELECT r, unnest(h) AS hit, unnest(v) AS value, unnest(p[1:len(h)]) AS piece, generate_subscripts(h, 1) AS i FROM (
      SELECT r, regexp_extract_all(text, {_text(pattern)}) AS h, {values} AS v, string_split_regex(text, {_text(pattern)}) AS p FROM t) WHERE len(h) > 0)) WHERE length(value) >= {least}"""


def op1() -> str:
    words = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
    assign = rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    forms = {"assign": assign, "access": secrets.BASE[1][1], "hex": "[0-9a-f]+"}
    base = " UNION ALL ".join(_places(kind, i, forms[kind], group, least) for i, (kind, _, group, least) in enumerate(secrets.BASE))
    allowed = " OR ".join(f"regexp_matches(value, {_text(p)})" for p in secrets.ALLOW)
    limits, window = secrets.THRESHOLDS, secrets.WINDOW
    return rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
runs AS ({_places('entropy', len(secrets.BASE), secrets.CANDIDATE, 0, window)}),
loose AS (SELECT row_number() OVER () AS u, * FROM (SELECT * FROM runs WHERE NOT ({allowed})) c
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.first < c.past AND c.first < b.past)),
chars AS (SELECT u, unnest(string_split(value, '')) AS ch, unnest(range(1, length(value) + 1)) AS i FROM loose),
counts AS (SELECT u, s, ch, count(*)::DOUBLE AS n FROM (
  SELECT c.u, c.ch, c.i, unnest(range(greatest(1, c.i - {window - 1}), least(c.i, length(l.value) - {window - 1}) + 1)) AS s FROM chars c JOIN loose l USING (u)) GROUP BY u, s, ch),
best AS (SELECT u, max(e) AS e FROM (SELECT u, s, log2({window}) - sum(n * log2(n)) / {window} AS e FROM counts GROUP BY u, s) GROUP BY u),
more AS (SELECT l.r, l.k, l.kind, l.first, l.past FROM loose l JOIN best USING (u) WHERE e >= CASE WHEN regexp_matches(value, '^[0-9a-fA-F]+$') THEN {limits['hex']}::DOUBLE
  WHEN regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') THEN {limits['base64']}::DOUBLE ELSE {limits['alnum']}::DOUBLE END),
every AS (SELECT r, k, kind, first, past, kind || ':' || first::BIGINT || ':' || past::BIGINT AS t FROM (SELECT r, k, kind, first, past FROM base UNION ALL SELECT * FROM more)),
joined AS (SELECT r, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
  string_agg(t, ',' ORDER BY first, k) FILTER (WHERE k < 3) AS own, string_agg(t, ',' ORDER BY first, k) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined USING (r)"""


def op2(words: int = 3, percent: int = 85) -> str:
    """By rows, as a doc_id may stand in several: its rows with shingles are linked."""
    ahead = ", ".join(f"lead(a, {k}) OVER o AS a{k}" for k in range(1, words))
    gram = " || ' ' || ".join(["a"] + [f"a{k}" for k in range(1, words)])
    return rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '{_W}') AS w FROM documents),
tok AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= {words}),
grams AS (SELECT DISTINCT r, {gram} AS g FROM (SELECT r, i, a, {ahead} FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE a{words - 1} IS NOT NULL
  UNION ALL SELECT r, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {words - 1}),
sizes AS (SELECT r, doc_id, count(*)::BIGINT AS n FROM grams JOIN w USING (r) GROUP BY r, doc_id),
known AS (SELECT grams.* FROM grams JOIN w USING (r) WHERE doc_id IS NOT NULL),
inter AS (SELECT x.r AS u, y.r AS v, count(*) AS n FROM known x JOIN known y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
links AS (SELECT u, v FROM inter JOIN sizes a ON a.r = u JOIN sizes b ON b.r = v WHERE 100 * inter.n >= {percent} * (a.n + b.n - inter.n)
  UNION SELECT a.r, b.r FROM sizes a JOIN sizes b ON a.doc_id = b.doc_id AND a.r < b.r),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(d, c) AS (SELECT r, doc_id FROM sizes UNION SELECT e.v, reach.c FROM reach JOIN both_ways e ON e.u = reach.d),
least_of AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, CASE WHEN w.doc_id IS NOT NULL THEN coalesce(l.c, w.doc_id) END AS component_id, coalesce(l.c = w.doc_id, true) AS kept
FROM w LEFT JOIN sizes s USING (r) LEFT JOIN least_of l ON l.d = w.r"""


def op3() -> str:
    rules = sorted(urlfilter.RULES, key=lambda x: -len(x[0]))

    def chain(out) -> str:
        parts = []
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            parts.append(f"WHEN (host = {_text(host)} OR ends_with(host, {_text('.' + host)})) AND starts_with(path, {_text(slash + path)}) THEN {_text(out(rule, verdict))}")
        return "CASE " + " ".join(parts) + " END"

    weigh = "CASE x " + " ".join(f"WHEN {_text(t)} THEN {w}::DOUBLE" for t, w in urlfilter.SOFT) + " END"
    soft = _among(t for t, _ in urlfilter.SOFT)
    return rf"""WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_AZ}', '{_az}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, lower(coalesce(url, '')) AS whole FROM pages),
ruled AS (SELECT *, {chain(lambda rule, _: rule)} AS rule, {chain(lambda _, verdict: verdict)} AS said, string_split_regex(whole, '[^\p{{L}}\p{{N}}]+') AS words FROM parts),
found AS (SELECT *, CASE WHEN rule IS NULL THEN list_filter(words, lambda x: x IN {_among(urlfilter.STRICT)}) ELSE [] END AS hard,
  CASE WHEN rule IS NULL THEN list_distinct(list_filter(words, lambda x: x IN {soft})) ELSE [] END AS soft FROM ruled),
hit AS (SELECT *, len(hard)::INT AS strict_hits, len(soft)::INT AS soft_hits, coalesce(list_sum(list_transform(soft, lambda x: {weigh})), 0)::DOUBLE AS soft_weight FROM found)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits > 0 OR (soft_hits >= 2 AND soft_weight >= {urlfilter.SOFT_LIMIT}::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits, soft_weight FROM hit"""


def op6() -> str:
    q = quality
    share = lambda pattern: f"(length(line) - length(regexp_replace(line, {_text(pattern)}, '', 'g')))::DOUBLE / length(line)::DOUBLE"
    has = lambda pattern: f"regexp_matches(line, {_text(pattern)})"
    upper, letter, edge = r"\p{Lu}", r"\p{L}", r"[^\p{L}\p{N}]"
    # No look-around in this engine: the characters around a phrase are matched, and put back where it is taken out.
    phrase = lambda among: f"(^|{edge})(?:{'|'.join(among)})($|{edge})"
    said = lambda among: f"regexp_matches(lower(line), {_text(phrase(among))})"
    rest = "lower(line)"
    for _ in range(2):  # neighbours share a character
        rest = rf"regexp_replace({rest}, {_text(phrase(q.COMMON))}, '\1\2', 'g')"
    mostly = f"2 * length(trim({rest})) <= length(trim(lower(line)))"
    others = rf"regexp_matches(regexp_replace(line, '[\x00-\xFF\x{{2000}}-\x{{206F}}{q._NO_MARKS}]', '', 'g'), '\p{{Po}}')"
    navigation = r"len(regexp_extract_all(line, '[\x20\x09-\x0D][|»›•·][\x20\x09-\x0D]')) >= 3"
    fails = f"""({share(q._SYMBOLS + '+')} > {q.MAX_SYMBOLS}::DOUBLE OR {share('!+')} > {q.MAX_SHOUTS}::DOUBLE OR {navigation}
  OR (length(line) >= 12 AND {has(upper + '{2}')} AND {share(upper + '+')} > 0.6::DOUBLE)
  OR (length(line) <= 300 AND ({said([x for x in q.BOILERPLATE if x not in q.COMMON])} OR ({said(q.COMMON)} AND {mostly})))
  OR (length(line) >= {q.UNMARKED_CHARS} AND NOT ({has(q._USUAL)} OR {others})) OR NOT {has(letter)})"""
    return rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_W}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM t),
tok AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
grams AS (SELECT r, i, a || ' ' || b || ' ' || c AS g FROM (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE c IS NOT NULL),
twins AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twins) GROUP BY r),
bad AS (SELECT r, sum(len(regexp_extract_all(line, '{_W}')))::BIGINT AS n FROM (SELECT r, unnest(lines) AS line FROM w) WHERE {fails} GROUP BY r),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(bad.n, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN bad USING (r))
SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AND lost_words <= {q.MAX_LOST}::DOUBLE * n_words AS kept FROM counts"""


OP12 = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS alike, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


_FEATURES = r"""SELECT {0} AS r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature
  FROM (SELECT {0}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {1})"""
#: A string's crc32, a byte at a time over its hexadecimal form; t.crc has the change by each byte.
_CRC = """xor(4294967295, list_reduce(list_transform(range(0, strlen(feature)), lambda j: ('0x' || substr(hex(encode(feature)), 2 * j + 1, 2))::BIGINT),
  lambda a, b: xor(t.crc[xor(a, b) % 256 + 1], a // 256), 4294967295))"""
OP13 = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i)) AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
own AS (SELECT r, feature, count(*)::BIGINT AS n FROM ({_FEATURES.format('r', 'd')}) GROUP BY ALL),
wanted AS (SELECT feature, count(*)::BIGINT AS n FROM ({_FEATURES.format('1', 'benchmark')}) GROUP BY feature),
known AS (SELECT feature, {_CRC} % 10000 AS bucket FROM (SELECT feature FROM own UNION SELECT feature FROM wanted), t),
s AS (SELECT bucket, sum(n) AS n FROM own JOIN known USING (feature) GROUP BY bucket), b AS (SELECT bucket, sum(n) AS n FROM wanted JOIN known USING (feature) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM b), 0)::DOUBLE AS t),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(b.n, 0) + 1)::DOUBLE * (totals.s + 10000)) / ((coalesce(s.n, 0) + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain
  FROM s FULL JOIN b USING (bucket), totals),
sums AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS total FROM own JOIN known USING (feature) JOIN gains USING (bucket) GROUP BY r),
weights AS (SELECT d.r, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, ((coalesce(total, 0) - ((coalesce(total, 0) % n) + n) % n) // n)::BIGINT AS weight
  FROM (SELECT *, greatest(coalesce(n_features, 1), 1)::HUGEINT AS n FROM d LEFT JOIN sums USING (r)) d),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM weights),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight)::BIGINT AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 39)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN fit USING (r)
"""
