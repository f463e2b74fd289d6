"""All queries of the engine, by name, with their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import arrays as A
from lexiflow.functions import scores as S
from lexiflow.functions import tables as TF
from lexiflow.functions import text as T
from lexiflow.functions import values as V
from lexiflow.operators import keywords as K
from lexiflow.operators import lexicon as L
from lexiflow.operators import clips, hmm, layers, matching, names, preferences, punkt, spans, tagging, terms
from lexiflow.operators import words as W
from lexiflow.plans import sql as Q
from lexiflow.sources import cache
from lexiflow.sources import html as H
from lexiflow.sources import tables as B
from lexiflow.streaming import sessions

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = T.spelled(sql)
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return B.dealt(B.table(spark, d, "documents").select("doc_id", "text", "lang"))


def _paras(spark: SparkSession, d: str, lang: str | None = "en") -> DataFrame:
    return B.paragraphs(_docs(spark, d), lang)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return B.texts(_docs(spark, d))


def _named_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with the names in them, in the row."""
    return _texts(spark, d).withColumn("entities", tagging.entity_array())


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").filter("lang = 'en'").select("doc_id")


def _freq(spark: SparkSession, d: str) -> DataFrame:
    return B.frequency_list(_docs(spark, d))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


_RAW_LINES = """WITH raw_lines AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each_line AS (SELECT r, doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS para_idx FROM raw_lines),
placed_lines AS (SELECT *, sum(length(raw) + 1) OVER (PARTITION BY r ORDER BY para_idx) - length(raw) - 1 AS line_start FROM each_line),"""
_PLACES = """pieces_of AS (SELECT *, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(raw, '\\s+|\\S+') AS l FROM {0})),
word_places AS (SELECT * EXCLUDE (l), sum(length(piece)) OVER w - length(piece) AS word_start, sum(length(piece)) OVER w AS word_end, count(*) FILTER (WHERE regexp_matches(piece, '\\S')) OVER w AS word_no
  FROM pieces_of WINDOW w AS (PARTITION BY {1} ORDER BY i)),
sentence_list AS (SELECT *, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sent_idx FROM (SELECT *, {2} AS ss FROM {0})),
sentence_words AS (SELECT * EXCLUDE (ss), sum(len(string_split(s, ' '))) OVER (PARTITION BY {1} ORDER BY sent_idx) AS last_word, len(string_split(s, ' ')) AS n FROM sentence_list),
sentence_spans AS (SELECT s.*, a.word_start, b.word_end FROM sentence_words s JOIN word_places a ON {3} AND a.word_no = s.last_word - s.n + 1 AND regexp_matches(a.piece, '\\S')
  JOIN word_places b ON {4} AND b.word_no = s.last_word AND regexp_matches(b.piece, '\\S'))"""


def _same(left: str, right: str, keys: list[str]) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys)


def _places(rows: str, keys: list[str]) -> str:
    """CTEs from rows (keys, raw) to sentence_spans: every sentence with the place of its first and last word."""
    return _PLACES.format(rows, ", ".join(keys), Q.sentences("raw"), _same("a", "s", keys), _same("b", "s", keys))


@_query(f"""{Q.BASE}, n AS (SELECT doc_id, term, count(*)::BIGINT AS n, min(place) AS first FROM (SELECT doc_id, place, {Q.CLEAN.format('raw')} AS term FROM toks)
  WHERE length(term) >= 3 AND term NOT IN {Q.STOPS} AND term NOT IN {Q.STARTERS} GROUP BY doc_id, term)
SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::BIGINT AS rank FROM n QUALIFY rank <= 5""")
def keyword_frequency(spark, d):
    return K.keyword_frequency(_paras(spark, d))


_GATE = f"""{Q.ALL_LANGUAGES} SELECT doc_id, para_idx, text FROM paras WHERE text <> '' AND len(string_split_regex(text, '\\s+')) >= """


@_query(_GATE + "18")
def paragraphs_18(spark, d):
    return _paras(spark, d, None).filter(H.tokens_of(F.col("text")) >= 18)


@_query(_GATE + "30")
def body_paragraphs_30(spark, d):
    return _paras(spark, d, None).filter(H.tokens_of(F.col("text")) >= 30)


@_query(f"""{Q.BASE} SELECT doc_id, para_idx, i - 1 AS sent_idx, sentence FROM (SELECT doc_id, para_idx, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM (SELECT *, {Q.sentences('text')} AS s FROM paras))""")
def sentences(spark, d):
    return W.sentence_rows(_paras(spark, d))


@_query(f"""{Q.BASE} SELECT doc_id, sum(len({Q.sentences('text')}))::BIGINT AS n_sentences FROM paras GROUP BY doc_id""")
def sentence_counts(spark, d):
    return _paras(spark, d).groupBy("doc_id").agg(F.sum(F.size(T.sentences(F.col("text")))).cast("long").alias("n_sentences"))


def _spoken(spark, d):
    """Paragraphs of all languages with their language."""
    docs = _docs(spark, d).filter("lang IS NOT NULL")
    lines = docs.select("lang", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("para_idx", "text"))
    return lines.select("lang", "doc_id", F.col("para_idx").cast("long").alias("para_idx"), T.trimmed(F.col("text")).alias("text"))


_EVERY_LINE = f"""WITH spoken AS (SELECT lang, doc_id, i - 1 AS para_idx, {Q.TRIM.format('t')} AS text FROM (SELECT lang, doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
  SELECT lang, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE lang IS NOT NULL))),
spoken_tokens AS (SELECT lang, doc_id, para_idx, i, raw, regexp_replace(raw, '^[^\\pL\\pN]+|[^\\pL\\pN.]+$', '', 'g') AS bare FROM (SELECT lang, doc_id, para_idx, unnest(l) AS raw, generate_subscripts(l, 1) AS i
  FROM (SELECT *, string_split_regex(text, '\\s+') AS l FROM spoken))),
typed AS (SELECT lang, {Q.LOWER.format("regexp_replace(bare, '[.]+$', '')")} AS word, regexp_matches(bare, '[^.][.]$') AS stopped FROM spoken_tokens),
types AS (SELECT lang, word, count(*)::BIGINT AS n, count(*) FILTER (WHERE stopped)::BIGINT AS n_stopped FROM typed WHERE regexp_matches(word, '\\pL') GROUP BY ALL),
chances AS (SELECT lang, (sum(n_stopped) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE AS p FROM types GROUP BY lang),
likely AS (SELECT t.*, length(replace(word, '.', ''))::DOUBLE AS letters, length(regexp_replace(word, '[^.]', '', 'g'))::DOUBLE AS inside,
  2::DOUBLE * ((n_stopped * ln({punkt.STOPPED}::DOUBLE) + (n - n_stopped) * ln(1 - {punkt.STOPPED}::DOUBLE)) - (n_stopped * ln(p) + (n - n_stopped) * ln(1 - p))) AS ratio FROM types t JOIN chances USING (lang) WHERE n_stopped > 0),
learnt AS (SELECT lang, word, n, n_stopped, round(ratio * exp(-letters) * (inside + 1) * pow(letters, n_stopped - n) + CASE WHEN regexp_matches(word, '^(?:{"|".join(x.lower() for x in V.ABBREVIATIONS)})$') THEN {punkt.PRIOR} ELSE 0 END::DOUBLE, 6) + 0 AS score FROM likely)"""


@_query(f"""{_EVERY_LINE} SELECT *, score >= {punkt.LEAST} AS is_abbreviation FROM learnt""")
def learnt_abbreviations(spark, d):
    return punkt.abbreviations(_spoken(spark, d))


@_query(f"""{_EVERY_LINE}, ends AS (SELECT lang, doc_id, para_idx, CASE WHEN regexp_matches(raw, '[^.][.]$') THEN {Q.LOWER.format("regexp_replace(bare, '[.]+$', '')")} END AS word FROM (
  SELECT *, lead(raw) OVER (PARTITION BY doc_id, para_idx ORDER BY i) AS next FROM spoken_tokens) WHERE regexp_matches(raw, '[.!?]$') AND NOT regexp_matches(next, '^[a-z]')),
told AS (SELECT e.doc_id, e.para_idx, count(*) FILTER (WHERE l.word IS NULL) AS n_ends, count(l.word) AS n_joined FROM ends e LEFT JOIN learnt l ON e.lang = l.lang AND e.word = l.word AND l.score >= {punkt.LEAST} GROUP BY ALL)
SELECT lang, doc_id, para_idx, (coalesce(n_ends, 0) + 1)::BIGINT AS n_sentences, coalesce(n_joined, 0)::BIGINT AS n_joined FROM spoken LEFT JOIN told USING (doc_id, para_idx) WHERE text <> ''""")
def learnt_sentences(spark, d):
    paras = _spoken(spark, d)
    return punkt.sentences(paras, punkt.abbreviations(paras))


#: Settings that events change: an event's type is the key.
SETTINGS = {"click": 10.0, "view": 20.0, "purchase": 5.0}


def _changes(spark, d):
    names = F.col("user_id").alias("owner"), F.col("event_type").alias("key"), "value", F.col("ts").alias("at"), F.col("event_id").alias("seq")
    return B.table(spark, d, "events").select(*names)


_SETTINGS = "WITH last AS (SELECT user_id AS owner, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts IS NOT NULL{0} GROUP BY ALL)"


@_query(f"{_SETTINGS.format('')} SELECT * FROM last")
def effective_settings(spark, d):
    return preferences.effective(_changes(spark, d)).select("owner", "key", "value")


def _wide(name: str, where: str) -> str:
    own = ", ".join(f"coalesce(max(value) FILTER (WHERE key = '{k}'), {v}::DOUBLE) AS {k}" for k, v in SETTINGS.items())
    kept = Q.among(SETTINGS)
    return f"{name} AS (SELECT owner, {own} FROM (SELECT user_id AS owner, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts IS NOT NULL{where} GROUP BY ALL) WHERE key IN {kept} GROUP BY owner)"


@_query(f"""WITH {_wide('now', '')}, {_wide('before', " AND ts <= TIMESTAMP '2024-01-30 20:00:00'")}
SELECT owner FROM now LEFT JOIN before b USING (owner) WHERE {" OR ".join(f"now.{k} IS DISTINCT FROM coalesce(b.{k}, {v})" for k, v in SETTINGS.items())}""")
def changed_settings(spark, d):
    return preferences.changed(_changes(spark, d), F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), SETTINGS)


def measures(texts: DataFrame) -> DataFrame:
    """(digest, n_tokens, n_sentences) of texts."""
    x = F.col("_x")
    rows = texts.select("digest", T.collapse(F.col("text")).alias("_x"))
    return rows.select("digest", T.collapsed_words(x).cast("long").alias("n_tokens"), F.size(T.collapsed_sentences(x)).cast("long").alias("n_sentences"))


@_query(f"""SELECT doc_id, sha256(coalesce(text, '')) AS digest, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\\s+')) END::BIGINT AS n_tokens, len({Q.sentences('t')})::BIGINT AS n_sentences
FROM (SELECT DISTINCT doc_id, text, {Q.TRIM.format("coalesce(text, '')")} AS t FROM documents)""")
def cached_measures(spark, d):
    return cache.Analyses(spark, B.scratch(spark, "analyses"), {"of": "measures"}, measures).run(f"{d}/documents.parquet")


#: Quiet for so long, and an event counts.
GAP = "2 hours"


@_query("""WITH gaps AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '2 hours', true) AS fresh FROM events WHERE ts IS NOT NULL),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM gaps)
SELECT user_id, min(epoch_us(ts)) AS first_at, max(epoch_us(ts)) AS last_at, count(*) AS n, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM runs GROUP BY user_id, run""")
def debounced_events(spark, d):
    return sessions.debounced(B.table(spark, d, "events"), GAP, ["user_id"], ["event_id", "event_type"])


@_query(f"""{Q.BASE}, {Q.SCORED} SELECT doc_id, para_idx, sentence_count, avg_word_len, avg_sent_len, syllable_density, flesch, score, action FROM scored""")
def paragraph_scores(spark, d):
    return S.paragraph_scores(_paras(spark, d)).drop("text")


@_query(f"""{Q.BASE}, {Q.SCORED} SELECT action, count(*)::BIGINT AS n FROM scored GROUP BY action""")
def action_summary(spark, d):
    return S.paragraph_scores(_paras(spark, d)).groupBy("action").agg(F.count("*").alias("n"))


@_query(f"""{Q.BASE}, {Q.SCORED}, met AS (SELECT p.doc_id, p.para_idx, arg_min(s.action, s.para_idx) AS action FROM paras p JOIN scored s ON p.doc_id = s.doc_id AND starts_with(p.text, substr(s.text, 1, 80)) GROUP BY ALL),
lists AS (SELECT doc_id, para_idx, {Q.split_sentences('text')} AS l FROM paras JOIN met USING (doc_id, para_idx) WHERE action IN ('split', 'llm'))
SELECT doc_id, para_idx, i - 1 AS sent_idx, sentence FROM (SELECT doc_id, para_idx, unnest(l) AS sentence, generate_subscripts(l, 1) AS i FROM lists WHERE len(l) >= 2)""")
def sentence_split(spark, d):
    return W.sentence_split(W.heads_of(_texts(spark, d)), S.paragraph_scores(_paras(spark, d)).select("doc_id", "para_idx", "text", "action"))


_WORDS = f"occ AS (SELECT doc_id, para_idx, unnest(regexp_extract_all(text, {Q.quoted(T.WORD)})) AS word FROM paras)"


@_query(f"""{Q.BASE}, {_WORDS}, n AS (SELECT lower(word) AS word, count(*)::BIGINT AS n FROM occ GROUP BY 1)
SELECT word, n, {Q._syllables_word('word')}::BIGINT AS syllables, round({Q.COMPLEXITY}, 6) AS score FROM n LEFT JOIN freq USING (word)""")
def word_complexity(spark, d):
    return W.word_complexity(_paras(spark, d), _freq(spark, d))


@_query(f"""{Q.BASE}, {_WORDS}, n AS (SELECT doc_id, word, count(*)::BIGINT AS n FROM occ WHERE NOT regexp_matches(word, '^[A-Z]') GROUP BY ALL)
SELECT doc_id, word, n, {Q.TIER} AS tier FROM n LEFT JOIN freq USING (word) WHERE {Q.TIER} IS NOT NULL""")
def complex_vocabulary(spark, d):
    return W.complex_vocabulary(_paras(spark, d), _freq(spark, d))


_WORD_PLACES = f"""pieces AS (SELECT doc_id, para_idx, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, para_idx, regexp_extract_all(text, {Q.quoted(T.WORD + '|(?s:.)')}) AS l FROM paras)),
placed AS (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id, para_idx ORDER BY i) AS stop FROM pieces),
tiered AS (SELECT doc_id, para_idx, (stop - length(word))::BIGINT AS start, stop::BIGINT AS "end", word, {Q.TIER} AS tier FROM placed LEFT JOIN freq USING (word) WHERE length(word) > 1 AND NOT regexp_matches(word, '^[A-Z]') AND {Q.TIER} IS NOT NULL)"""


@_query(f"""{Q.BASE}, {_WORD_PLACES} SELECT * FROM tiered""")
def underline_tiers(spark, d):
    return W.underline_tiers(_paras(spark, d), _freq(spark, d))


@_query(f"""{Q.BASE}, {Q.ACRONYMS} SELECT doc_id, acronym, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::BIGINT AS rank FROM acr""")
def acronyms(spark, d):
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")).cast("long")
    return K.acronyms(_paras(spark, d)).select("doc_id", "acronym", "n", rank.alias("rank"))


@_query(f"""{Q.BASE} SELECT doc_id, word, count(*)::BIGINT AS n FROM (SELECT doc_id, lower(regexp_replace(raw, '[^a-zA-Z]', '', 'g')) AS word FROM toks) WHERE length(word) >= 8 GROUP BY ALL HAVING count(*) <= 2""")
def rare_long_words(spark, d):
    return K.rare_long_words(_paras(spark, d))


@_query(f"""{Q.BASE}, {Q.science()} SELECT * FROM sci""")
def science_terms(spark, d):
    return K.science_terms(K.full_texts(_texts(spark, d)))


def _kind(name: str, kinds: tuple[str, ...]):
    def f(spark, d):
        return K.science_terms(K.full_texts(_texts(spark, d)), kinds)

    f.__name__ = name
    _query(f"{Q.WITH_TEXTS}, {Q.science(kinds)} SELECT * FROM sci")(f)


for _name, _kinds in (("genes", ("gene",)), ("loci", ("locus",)), ("suffix_terms", ("suffix",)), ("drugs", ("drug",)), ("formulas", ("formula",)), ("species", ("binomial", "abbreviated"))):
    _kind(_name, _kinds)


@_query(f"""{Q.BASE}, {Q.VOCAB_HITS} SELECT h.doc_id, h.term, v.branch, v.weight FROM hits h JOIN vocab v USING (term)""")
def vocabulary_hits(spark, d):
    vocab = B.vocabulary(_freq(spark, d))
    return K.vocabulary_hits(_paras(spark, d), vocab).join(vocab, "term").select("doc_id", "term", "branch", "weight")


@_query(f"""{Q.BASE}, {Q.ACRONYMS}, {Q.science()}, {Q.VOCAB_HITS}, {Q.FLAGS} SELECT * FROM flags WHERE doc_id IS NOT NULL""")
def term_flags(spark, d):
    return K.term_flags(None, B.vocabulary(_freq(spark, d)), texts=_named_texts(spark, d), ids=_ids(spark, d))


@_query(f"""{Q.BASE}, {Q.KEYWORDS} SELECT * FROM keywords""")
def keyword_scores(spark, d):
    freq = _freq(spark, d)
    return K.keyword_scores(None, freq, B.vocabulary(freq), texts=_named_texts(spark, d), ids=_ids(spark, d))


@_query(f"""{Q.BASE}, {Q.KEYWORDS}, {Q.TOP_TERMS} SELECT * FROM top""")
def paragraph_top_terms(spark, d):
    return K.paragraph_top_terms(None, keyword_scores(spark, d), texts=_texts(spark, d))


_BLOCKS = """blocks AS (SELECT doc_id, para_idx, text, text AS raw, 0 AS "offset", terms FROM paras JOIN (SELECT doc_id, para_idx, list(term) AS terms FROM top GROUP BY ALL) USING (doc_id, para_idx))"""


@_query(f"""{Q.BASE}, {Q.KEYWORDS}, {Q.TOP_TERMS}, {_BLOCKS}, {Q.SPANS} SELECT doc_id, para_idx, "start", "end", phrase FROM spans""")
def bold_spans(spark, d):
    return spans.document_spans(_texts(spark, d), keyword_scores(spark, d), ids=_ids(spark, d))


def _layered(spark, d):
    """Documents with their paragraphs, scored terms and underlined words, and what finds a document's layers: every other sentence, bold phrases
    and underlined words."""
    texts = terms.merged(_texts(spark, d), _ids(spark, d))
    words = W.underlined_words(texts, _freq(spark, d))
    rows = matching.with_terms(texts, keyword_scores(spark, d), "left").join(words, "doc_id", "left")
    every = lambda p: A.let(T.sentences(p["text"]), lambda s: clips.sentence_places(p["text"], s))
    ruled = lambda p: F.struct(*(p[c] for c in ("para_idx", "text")), F.filter(every(p), lambda _, i: i % 2 == 0).alias("ruled"))
    stops = spans.Stops(V.STOP_WORDS)

    def find(paras, *scored):
        *scored, words = scored
        words = frozenset(words or ())
        for p, (place, text, bold) in zip(paras, spans.spans_of_document(paras, scored, stops, 50), strict=True):
            yield place, text, [[(x["start"], x["end"]) for x in p["ruled"]], bold, [m.span() for m in W.small(text) if m[0] in words]]

    return rows.select("doc_id", F.transform("paras", ruled).alias("paras"), "terms", "scores", "ranks", "words"), ["mark", "b", "u"], find


_LAYERED = f"""{Q.BASE}, lines_of AS (SELECT doc_id, para_idx, text AS raw FROM paras), {_places('lines_of', ['doc_id', 'para_idx'])}, {Q.KEYWORDS}, {Q.TOP_TERMS}, {_BLOCKS}, {Q.SPANS}, {_WORD_PLACES},
layer_spans AS (SELECT doc_id, para_idx, word_start AS s, word_end AS e, 1 AS o, 'mark' AS layer FROM sentence_spans WHERE sent_idx % 2 = 0 UNION ALL SELECT doc_id, para_idx, "start", "end", 2, 'b' FROM spans
  UNION ALL SELECT doc_id, para_idx, start, "end", 3, 'u' FROM tiered),
cut_places AS (SELECT DISTINCT doc_id, para_idx, unnest([s, e]) AS s FROM layer_spans), runs AS (SELECT doc_id, para_idx, s, lead(s) OVER (PARTITION BY doc_id, para_idx ORDER BY s) AS e FROM cut_places),
segments AS (SELECT r.doc_id, r.para_idx, r.s, r.e, list(DISTINCT l.layer ORDER BY l.layer = 'u', l.layer = 'b') AS layers FROM runs r JOIN layer_spans l ON r.doc_id = l.doc_id AND r.para_idx = l.para_idx AND l.s <= r.s AND l.e > r.s GROUP BY ALL)"""


@_query(f"""{_LAYERED} SELECT doc_id, para_idx, s::BIGINT AS "start", e::BIGINT AS "end", array_to_string(layers, ' ') AS layers FROM segments""")
def text_layers(spark, d):
    return layers.document_segments(*_layered(spark, d))


@_query(f"""{_LAYERED}, tagged AS (SELECT doc_id, para_idx, s, e, array_to_string(list_transform(layers, lambda x: '<' || x || '>'), '') AS opened, array_to_string(list_transform(list_reverse(layers), lambda x: '</' || x || '>'), '') AS closed FROM segments),
whole AS (SELECT doc_id, para_idx, text, count(*) AS n, string_agg(substr(text, (coalesce(before, 0) + 1)::BIGINT, (s - coalesce(before, 0))::BIGINT) || opened || substr(text, (s + 1)::BIGINT, (e - s)::BIGINT) || closed, '' ORDER BY s) || substr(text, (max(e) + 1)::BIGINT) AS out
  FROM (SELECT t.*, p.text, lag(e) OVER (PARTITION BY doc_id, para_idx ORDER BY s) AS before FROM tagged t JOIN paras p USING (doc_id, para_idx)) GROUP BY doc_id, para_idx, text)
SELECT doc_id, para_idx, 2 * n AS n_marks, sha256(out) AS marked_sha256, sha256(text) AS restored_sha256 FROM whole""")
def layers_undone(spark, d):
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return layers.document_marked(*_layered(spark, d)).select("doc_id", "para_idx", "n_marks", digest("marked"), digest("restored"))


@_query(f"""{Q.BASE} SELECT doc_id, raw AS word, count(*)::BIGINT AS n FROM toks WHERE {Q.FALSE_CAPITAL} GROUP BY ALL""")
def false_capitals(spark, d):
    raw = F.explode(F.split("text", f"{T.JAVA_SPACE}+", -1)).alias("word")
    t = matching.with_false_capitals(_paras(spark, d)).select("doc_id", "_false", raw)
    return t.filter(F.array_contains("_false", F.col("word"))).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@_query(r"""SELECT doc_id, content, count(*)::BIGINT AS n, bool_or(regexp_matches(regexp_extract(content, '(\d+)[^\d]*$', 1), '^(19|20)\d{2}$') OR regexp_matches(content, '\b[eE][tT]\s+[aA][lL]\b')) AS is_citation
FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\(([^()]*)\)', 1)) AS content FROM documents) GROUP BY doc_id, content""")
def citation_parentheticals(spark, d):
    return W.citation_parentheticals(B.table(spark, d, "documents"))


_OFFSETS = r"""WITH trimmed AS (SELECT row_number() OVER () AS r, conv_id, turn, string_split_regex(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+') AS l FROM conversations),
ws AS (SELECT r, conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS word_idx FROM trimmed),
offs AS (SELECT r, conv_id, turn, word_idx, (sum(length(word) + 1) OVER (PARTITION BY r ORDER BY word_idx) - length(word) - 1)::BIGINT AS start, word FROM ws)"""


def _turns(spark, d):
    return B.table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))


@_query(f"{_OFFSETS} SELECT conv_id, turn, word_idx, start, word FROM offs")
def word_offsets(spark, d):
    return W.word_offsets(_turns(spark, d), ["conv_id", "turn"])


@_query(f"""{_OFFSETS}, marks AS (SELECT r, unnest([0, 10, 100])::BIGINT AS at FROM trimmed)
SELECT o.conv_id, o.turn, m.at, max(o.word_idx)::BIGINT AS word_idx, arg_max(o.word, o.word_idx) AS word FROM marks m JOIN offs o ON m.r = o.r AND (o.start <= m.at OR o.word_idx = 0) GROUP BY o.r, o.conv_id, o.turn, m.at""")
def offset_lookup(spark, d):
    places = F.array(*(F.lit(x).cast("long") for x in (0, 10, 100)))
    return W.offset_lookup(_turns(spark, d), places, ["conv_id", "turn"])


@_query(f"""{Q.ALL_LANGUAGES} SELECT doc_id, para_idx, i - 1 AS piece_idx, piece FROM (SELECT doc_id, para_idx, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, para_idx, regexp_extract_all(text, '\\S+|\\s+') AS l FROM paras))""")
def word_pieces(spark, d):
    return _long(_paras(spark, d, None).select("doc_id", "para_idx", F.posexplode(T.word_pieces(F.col("text"))).alias("piece_idx", "piece")), "piece_idx")


@_query(r"""SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents""")
def html_escaped(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.escape_html(F.coalesce("text", F.lit(""))).alias("escaped"))


def _pages(spark, d):
    return B.dealt(B.table(spark, d, "pages").select("page_id", "html"))


def _trees(spark, d):
    return H.page_trees(_pages(spark, d))


@_query(Q.page_gate(18))
def page_paragraphs(spark, d):
    return H.numbered(H.page_paragraphs(_trees(spark, d))).select("page_id", "para_no", "tag", "text")


@_query(Q.page_gate(30))
def page_body_paragraphs(spark, d):
    return H.numbered(H.body_paragraphs(_trees(spark, d))).select("page_id", "para_no", "tag", "text")


@_query(Q.page_gate(1))
def page_split_candidates(spark, d):
    return H.numbered(H.paragraph_elements(_trees(spark, d))).select("page_id", "para_no", "tag", "text")


@_query(f"""WITH {Q.PAGE_NODES} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY b, i)::BIGINT AS node_no, "offset", text FROM nodes
WHERE regexp_matches(text, '[A-Za-z]') AND length(text) >= 30""")
def page_text_nodes(spark, d):
    return H.numbered(H.readable_text(_trees(spark, d), 30, True), "node_no").select("page_id", "node_no", "offset", "text")


@_query(f"WITH {Q.ITALICS} SELECT * FROM italics")
def page_italic_terms(spark, d):
    return H.italic_terms(_trees(spark, d))


def _as_paras(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("page_id").alias("doc_id"), F.col("node_ord").alias("para_idx"), T.trimmed(F.col("text")).alias("text"))


@_query(Q.PAGE_KEYWORDS)
def page_keywords(spark, d):
    freq, trees = _freq(spark, d), _trees(spark, d)
    texts = H.body_texts(trees, italics=True).withColumn("entities", tagging.entity_array())
    ids = B.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return K.keyword_scores(None, freq, B.vocabulary(freq), texts=texts, ids=ids).withColumnRenamed("doc_id", "page_id")


@_query(Q.PAGE_BOLD_SPANS)
def page_bold_spans(spark, d):
    ids = B.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return spans.page_spans(H.bold_blocks(_trees(spark, d)), page_keywords(spark, d), ids=ids)


@_query(f"""SELECT page_id, generate_subscripts(l, 1) AS block_no, unnest(l) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<({"|".join(V.BLOCK_TAGS)})(?: [^>]*)?>', 1) AS l FROM pages WHERE html IS NOT NULL)""")
def page_outline(spark, d):
    TF.register(spark)
    return spark.sql("SELECT p.page_id, o.block_no, o.tag FROM {pages} p, LATERAL page_outline(p.html, 'blocks') o", pages=_pages(spark, d))


@_query(f"""WITH {Q.PAGE_NODES} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY b, i)::BIGINT AS node_no, tag, n_chars FROM nodes
WHERE regexp_matches(text, '[A-Za-z]')""")
def page_nearest_blocks(spark, d):
    return H.numbered(H.nearest_blocks(_trees(spark, d)), "node_no").select("page_id", "node_no", "tag", "n_chars")


@_query(f"""WITH {Q.PAGE_PARAS}, paras AS (SELECT page_id AS doc_id, p AS para_idx, text FROM page_paras WHERE text <> ''), {Q.SCORED}, met AS (SELECT p.doc_id, p.para_idx, arg_min(s.action, s.para_idx) AS action FROM paras p JOIN scored s ON p.doc_id = s.doc_id AND starts_with(p.text, substr(s.text, 1, 80))
  WHERE len(string_split_regex(s.text, '\\s+')) >= 18 GROUP BY ALL),
lists AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY para_idx) AS para_no, {Q.split_sentences('text')} AS l FROM paras JOIN met USING (doc_id, para_idx) WHERE action IN ('split', 'llm') AND len({Q.split_sentences('text')}) >= 2)
SELECT doc_id AS page_id, para_no, i - 1 AS sent_idx, sentence FROM (SELECT doc_id, para_no, unnest(l) AS sentence, generate_subscripts(l, 1) AS i FROM lists)""")
def page_sentence_split(spark, d):
    ids = B.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return W.sentence_split_rows(terms.merged(H.split_texts(_trees(spark, d)), ids)).withColumnRenamed("doc_id", "page_id")


@_query(f"""{_RAW_LINES} {_places('placed_lines', ['r', 'para_idx'])} SELECT doc_id, para_idx, sent_idx, (line_start + word_start)::BIGINT AS raw_start, (line_start + word_end)::BIGINT AS raw_end FROM sentence_spans""")
def sentence_offsets(spark, d):
    return clips.sentence_offsets(_docs(spark, d))


@_query(f"""WITH {Q.PAGE_PARAS}, blocks AS (SELECT page_id, p, inner_html LIKE '<b>%' AS bold, {Q._DECODED.format("regexp_replace(inner_html, '<[^>]*>', '', 'g')")} AS raw FROM raw_paras), {_places('blocks', ['page_id', 'p'])},
items AS (SELECT *, count(*) OVER (PARTITION BY page_id, p) AS n_items, substr(raw, word_start::BIGINT + 1, (word_end - word_start)::BIGINT) AS part FROM sentence_spans WHERE regexp_matches(s, '[A-Za-z0-9]'))
SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY p) AS para_no, row_number() OVER (PARTITION BY page_id, p ORDER BY sent_idx) - 1 AS sent_idx, word_start::BIGINT AS raw_start, word_end::BIGINT AS raw_end,
  CASE WHEN bold THEN '<b>' ELSE '' END || replace(replace(replace(part, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || CASE WHEN bold THEN '</b>' ELSE '' END AS html FROM items WHERE n_items >= 2""")
def page_sentence_items(spark, d):
    items = clips.sentence_items(H.inline_elements(_pages(spark, d)), ["page_id", "node_ord"])
    number = F.dense_rank().over(Window.partitionBy("page_id").orderBy("node_ord")).cast("long")
    return items.select("page_id", number.alias("para_no"), "sent_idx", "raw_start", "raw_end", "html")


@_query(r"""SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
  coalesce(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) = 'tionsh.example.net', false) AS enabled FROM pages""")
def page_hosts(spark, d):
    state = F.lit('{"tionsh.example.net": true, "other.example.org": false}')
    return H.site_enabled(B.table(spark, d, "pages"), state).select("page_id", "host", "enabled")


@_query(f"""{Q.BASE}, sents AS (SELECT doc_id, para_idx, i - 1 AS sent_idx, sentence FROM (SELECT doc_id, para_idx, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM (
  SELECT *, {Q.sentences('text')} AS s FROM paras))) {Q.POS}""")
def pos_tags(spark, d):
    return tagging.pos_tags(W.sentence_rows(_paras(spark, d)))


@_query()
def hmm_tags(spark, d):
    return hmm.pos_tags(W.sentence_rows(_paras(spark, d)), _freq(spark, d))


_NAMES = f"""{Q.BASE}, sents AS (SELECT doc_id, para_idx, unnest(s) AS sentence, generate_subscripts(s, 1) AS k FROM (SELECT *, {Q.sentences('text')} AS s FROM paras)),
raws AS (SELECT doc_id, para_idx, k, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split_regex(sentence, '\\s+') AS l FROM sents)),
cleaned AS (SELECT *, regexp_replace(raw, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g') AS w FROM raws),
placed_words AS (SELECT *, lower(w) AS word, regexp_matches(w, '^[A-Z][a-z]') AS capital, lag(w) OVER p AS last_w, lag(raw) OVER p AS last_raw FROM cleaned WINDOW p AS (PARTITION BY doc_id, para_idx, k ORDER BY i)),
befores AS (SELECT *, CASE WHEN capital AND regexp_matches(last_w, '^[A-Z][a-z]') AND regexp_matches(last_raw, '[A-Za-z]$') AND regexp_matches(raw, '^[A-Za-z]') THEN lower(last_w) END AS before FROM placed_words WHERE w <> ''),
name_words AS (SELECT word, count(*) FILTER (WHERE i > 1) AS n_inside, count(*) FILTER (WHERE i > 1 AND capital) AS n_capital, count(*) FILTER (WHERE capital) AS n_seen FROM befores GROUP BY word HAVING n_capital > 0 AND 2 * n_capital >= n_inside)"""


@_query(f"""{_NAMES} SELECT * FROM name_words""")
def name_words(spark, d):
    return names.name_words(W.sentence_rows(_paras(spark, d)))


@_query(f"""{_NAMES}, together AS (SELECT p.before, p.word FROM (SELECT before, word, count(*) AS n FROM befores WHERE before IS NOT NULL GROUP BY ALL) p JOIN name_words a ON a.word = p.before JOIN name_words b ON b.word = p.word WHERE {names.TOGETHER} * p.n >= least(a.n_seen, b.n_seen)),
runs AS (SELECT b.*, sum(CASE WHEN t.word IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para_idx, k ORDER BY i) AS run FROM befores b LEFT JOIN together t ON t.before = b.before AND t.word = b.word WHERE capital),
found AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS term FROM runs GROUP BY doc_id, para_idx, k, run HAVING count(*) >= {names.LEAST})
SELECT doc_id, term, count(*)::BIGINT AS n FROM found GROUP BY ALL""")
def learnt_names(spark, d):
    return names.names(W.sentence_rows(_paras(spark, d)))


@_query(f"""{Q.BASE}, {Q.ENTITIES} SELECT * FROM ents""")
def named_entities(spark, d):
    return tagging.entities(_paras(spark, d))


_CARDS = f"{Q.BASE}, {Q.LEXICON}, {Q.CARDS}"


def _cards(spark, d):
    freq = _freq(spark, d)
    lexicon = L.corpus_lexicon(_texts(spark, d), B.vocabulary(freq).select(F.col("term").alias("word")))
    return L.synonym_cards(lexicon, freq)


@_query(f"{_CARDS} SELECT * FROM cards")
def synonym_cards(spark, d):
    return _cards(spark, d)


@_query(f"{_CARDS}, {Q.SHOWN}")
def shown_cards(spark, d):
    cards = _cards(spark, d)
    shown = [L.shown(cards, tier).withColumn("tier", F.lit(tier)) for tier in ("lite", "full")]
    return shown[0].unionByName(shown[1]).select("word", "tier", "synonyms", "definitions")


@_query(Q.DICTIONARY)
def vocabulary_dictionary(spark, d):
    return L.vocabulary_from_records(L.records_of(_docs(spark, d)))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
