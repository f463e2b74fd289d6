"""Word cards from two offline lexicon tables, and the vocabulary built from descriptor records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import scores as S
from lexiflow.functions import text as T
from lexiflow.functions import values as V

SOURCE_A = "array<struct<word: string, score: int, tags: array<string>>>"
SOURCE_B = "array<struct<meanings: array<struct<partOfSpeech: string, synonyms: array<string>, definitions: array<struct<definition: string, synonyms: array<string>>>>>>>"
LIMIT_A = 30


def unfit_synonym(c: Column, word: Column) -> Column:
    """Too short or long, the word itself, the same three letters first, one inside the other, three words or more."""
    same = (F.length(word) >= 3) & (F.length(c) >= 3) & (F.substring(c, 1, 3) == F.substring(word, 1, 3))
    return ~F.length(c).between(2, 20) | (c == word) | same | F.contains(c, word) | F.contains(word, c) | (F.size(F.split(c, r"\s+")) > 2)


def circular(definition: Column, word: Column) -> Column:
    return F.regexp_like(F.lower(definition), F.concat(F.lit(T.EDGE), T.escape_regex(word), F.lit(T.EDGE)))


def short_definition(c: Column, longest: int = 200) -> Column:
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, longest), r"\s+\S*$", ""), F.lit("…")))


def pos_of_tags(tags: Column) -> Column:
    has = lambda t: F.coalesce(F.array_contains(tags, t), F.lit(False))
    return F.when(has("n"), "noun").when(has("v"), "verb").when(has("adj"), "adjective").when(has("adv"), "adverb").otherwise("other")


#: Endings by which a word of the corpus is taken for a part of speech: tag of the first source, name of the second, endings.
ENDINGS = (("v", "Verb", ("ed", "ing")), ("adv", "Adverb", ("ly",)), ("adj", "Adjective", ("ous", "ful", "al")))
MOST_FOLLOWERS, MOST_BEFORE, MOST_PLACES = 40, 10, 3


def _by_ending(word: Column, place: int, other: str) -> Column:
    out = F.lit(other)
    for entry in reversed(ENDINGS):
        out = F.when(word.rlike(f"(?:{'|'.join(entry[2])})$"), entry[place]).otherwise(out)
    return out


def _best(rows: DataFrame, by: str, order: list, most: int, item: Column, name: str) -> DataFrame:
    """(word, name): the first ``most`` rows of each ``by``, as an array (a top-k payload)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    kept = rows.withColumn("_rank", rank).filter(F.col("_rank") <= most)
    items = F.array_sort(F.collect_list(F.struct("_rank", item.alias("item"))))
    return kept.groupBy(F.col(by).alias("word")).agg(F.transform(items, lambda x: x["item"]).alias(name))


def corpus_lexicon(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """(word, a, b): a lexicon in the two sources' shapes, from what stands beside the words ``heads`` (word) in ``texts`` (doc_id, paras).

    The first source has a head's most frequent followers with their counts, the second the words most frequent before it, and
    as definitions the paragraphs after the first ones that hold it.  A source without anything is null.
    """
    words = texts.select("doc_id", F.posexplode("paras").alias("at", "p")).select(
        "doc_id", F.col("p.para_idx").alias("para_idx"), T.cleaned_tokens(F.col("p.text")).alias("w")
    )
    pair = F.transform("w", lambda x, i: F.struct(x.alias("first"), F.get("w", i + 1).alias("second")))
    pairs = words.select(F.explode(pair).alias("x")).select("x.*").filter("first <> '' AND second <> ''").groupBy("first", "second").agg(F.count("*").alias("n"))
    own = lambda name: heads.select(F.col("word").alias(name))
    tagged = F.struct(F.col("second").alias("word"), F.col("n").cast("int").alias("score"), F.array(_by_ending(F.col("second"), 0, "n")).alias("tags"))
    after = _best(pairs.join(own("first"), "first", "left_semi"), "first", [F.desc("n"), "second"], MOST_FOLLOWERS, tagged, "a")
    before = _best(pairs.join(own("second"), "second", "left_semi"), "second", [F.desc("n"), "first"], MOST_BEFORE, F.col("first"), "before")
    held = words.select("doc_id", "para_idx", F.explode(F.array_distinct("w")).alias("word")).join(own("word"), "word", "left_semi")
    rank = F.row_number().over(Window.partitionBy("word").orderBy("doc_id", "para_idx"))
    held = held.withColumn("_rank", rank).filter(F.col("_rank") <= MOST_PLACES)  # places first; texts join what is left
    following = texts.select("doc_id", F.explode("paras").alias("p")).select("doc_id", (F.col("p.para_idx") - 1).alias("para_idx"), F.col("p.text").alias("definition"))
    item = F.struct("definition", F.array().cast("array<string>").alias("synonyms"))
    told = held.join(following, ["doc_id", "para_idx"]).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("_rank", item.alias("item")))).alias("d"))
    told = told.select("word", F.transform("d", lambda x: x["item"]).alias("definitions"))
    senses = before.join(told, "word", "full")
    none = F.array().cast("array<string>")
    meaning = F.struct(
        _by_ending(F.col("word"), 1, "Noun").alias("partOfSpeech"), F.coalesce("before", none).alias("synonyms"),
        F.coalesce("definitions", F.array().cast("array<struct<definition: string, synonyms: array<string>>>")).alias("definitions"),
    )
    second = senses.select("word", F.to_json(F.array(F.struct(F.array(meaning).alias("meanings")))).alias("b"))
    return heads.select("word").join(after.select("word", F.to_json("a").alias("a")), "word", "left").join(second, "word", "left")


def records_of(docs: DataFrame) -> DataFrame:
    """(rec_ord, trees, names): documents as descriptor records, with two branches by number and the first three tokens as names."""
    branch = lambda n: F.substring(F.lit(BRANCHES), (n % len(BRANCHES) + 1).cast("int"), F.lit(1))
    n = F.col("doc_id")
    trees = F.array(F.concat(branch(n), F.lit("04."), (n % 7).cast("string")), F.concat(branch(F.floor(n / len(BRANCHES))), F.lit("12")))
    names = F.slice(T.tokens(F.coalesce("text", F.lit(""))), 1, 3)
    return docs.filter("doc_id IS NOT NULL").select(n.alias("rec_ord"), trees.alias("trees"), names.alias("names"))


#: Branches that documents take in turn; not all of them have a weight.
BRANCHES = "CDZGHANBEFIJ"


def synonyms(lexicon: DataFrame) -> DataFrame:
    """(word, pos, synonym, ord) from ``lexicon`` (word, a, b: JSON); a missing or broken source counts as empty."""
    lex = lexicon.select(F.lower("word").alias("word"), F.from_json("a", SOURCE_A).alias("a"), F.from_json("b", SOURCE_B).alias("b"))
    a = lex.select("word", F.posexplode(F.slice("a", 1, LIMIT_A)).alias("i", "x")).select("word", pos_of_tags(F.col("x.tags")).alias("pos"), F.trim(F.lower("x.word")).alias("synonym"), F.col("i").cast("long").alias("ord"))
    m = lex.select("word", F.posexplode("b").alias("e", "x")).select("word", "e", F.posexplode("x.meanings").alias("k", "m"))
    d = m.select("word", "e", "k", F.lower(F.coalesce("m.partOfSpeech", F.lit("other"))).alias("pos"), F.col("m.synonyms").alias("own"), F.posexplode("m.definitions").alias("j", "d"))
    both = F.concat(F.coalesce("d.synonyms", F.array().cast("array<string>")), F.coalesce("own", F.array().cast("array<string>")))
    b = d.select("word", "pos", "e", "k", "j", F.posexplode(both).alias("i", "s")).select("word", "pos", F.trim(F.lower("s")).alias("synonym"), (((F.lit(1).cast("long") + F.col("e")) * 1000 + F.col("k")) * 1000 + F.col("j")) * 1000 + F.col("i"))
    b = b.toDF("word", "pos", "synonym", "ord")
    found = a.unionByName(b).filter((F.col("synonym") != "") & ~unfit_synonym(F.col("synonym"), F.col("word")))
    return found.groupBy("word", "pos", "synonym").agg(F.min("ord").alias("ord"))


def definitions(lexicon: DataFrame) -> DataFrame:
    """(word, pos, definition): the first that does not use the word itself, shortened."""
    lex = lexicon.select(F.lower("word").alias("word"), F.from_json("b", SOURCE_B).alias("b"))
    m = lex.select("word", F.posexplode("b").alias("e", "x")).select("word", "e", F.posexplode("x.meanings").alias("k", "m"))
    d = m.select("word", "e", "k", F.lower(F.coalesce("m.partOfSpeech", F.lit("other"))).alias("pos"), F.posexplode("m.definitions").alias("j", "d"))
    good = d.filter((F.coalesce("d.definition", F.lit("")) != "") & ~circular(F.col("d.definition"), F.col("word")))
    return good.groupBy("word", "pos").agg(F.min_by(short_definition(F.col("d.definition")), F.struct("e", "k", "j")).alias("definition"))


def synonym_cards(lexicon: DataFrame, freq: DataFrame) -> DataFrame:
    """(word, pos, synonyms, definition, entry): simplest synonyms first, three at most; nouns last; empty entries left out."""
    syn = synonyms(lexicon).join(freq.withColumnRenamed("word", "synonym"), "synonym", "left")
    syn = syn.withColumn("score", S.complexity(F.col("synonym"), F.col("rank")))
    ranked = syn.groupBy("word", "pos").agg(F.array_sort(F.collect_list(F.struct("score", "ord", "synonym"))).alias("r"), F.min("ord").alias("first"))
    by_length = lambda sign: F.array_sort(F.transform("r", lambda x, i: F.struct((sign * F.length(x["synonym"])).alias("l"), i.alias("i"), x["synonym"].alias("synonym"))))[0]["synonym"]
    three = F.array_distinct(F.array(by_length(1), F.col("r")[0]["synonym"], by_length(-1)))
    ranked = ranked.withColumn("synonyms", F.when(F.size("r") <= 3, F.transform("r", lambda x: x["synonym"])).otherwise(three))
    out = ranked.select("word", "pos", "synonyms", "first").join(definitions(lexicon), ["word", "pos"], "full")
    noun = F.col("pos").isin("noun", "proper noun").cast("int")
    order = Window.partitionBy("word").orderBy(noun, F.coalesce("first", F.lit(1 << 62)), "pos")
    return out.select("word", "pos", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), "definition", F.row_number().over(order).cast("long").alias("entry"))


def shown(cards: DataFrame, tier: str) -> DataFrame:
    """(word, synonyms, definitions): what a card shows, 2 or 4 synonyms over all parts of speech, 1 or all definitions.

    Where a word has more than three synonyms, definitions with a longer word on its five-letter stem are left out.
    """
    w = cards.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("entry", "synonyms", "definition"))).alias("e"))
    every = F.flatten(F.transform("e", lambda x: x["synonyms"]))
    stem = F.substring("word", 1, 5)
    same_stem = lambda d: F.exists(F.split(F.lower(d), r"\W+"), lambda t: (F.length(t) > F.length(stem)) & F.contains(t, stem))
    defs = F.filter(F.transform("e", lambda x: x["definition"]), lambda d: d.isNotNull() & ~((F.size(every) > 3) & same_stem(d)))
    return w.select("word", F.slice(F.array_distinct(every), 1, 2 if tier == "lite" else 4).alias("synonyms"), (F.slice(defs, 1, 1) if tier == "lite" else defs).alias("definitions"))


def vocabulary_from_records(records: DataFrame) -> DataFrame:
    """(term, branch, weight) from ``records`` (rec_ord, trees array<string>, names array<string>).

    A record's branch is its heaviest allowed one, the earliest on ties; a term goes to its first record;
    terms under two characters and numbers are left out.
    """
    weights = F.create_map(*(F.lit(x) for kv in V.BRANCH_WEIGHTS.items() for x in kv))
    tree = records.select("rec_ord", F.posexplode("trees").alias("i", "tree")).withColumn("branch", F.substring("tree", 1, 1)).withColumn("weight", F.try_element_at(weights, F.col("branch"))).filter("weight IS NOT NULL")
    best = tree.groupBy("rec_ord").agg(F.max_by(F.struct("branch", "weight"), F.struct("weight", -F.col("i"))).alias("b"))
    names = records.select("rec_ord", F.posexplode("names").alias("i", "name")).withColumn("term", T.trimmed(F.lower("name"))).filter((F.length("term") >= 2) & ~F.col("term").rlike(r"^\d+$"))
    first = names.join(best, "rec_ord").groupBy("term").agg(F.min_by("b", F.struct("rec_ord", "i")).alias("b"))
    return first.select("term", "b.branch", "b.weight")


def read_records_xml(spark, path: str) -> DataFrame:
    """Descriptor records of an XML file in the shape ``vocabulary_from_records`` reads."""
    schema = "DescriptorName struct<String: string>, TreeNumberList struct<TreeNumber: array<string>>, ConceptList struct<Concept: array<struct<TermList: struct<Term: array<struct<String: string>>>>>>"
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(schema).load(path)
    own = F.coalesce(F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: t["String"]))), F.array().cast("array<string>"))
    return raw.select(F.monotonically_increasing_id().alias("rec_ord"), F.col("TreeNumberList.TreeNumber").alias("trees"), F.concat(F.array("DescriptorName.String"), own).alias("names"))


VOCABULARY = "term string, branch string, weight double"


def write_vocabulary_json(vocab: DataFrame, path: str) -> None:
    """The vocabulary as JSON, one object {term, branch, weight} a line, in as many files as it has parts."""
    vocab.select("term", "branch", "weight").write.mode("overwrite").json(path)


def read_vocabulary_json(spark, path: str, array: bool = False) -> DataFrame:
    """(term, branch, weight) of such a folder, or of a file that is one JSON ``array`` of the objects; the first of equal terms."""
    rows = spark.read.schema(VOCABULARY).option("multiLine", array).json(path)
    if not array:
        return rows
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    first = F.min_by(F.struct("branch", "weight"), "_at").alias("b")
    return rows.groupBy("term").agg(first).select("term", "b.branch", "b.weight")
