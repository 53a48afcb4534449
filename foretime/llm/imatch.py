"""I-Match document fingerprints.

Built of DataFrame functions only. Terms are the words `[^\\x20\\x09-\\x0D]+` of the lower-cased
text, by their 64-bit hash. The lexicon keeps the terms whose document frequency over the whole corpus
lies in a band of shares, that is a band of inverse document frequencies. A term needs at least the
lower share, so the lexicon has at most (mean number of distinct terms of a text) / BAND[0] terms,
however many documents there are; it is broadcast when its count shows that it is small. Distinct words are laid out
and meet it where the text lies, so most of them go before anything is gathered, and gathering follows the
partitioning that the texts already have.

A fingerprint hashes the sorted distinct lexicon terms of a text: once for the whole lexicon and
once for each of LEVELS * EACH randomised subsets, which are fixed for the lexicon: a term is in a subset
of level l with probability 2 ** -(FIRST + l). Large subsets serve texts with few lexicon terms,
small ones texts with many. Likeness is the share of equal subset hashes, over the levels that are
sparse for the two texts: those with a subset that holds no term of either.

Cases: a null text counts as empty; a text without lexicon terms, as an empty one, is hashed as
it is, so it is like equal texts only. Rows of one doc_id are put in order of their text hash, rows
that repeat id and text count as one document in the order; null ids come last. The next document
of the last is the first; a single document is followed by itself. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import NO_ID, materialise, small, text_of

#: Subsets: levels, subsets of each, and the power of a half that is the share of the first level.
LEVELS, EACH, FIRST = 8, 7, 3
SUBSETS = LEVELS * EACH
#: Document frequencies of the lexicon, as shares of all documents.
BAND = (0.001, 0.1)
#: Fewest documents that hold a term of the lexicon.
LEAST = 5
_EMPTY = "0" * 8
#: A code has the number of the subset (SUBSETS: the whole lexicon) above so many bits, the term's high bits below.
_TERM_BITS = 57


def words_of(text: Column) -> Column:
    """The words of a text, repeats included; an empty string may stand at both ends."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def _in_subset(term: Column, k: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(term, F.lit(k)), 64 - FIRST - k // EACH) == 0


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, least: int = LEAST) -> DataFrame:
    """term, codes (one for each subset that holds it, and one for the whole): the lexicon of docs, of terms in the band that least documents hold. Counts cover all documents."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(words_of(text_of()))).alias("word")).filter("word <> ''").select(F.xxhash64("word").alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.filter((F.col("df") >= F.lit(max(float(least), band[0] * n))) & (F.col("df") <= F.lit(max(float(least), band[1] * n))))
    code = lambda k: F.lit(k << _TERM_BITS).bitwiseOR(F.shiftrightunsigned("term", 64 - _TERM_BITS))
    codes = F.array_compact(F.array(*[F.when(_in_subset(F.col("term"), k), code(k)) for k in range(SUBSETS)], code(SUBSETS)))
    return materialise(kept.select("term", codes.alias("codes")), "imatch-lexicon")


def _one(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda over an array of it alone."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digests(codes: Column, plain: Column) -> Column:
    """The fingerprint of a text with these codes of lexicon terms, as bytes: 8 for the whole lexicon, then 4 for each subset; without terms those of plain, and all subsets empty.

    One sort puts the distinct terms of all subsets in order; marks that sort before the codes of each subset tell where it begins.
    """
    marks = F.array(*[F.lit(k << _TERM_BITS) for k in range(SUBSETS + 2)])
    places = lambda x: F.transform(marks, lambda mark: F.array_position(x, mark).cast("int"))

    def hashed(x: Column, at: Column, k: Column) -> Column:
        begin, end = F.element_at(at, k + 1), F.element_at(at, k + 2)
        return F.when(end - begin > 1, F.lpad(F.hex(F.xxhash64(F.slice(x, begin + 1, end - begin - 1))), 16, "0"))

    def digits(x: Column, at: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.coalesce(F.substring(hashed(x, at, k), 9, 8), F.lit(_EMPTY)))
        return F.concat(F.coalesce(hashed(x, at, F.lit(SUBSETS)), F.substring(F.hex(plain), 1, 16)), F.array_join(each, ""))

    return F.unhex(_one(F.sort_array(F.concat(codes, marks)), lambda x: _one(places(x), lambda at: digits(x, at))))


def _with_prints(rows: DataFrame, words: DataFrame, texts: dict[str, Column], carried: list[str]) -> DataFrame:
    """id, tie, carried, and for each of texts its fingerprint (bytes) by the lexicon words. id and tie must tell rows apart.

    The distinct words are laid out and meet the lexicon; what is gathered again is the codes of those that it holds. When rows
    come partitioned by (id, tie), all of that stays in its partition.
    """
    names = list(texts)
    laid = rows.select("id", "tie", F.struct(*carried).alias("meta"), F.array(*texts.values()).alias("bodies")).select("id", "tie", "meta", F.posexplode("bodies").alias("which", "body"))
    laid = laid.withColumn("meta", F.struct("meta", F.unhex(F.md5("body")).alias("plain")))
    laid = laid.select("id", "tie", "which", "meta", F.posexplode(F.array_distinct(words_of(F.col("body")))).alias("place", "word"))
    # the first word stays in any case, so that no row is lost, and it alone carries what belongs to the row
    laid = laid.select("id", "tie", "which", F.when(F.col("place") == 0, F.col("meta")).alias("meta"), F.xxhash64("word").alias("term"))
    met = laid.join(small(words), "term", "left").filter("codes IS NOT NULL OR meta IS NOT NULL").drop("term")
    each = met.groupBy("id", "tie", "which").agg(F.first("meta", ignorenulls=True).alias("meta"), F.flatten(F.collect_list("codes")).alias("codes"))
    each = each.select("id", "tie", "which", "meta", _digests(F.col("codes"), F.col("meta.plain")).alias("print"))
    own = lambda k: F.first(F.when(F.col("which") == k, F.col("print")), ignorenulls=True)
    made = each.groupBy("id", "tie").agg(F.first("meta.meta").alias("meta"), *[own(k).alias(name) for k, name in enumerate(names)])
    return made.select("id", "tie", *[F.col("meta." + c).alias(c) for c in carried], *names)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints (bytes): the share of equal hashes among the subsets with terms, over the levels in which some subset has none of either text; without such subsets 1 for equal fingerprints, else 0."""
    of = lambda c, k: F.substring(c, k * 4 + 9, F.lit(4))
    told = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.when(of(a, k) != of(b, k), 1).when(of(a, k) == F.unhex(F.lit(_EMPTY)), 0).otherwise(2))
    levels = lambda x: F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.slice(x, k * EACH + 1, F.lit(EACH)))
    sparse = _one(told, lambda x: F.flatten(F.filter(levels(x), lambda level: F.array_contains(level, 0))))
    share = lambda x: F.when(F.array_contains(x, 1) | F.array_contains(x, 2), F.size(F.filter(x, lambda t: t == 2)) / F.size(F.filter(x, lambda t: t > 0)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(_one(sparse, share), F.lit(0.0)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text_of(), F.col("doc_id").isNull()).alias("tie"), text_of().alias("text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """id, tie, no_id, copies, next_id, next_tie, prev_id, prev_tie, prev_chars: a row for each document in ascending order, the first after the last.

    Documents are dealt by ranges of the id; in each range a window finds the neighbours, and the ends of the
    ranges, one row for each partition, are linked among themselves.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(docs).select("id", "tie", "no_id", F.char_length("text").cast("long").alias("chars")).groupBy("id", "tie", "no_id", "chars").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    dealt = materialise(rows.repartitionByRange(parts, "id", "tie").withColumn("part", F.spark_partition_id()), "imatch-order")
    me = F.struct("id", "tie", "chars")
    w = Window.partitionBy("part").orderBy("id", "tie")
    near = materialise(dealt.select("part", "id", "tie", "no_id", "copies", F.lead(me).over(w).alias("next"), F.lag(me).over(w).alias("prev"), me.alias("me")), "imatch-near")
    # one row for each partition
    ends = near.groupBy("part").agg(F.min("me").alias("first"), F.max("me").alias("last"))
    over, whole = Window.orderBy("part"), Window.partitionBy()
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(over), F.min("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(over), F.max("last").over(whole)).alias("before"),
    )
    linked = near.join(ends, "part").select("id", "tie", "no_id", "copies", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))
    return linked.select("id", "tie", "no_id", "copies", F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie"), F.col("prev.id").alias("prev_id"), F.col("prev.tie").alias("prev_tie"), F.col("prev.chars").alias("prev_chars"))


def _distinct_rows(docs: DataFrame) -> DataFrame:
    """id, tie, no_id, text, copies: rows that repeat id and text are one, combined before the shuffle."""
    return _rows(docs).groupBy("id", "tie").agg(F.first("no_id").alias("no_id"), F.first("text").alias("text"), F.count(F.lit(1)).cast("int").alias("copies"))


def _each_copy(df: DataFrame) -> DataFrame:
    """A row for each row of the table again."""
    return df.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def _hex(name: str) -> Column:
    return F.lower(F.hex(name)).alias(name)


def fingerprints(docs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, fingerprint: a row for each row of docs, by the lexicon words."""
    made = _with_prints(_distinct_rows(docs), words, {"fingerprint": F.col("text")}, ["no_id", "copies"])
    return _each_copy(made).select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), _hex("fingerprint"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """id, tie, no_id, copies, next_id, next_tie, text, edited: the last quarter of the text is replaced by the beginning of the next document.

    Each text is shuffled once, by its id; what of it goes to the document before is a quarter of that one's length at most.
    """
    links = materialise(neighbours(docs), "imatch-links")
    # both sides of the join below need the same columns of the texts, so Spark shuffles them once
    texts = _distinct_rows(docs).select("id", "tie", "text").join(links, ["id", "tie"])
    heads = texts.select(F.col("prev_id").alias("id"), F.col("prev_tie").alias("tie"), F.expr("left(text, cast(prev_chars div 4 as int))").alias("head"))
    edited = F.concat(F.expr("left(text, cast(char_length(text) - char_length(text) div 4 as int))"), F.coalesce("head", F.lit("")))
    return texts.join(heads, ["id", "tie"], "left").select("id", "tie", "no_id", "copies", "next_id", "next_tie", "text", edited.alias("edited"))


def edit_study(docs: DataFrame, band: tuple[float, float] = BAND, least: int = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: how alike are a document's fingerprint and those of its edited text and of the next document."""
    words = lexicon(docs, band, least)
    texts = edited_texts(docs).withColumns({"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.unhex(F.sha2("edited", 256))})
    made = _with_prints(texts, words, {"fingerprint": F.col("text"), "edited_fingerprint": F.col("edited")}, ["no_id", "copies", "next_id", "next_tie", "n_chars", "edited_sha256"])
    made = materialise(made, "imatch-prints")
    following = made.select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("fingerprint").alias("next_fingerprint"))
    # names that are made anew stand in a select of their own: inside lambdas they would be taken for the columns of the same select
    alike = made.join(following, ["next_id", "next_tie"]).withColumns(
        {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))}
    )
    return _each_copy(alike).select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_chars", _hex("edited_sha256"), _hex("fingerprint"), _hex("edited_fingerprint"), "near_edited", "near_next")
