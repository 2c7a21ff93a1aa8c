"""Document quality rules by distribution divergence, in DataFrame operations only.

Base rules count repetition and length. The method's verdict compares two histograms of a document, of
character classes and of common words, with references of the document's language by Jensen-Shannon
distance. References are totals over all documents of a language, however rare; a word is common if it makes
up at least ``COMMON_SHARE`` of them, so there are at most 1 / COMMON_SHARE per language.
Length guards: shorter documents are never rejected by a histogram, and what chance alone adds to the
distance at a document's length is allowed on top of the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import words
from roadloom.session import cut, stored

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
COMMON_SHARE = 0.004
#: References of at most so many languages are broadcast (1 / COMMON_SHARE words each), and words that a literal set holds.
LANGUAGES, LITERAL = 2000, 50_000
#: Limits of the two Jensen-Shannon distances (square roots of the divergence in bits), and the least words.
CLASS_LIMIT, WORD_LIMIT, GUARD_WORDS = 0.29, 0.36, 40
#: Character classes; the rest is a class of its own.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:?'\"()-]", "space": r"[\x20\x09-\x0D]"}


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_words`` and the counts of the base rules; a null text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.withColumn("_text", text).withColumn("_words", words(F.col("_text")))
    d = d.withColumn("_hash", F.expr("transform(_words, w -> xxhash64(w))"))
    k = REPEAT_WINDOW
    span = 1
    while span < k:  # hashes of 2, 4 and 8 words from hashes of half as many
        d = d.withColumn("_hash", F.expr(f"CASE WHEN size(_hash) > {span} THEN zip_with(slice(_hash, 1, size(_hash) - {span}), slice(_hash, {span + 1}, size(_hash) - {span}), (x, y) -> xxhash64(x, y)) ELSE slice(_hash, 1, 0) END"))
        span *= 2
    d = d.withColumnRenamed("_hash", "_wins")
    d = d.withColumn("_again", F.expr("size(array_distinct(_wins)) < size(_wins)"))
    d = d.withColumn("_sorted", F.expr("CASE WHEN _again THEN array_sort(transform(_wins, (h, i) -> struct(h AS h, i AS i))) END"))
    d = d.withColumn("_at", F.expr("array_sort(transform(filter(_sorted, (s, i) -> (i > 0 AND s.h = _sorted[i - 1].h) OR (i + 1 < size(_sorted) AND s.h = _sorted[i + 1].h)), s -> s.i))"))
    covered = F.expr(f"aggregate(_at, struct(0L AS n, 0 AS reach), (a, p) -> struct(a.n + p + {k} - greatest(a.reach, p) AS n, p + {k} AS reach), a -> a.n)")
    lines = F.expr(r"filter(split(_text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    return (
        d.withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
        .drop("_wins", "_again", "_sorted", "_at", "_lines")
    )


def _plain_words() -> F.Column:
    """Words in lower case without stops and brackets; empty ones among them count for nothing."""
    return F.split(F.lower("_text"), r"""[\x20\x09-\x0D.,;:!?"()]+""", -1)


def _class_counts() -> list[F.Column]:
    """Characters per class; the commonest class is what is left when all else goes, space is what no word holds."""
    made = {"lower": F.length(F.regexp_replace("_text", r"[^\p{Ll}]+", "")), "space": F.length("_text") - F.col("word_chars")}
    return [made.get(c, F.regexp_count("_text", F.lit(p))).cast("double").alias(c) for c, p in CLASSES.items()]


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(_lang, words)``: per language, in order, the words that make up at least ``COMMON_SHARE`` of all its words."""
    d = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).where("_lang IS NOT NULL")
    totals = cut(d.groupBy("_lang").agg(F.sum(F.size(words(F.col("_text")))).alias("n")).where("n > 0"))
    each = d.select("_lang", F.explode(_plain_words()).alias("w")).where("w <> ''").groupBy("_lang", "w").agg(F.count("*").alias("c"))
    common = each.join(_small(totals, totals), "_lang").where(F.col("c") >= COMMON_SHARE * F.col("n")).groupBy("_lang").agg(F.array_sort(F.collect_list("w")).alias("words"))
    return cut(totals.join(common, "_lang", "left").select("_lang", F.coalesce("words", F.expr("cast(array() AS array<string>)")).alias("words")))


def _small(df: DataFrame, languages: DataFrame) -> DataFrame:
    """``df``, a row for each language, broadcast if there are at most ``LANGUAGES``."""
    return F.broadcast(df) if languages.limit(LANGUAGES + 1).count() <= LANGUAGES else df


def _distance(p: str, q: str) -> F.Column:
    """Jensen-Shannon distance of two arrays of shares, in SQL."""
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (p + q)) ELSE 0D END"
    return F.expr(f"sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (p, q) -> 0.5D * ({half('p')} + {half('q')})), 0D, (a, x) -> a + x)))")


def measured(docs: DataFrame, known: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` plus base counts, ``_lang``, ``_chars``, ``_kinds`` (characters per class) and ``_seen`` (occurrences of the language's common words)."""
    d = base_counts(docs, text_col).withColumn("_lang", F.col(lang_col).cast("string")).join(_small(known, known), "_lang", "left")
    listed = known.select(F.explode("words").alias("w")).distinct().limit(LITERAL + 1).collect()
    if len(listed) <= LITERAL:
        quoted = ", ".join("'" + r.w.replace("\\", "\\\\").replace("'", "\\'") + "'" for r in listed) or "''"
        common = f"filter(_plain, w -> w IN ({quoted}))"
    else:
        common = "filter(_plain, w -> array_contains(words, w))"
    d = d.withColumn("_plain", _plain_words()).withColumn("_common", F.expr(f"array_sort({common})"))
    # runs of equal words: where they start, and so how long they are
    d = d.withColumn("_starts", F.expr("filter(sequence(0, greatest(size(_common) - 1, 0)), i -> i < size(_common) AND (i = 0 OR _common[i] <> _common[i - 1]))"))
    d = d.withColumn("_counts", F.expr("map_from_arrays(transform(_starts, i -> _common[i]), transform(_starts, (i, k) -> coalesce(get(_starts, k + 1), size(_common)) - i))"))
    d = d.withColumn("_seen", F.expr("transform(words, w -> coalesce(_counts[w], 0))")).withColumn("_chars", F.length("_text")).withColumn("_kinds", F.array(*_class_counts()))
    return d.drop("words", "_text", "_words", "_plain", "_common", "_starts", "_counts")


def judge(rows: DataFrame, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """``measured`` rows with both distances (null without a language or words) and ``kept`` in place of the measurements.

    A language's references are the sums of its documents' measurements.
    """
    most = rows.select(F.max(F.size("_seen")).alias("k")).first()[0] or 0
    sums = rows.where("_lang IS NOT NULL").groupBy("_lang").agg(
        F.sum("n_words").alias("n"), F.sum("_chars").alias("chars"), F.array(*(F.sum(F.col("_kinds")[k]) for k in range(len(CLASSES)))).alias("kinds"), F.array(*(F.sum(F.get("_seen", F.lit(k))) for k in range(most))).alias("seen")
    )
    # a share of all others comes last
    rest = lambda a: f"concat({a}, array(greatest(0D, 1D - aggregate({a}, 0D, (x, y) -> x + y))))"
    shares = lambda a, n: F.expr(f"transform(filter({a}, x -> x IS NOT NULL), x -> x / greatest({n}, 1))")
    sums = sums.where("n > 0").select("_lang", shares("seen", "n").alias("q"), shares("kinds", "chars").alias("classes"))
    sums = cut(sums.select("_lang", F.expr(rest("q")).alias("q"), F.expr(rest("classes")).alias("classes")))
    d = rows.join(_small(sums, sums), "_lang", "left").withColumn("_seen", shares("_seen", "n_words")).withColumn("_kinds", shares("_kinds", "_chars"))
    d = d.withColumn("_p", F.expr(rest("_seen"))).withColumn("_c", F.expr(rest("_kinds")))
    has = F.col("classes").isNotNull() & (F.col("n_words") > 0)
    d = d.withColumn("word_distance", F.when(has, _distance("_p", "q"))).withColumn("class_distance", F.when(has, _distance("_c", "classes")))
    chance = F.sqrt(F.size("_seen") / (8 * math.log(2) * F.greatest(F.col("n_words"), F.lit(1))))
    odd = (F.col("n_words") >= GUARD_WORDS) & ((F.col("word_distance") > word_limit + chance) | (F.col("class_distance") > class_limit))
    d = d.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
    return d.drop("_lang", "q", "classes", "_seen", "_kinds", "_chars", "_p", "_c")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, counts, base_failed, kept, word_distance, class_distance)``, one row per input row.

    Null or empty texts have no words and fail the base rule; a null language has no reference, so only the
    base rules judge its documents; very long texts are taken whole; repeated rows and null ids are kept; an
    empty table gives an empty result. Columns other than the three named are not read, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # measured once: what is stored is a few hundred bytes a document
    return judge(stored(measured(slim, common_words(slim)).drop("text", "lang")))
