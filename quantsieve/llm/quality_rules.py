r"""Quality rules: counting rules, and divergence from language references.

``quality_features`` counts, for each document, words, symbols, repeated lines and repeated 3-word windows,
and two histograms: of character classes, and of common words of its language. ``language_references``
sums the histograms of all documents by language. ``quality_rules`` compares a document's histograms to
its language's by Jensen-Shannon distance (base 2, from 0 to 1) and rejects what stands too far off; no
document of fewer than ``min_words`` words is judged by distance.

A fixed ``max_word_distance`` of 0.5 is hardly ever exceeded: where a sixth of a language's words are common, a
text without any stands 0.3 off. ``max_word_share`` sets the limit by language instead, as a share of the distance of
such a text, and matches common words in lower case and without the punctuation around them.

The common words are fixed lists of four languages, or, by ``common``, those that most documents of a language hold
(``common_words``), so that any language is measured against words of its own. ``min_reference_docs`` leaves documents
that fail the base rule out of the references, and languages with fewer others than that without one: their documents
are judged by the base rule alone, as a few documents would only be compared to themselves.

Defined results: a null text counts as empty, and fails the base rule (under 50 words); rows of a null or
unlisted language are compared to their own kind like any other, over the common words of all listed
languages; repeated rows are judged each; an empty table gives an empty table. Columns added replace
those of the same name; names that begin with ``_qs_`` are reserved.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantsieve.llm._shared import SPACE, small, table, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CHAR_CLASSES = ("lower", "upper", "digit", "point", "symbol", "other")
SYMBOLS = "#*$%&|<>"
#: Stripped from both ends of a word before it is matched with max_word_share.
PUNCTUATION = string.punctuation + "«»„“”‚‘’…¿¡–—"
WINDOW = 3
#: Parts that a language's vocabulary is dealt to before its commonest words are chosen.
VOCABULARY_PARTS = 64
# The commonest function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for on with was".split(),
    "de": "der die und in den von zu das mit für ist ein".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y a los se del las un".split(),
}
#: The parameters of the query and of the pipeline.
PRODUCTION = {"max_word_share": 0.75, "common": 16, "min_reference_docs": 20}
ALL_COMMON = sorted({w for ws in COMMON_WORDS.values() for w in ws})


def _without(c: str, chars: str) -> Column:
    return F.regexp_replace(c, f"[{chars}]+", "")


def _common_list(lang: Column) -> Column:
    chosen = F.array(*map(F.lit, ALL_COMMON))
    for code, ws in COMMON_WORDS.items():
        chosen = F.when(lang == code, F.array(*map(F.lit, ws))).otherwise(chosen)
    return chosen


def _folded_word(w: Column) -> Column:
    return F.trim(F.lower(w), F.lit(PUNCTUATION))


def _folded_pattern(chosen: Column) -> Column:
    """A regex that finds, in a lower-cased text with white space at both ends, the words that _folded_word makes one of chosen (group 1); chosen must be folded."""
    marks = "[" + "".join("\\" + c if c.isascii() else c for c in PUNCTUATION) + "]*+"
    quoted = F.transform(chosen, lambda w: F.regexp_replace(w, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"\\$0"))
    return F.concat(F.lit(f"{SPACE}{marks}("), F.array_join(quoted, "|"), F.lit(f"){marks}(?={SPACE})"))


def common_words(docs: DataFrame, common: int, min_words: int = 50, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language: _qs_in, and _qs_list, the ``common`` folded words that most of its documents hold, commonest first, ties in the order of the words.

    Documents of at least min_words words count, each once for every way it writes a word, so that no document's repeats weigh.
    Counts are combined before the shuffle and words folded after it; a language's vocabulary is cut to its best in parts by
    hash first, so that no task holds a whole vocabulary.
    """
    ws = docs.select(F.col(lang).alias("_qs_in"), words(F.coalesce(F.col(text), F.lit(""))).alias("ws")).where(F.size("ws") >= min_words)
    written = ws.select("_qs_in", F.explode(F.array_distinct("ws")).alias("w")).groupBy("_qs_in", "w").agg(F.count(F.lit(1)).alias("n"))
    counts = written.groupBy("_qs_in", _folded_word(F.col("w")).alias("w")).agg(F.sum("n").alias("n"))
    # By n as well: a condition on w alone is moved below both counts, which folds every word of every document there.
    counts = counts.where("if(w = '', 0, n) > 0")

    def best(df: DataFrame, *by: str | Column) -> DataFrame:
        return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "w"))).where(F.col("r") <= common)

    chosen = best(best(counts, "_qs_in", F.pmod(F.xxhash64("w"), F.lit(VOCABULARY_PARTS))), "_qs_in")
    return chosen.groupBy("_qs_in").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("_qs_list"))


def quality_features(docs: DataFrame, *, text: str = "text", lang: str = "lang", fold: bool = False, keep: Sequence[str] | None = None, lists: DataFrame | None = None) -> DataFrame:
    """docs with the counts (long), _qs_lang, and the histograms _qs_chars (by CHAR_CLASSES) and _qs_common (other words, then each common word), both array<long>.

    fold: common words also count in upper case and next to punctuation. keep: the columns of docs to return, all if None.
    lists: common words by language, as common_words gives them, in place of the fixed ones; a language without any has no histogram but of other words.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    whole = F.coalesce(F.col(text), F.lit(""))
    ws, n = F.col("_qs_words"), F.size("_qs_words")
    df = docs.select(*kept, F.col(lang).alias("_qs_lang"), whole.alias("_qs_text"), words(whole).alias("_qs_words"))
    none, sought, pattern = F.array().cast("array<string>"), _common_list(F.col("_qs_lang")), _folded_pattern(F.array(*map(F.lit, ALL_COMMON)))
    if lists is not None:
        patterns = lists.withColumn("_qs_pattern", F.when(F.size("_qs_list") > 0, _folded_pattern(F.col("_qs_list"))))
        df = df.join(small(patterns), F.col("_qs_lang").eqNullSafe(F.col("_qs_in")), "left")
        sought, pattern = F.coalesce("_qs_list", none), F.col("_qs_pattern")
    if fold:
        # One regex finds the common words in the whole text: to fold each word and look it up, in lambdas, is several times the work.
        found = F.coalesce(F.regexp_extract_all(F.concat(F.lit(" "), F.lower("_qs_text"), F.lit(" ")), pattern, F.lit(1)), none)
    else:
        found = F.filter(ws, lambda w: w.isin(ALL_COMMON) if lists is None else F.array_contains(sought, w))
    hashes = F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, WINDOW)]))
    df = df.withColumns(
        {
            "_qs_all": F.array_join(ws, ""),
            "_qs_lines": F.filter(F.split("_qs_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            "_qs_hashes": F.slice(hashes, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))),
            "_qs_found": found,
        }
    )
    # Equal windows stand together once sorted; texts that repeat none skip the sort.
    repeats = F.size(F.array_distinct("_qs_hashes")) < F.size("_qs_hashes")
    placed = F.sort_array(F.transform("_qs_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumns({"_qs_no_lower": _without("_qs_all", r"\p{Ll}"), "_qs_placed": F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))})

    def equal(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("_qs_placed", i)["h"] == x["h"], F.lit(False))

    again = F.transform(F.filter("_qs_placed", lambda x, i: F.when(i > 0, equal(x, i - 1)).otherwise(F.lit(False)) | equal(x, i + 1)), lambda x: x["i"])
    df = df.withColumns({"_qs_no_upper": _without("_qs_no_lower", r"\p{Lu}"), "_qs_again": again})
    df = df.withColumn("_qs_no_digit", _without("_qs_no_upper", "0-9"))
    df = df.withColumn("_qs_no_point", _without("_qs_no_digit", r".,;:!?'\"()\-"))
    df = df.withColumn("_qs_rest", _without("_qs_no_point", SYMBOLS))
    left = [F.length(c).cast("long") for c in ("_qs_all", "_qs_no_lower", "_qs_no_upper", "_qs_no_digit", "_qs_no_point", "_qs_rest")]
    # A column of its own, as both the sum and the histogram take it.
    df = df.withColumn("_qs_counts", F.transform(sought, lambda w: (F.size("_qs_found") - F.size(F.array_remove("_qs_found", w))).cast("long")))
    return df.select(
        *kept,
        "_qs_lang",
        n.cast("long").alias("n_words"),
        left[0].alias("word_chars"),
        (left[4] - left[5]).alias("n_symbols"),
        (F.size("_qs_lines") - F.size(F.array_distinct("_qs_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("_qs_again", lambda i: F.array(*[i + j for j in range(WINDOW)]))))).cast("long").alias("n_repeat_words"),
        F.array(*[a - b for a, b in zip(left, left[1:])], left[5]).alias("_qs_chars"),
        F.concat(F.array((n - F.aggregate("_qs_counts", F.lit(0).cast("long"), lambda s, x: s + x)).cast("long")), F.col("_qs_counts")).alias("_qs_common"),
    )


def language_references(features: DataFrame, entries: int = len(ALL_COMMON), min_docs: int = 0) -> DataFrame:
    """One row per language of at least min_docs rows: _qs_of, and _qs_ref_chars and _qs_ref_common (entries common words), the summed histograms of its rows."""

    def total(c: str, n: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)) for i in range(n)])

    sums = features.groupBy(F.col("_qs_lang").alias("_qs_of")).agg(total("_qs_chars", len(CHAR_CLASSES)).alias("_qs_ref_chars"), total("_qs_common", entries + 1).alias("_qs_ref_common"), F.count(F.lit(1)).alias("_qs_docs"))
    return sums.where(F.col("_qs_docs") >= min_docs).drop("_qs_docs")


def shares(h: Column) -> Column:
    """A histogram's entries as shares of their sum; nulls where that is zero."""
    total = F.nullif(F.aggregate(h, F.lit(0).cast("double"), lambda s, y: s + y), F.lit(0.0))
    # The array of one holds the sum, so that it is taken once and not for each entry.
    return F.get(F.transform(F.array(total), lambda t: F.transform(h, lambda x: x / t)), F.lit(0))


def shares_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares; a shorter one is filled up with zeros; null where one has none above zero."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(x: Column, y: Column) -> Column:
        x, y = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
        return (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2

    distance = F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, both), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))
    return F.when(F.exists(p, lambda x: x > 0) & F.exists(q, lambda x: x > 0), distance)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null where a sum is zero."""
    return shares_distance(shares(p), shares(q))


def quality_rules(docs: DataFrame, max_char_distance: float = 0.3, max_word_distance: float = 0.5, min_words: int = 50, max_repeated_percent: int = 50, *, max_word_share: float | None = None, common: int | None = None, min_reference_docs: int | None = None, text: str = "text", lang: str = "lang", keep: Sequence[str] | None = None) -> DataFrame:
    """docs with the counts of quality_features, char_distance and word_distance (null under min_words words), base_failed and kept.

    keep names the columns of docs to return (all if None). Counts and histograms are made in one pass over the texts and
    written; the references are sums over that table, one row per language, broadcast where few and joined by shuffle
    else. Documents are never shuffled for the former. With max_word_share the limit of word_distance is that share of the
    distance of a text without common words from the language's reference, and max_word_distance is not used. common takes
    one more pass over the texts, which shuffles counts by word. Documents of a language without a reference have null distances.
    """
    added = ("char_distance", "word_distance", "base_failed", "kept")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    lists = None if common is None else table(common_words(docs, common, min_words, text=text, lang=lang), "common-words")
    fold = max_word_share is not None or lists is not None
    features = table(quality_features(docs, text=text, lang=lang, fold=fold, keep=kept, lists=lists), "quality-features")
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))
    measured = features if min_reference_docs is None else features.where(~base_failed)
    limit = F.lit(max_word_distance) if max_word_share is None else max_word_share * jensen_shannon(F.array(F.lit(1).cast("long")), F.col("_qs_ref_common"))
    refs = language_references(measured, len(ALL_COMMON) if common is None else common, min_reference_docs or 0).withColumn("_qs_limit", limit.cast("double"))
    refs = small(table(refs.withColumns({c: shares(F.col(c)) for c in ("_qs_ref_chars", "_qs_ref_common")}), "references"))
    joined = features.join(refs, F.col("_qs_lang").eqNullSafe(F.col("_qs_of")), "left")
    joined = joined.withColumns({"_qs_chars": shares(F.col("_qs_chars")), "_qs_common": shares(F.col("_qs_common"))})
    judged = F.col("n_words") >= min_words
    joined = joined.select(
        *[c for c in features.columns if c in COUNTS or c in kept],
        F.when(judged, shares_distance(F.col("_qs_chars"), F.col("_qs_ref_chars"))).alias("char_distance"),
        F.when(judged, shares_distance(F.col("_qs_common"), F.col("_qs_ref_common"))).alias("word_distance"),
        base_failed.alias("base_failed"),
        "_qs_limit",
    )
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > max_char_distance) | F.coalesce(F.col("word_distance") > F.col("_qs_limit"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~far).drop("_qs_limit")


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents that quality_rules keeps, with the columns of docs."""
    whole = docs.select(*docs.columns, F.struct(*docs.columns).alias("_qs_doc"))
    return quality_rules(whole, keep=["_qs_doc"], **options).where("kept").select("_qs_doc.*")
