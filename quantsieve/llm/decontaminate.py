r"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names (a capital with a lower-case letter after it, not at the
beginning of a sentence) turn into typed placeholders, the rest into lower case without punctuation. Windows of
template tokens are hashed and joined to those of the benchmark, so a question that was given other numbers or names
still matches. For each (document, item) the windows found are counted, and the placeholders' values are compared: an
item's value must stand for one value in the document throughout (or for itself). Pairs with enough windows and
consistent slots are contaminated. Words all in capitals are no names.

Beside these stand plain windows, of the lower-cased words themselves: an item copied word for word is found
whatever it is made of and however it is capitalised. A pair is contaminated too if enough of its plain
windows are found.

Documents are first searched for anchors: from each window of the benchmark that run of four tokens (the whole
window if shorter) that holds the fewest placeholders. What holds none of them holds no window; the others are
read again and compared window by window.

Defined results: null or empty texts match nothing; items of fewer than ``min_words`` words are searched for
only with ``short_items``, whole and by plain words; longer ones, if shorter than a window, are searched whole; windows of which
more than half is placeholders are searched for by plain words only; rows of a null document or item id are not reported; rows that repeat a document id count as
one document; an empty table gives an empty table. Other columns are ignored; a U+0003 at the beginning of a word makes it a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantsieve.llm._shared import KEY_ROWS, small, table

# Words that name a unit.
UNITS = "mm cm m km kg g mg lb lbs oz ml l inch inches foot feet yard yards mile miles meter meters metre metres gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros pound pounds degree degrees".split()
NUMBER, UNIT, NAME = "\x02n", "\x02u", "\x02p"
#: Tokens in an anchor.
ANCHOR = 4
_MARK = "\x03"
#: What stands before a name: spaces after a word that doesn't end a sentence, and opening punctuation.
_BEFORE_NAME = r"[ \t](?<=[^\s.!?:][ \t])[ \t]*+[^\p{L}\p{N}\s%]*+(?=[\p{Lu}\p{Lt}]\p{Ll})"
_PUNCTUATION = r"[^\p{L}\p{N}\s\x03%]+"


def marked_words(text: Column) -> Column:
    """array<string>: the lower-cased words of a text without punctuation, names behind a mark."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _BEFORE_NAME, f"$0{_MARK}")
    plain = F.lower(F.regexp_replace(marked, _PUNCTUATION, ""))
    for space in "\t\n\x0b\x0c\r":  # splitting at one plain character is much cheaper than at a pattern
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def _token(w: Column) -> Column:
    # After a mark (below any letter, digit or %), names; from "0" to below ":", numbers.
    return F.when(w < "\x04", NAME).when((w >= "0") & (w < ":"), NUMBER).when(w.isin(UNITS), UNIT).otherwise(w)


def _value(w: Column) -> Column:
    return F.when(w < "\x04", F.substr(w, F.lit(2))).otherwise(w)


def template(text: Column) -> Column:
    """array<struct<t,v>>: template token and the lower-cased word it stands for, of each word of a text."""
    return F.transform(marked_words(text), lambda w: F.struct(_token(w).alias("t"), _value(w).alias("v")))


def with_runs(df: DataFrame, hashes: str) -> DataFrame:
    """df with <hashes>1 to <hashes>4, each array<long>: the hash of the run of so many tokens from each place on, of the array of token hashes.

    Each is a column of its own, made once; the last places, where a run is cut short, mean nothing.
    """

    def joined(a: str, b: str, by: int) -> Column:
        return F.zip_with(a, F.slice(b, by + 1, F.greatest(F.size(b) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    one, two, three, four = (f"{hashes}{n}" for n in range(1, ANCHOR + 1))
    df = df.withColumnRenamed(hashes, one)
    df = df.withColumn(two, joined(one, one, 1))
    return df.withColumns({three: joined(two, one, 2), four: joined(two, two, 2)})


WINDOWS = "array<struct<of:string,width:int,pos:int,hash:bigint>>"


def windows(hashes: str, of: str, width: Column | int) -> Column:
    """WINDOWS: those of ``width`` tokens, from the column of token hashes."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(hashes) - width
    found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.lit(of).alias("of"), width.alias("width"), i.alias("pos"), F.xxhash64(F.slice(hashes, i + 1, width)).alias("hash")))
    return F.when(last >= 0, found).otherwise(F.array().cast(WINDOWS))


def hashed(tokens: str, of: str) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x[of]))


def item_windows(benchmark: DataFrame, of: str, width: int, min_words: int, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, of, width, hash, item_tokens and item_values of the windows to search for, each hash once for an item (its first place).

    An item shorter than a window is one window. Windows of template tokens (``of`` is "t") of which more than half is placeholders are left out.
    """
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), template(F.col(text)).alias("tokens")).where(F.size("tokens") >= max(1, min_words))
    items = items.withColumn("hashes", hashed("tokens", of))
    at = items.select("item_id", "tokens", F.explode(windows("hashes", of, F.least(F.size("tokens"), F.lit(width)))).alias("w"))
    at = at.select("item_id", "w.*", F.slice("tokens", F.col("w.pos") + 1, F.col("w.width")).alias("window"))
    at = at.select("item_id", "width", "pos", "hash", F.transform("window", lambda x: x[of]).alias("item_tokens"), F.transform("window", lambda x: x["v"]).alias("item_values"))
    told = F.size(F.filter("item_tokens", lambda t: ~t.startswith("\x02")))
    return at.where(2 * told >= F.col("width")).groupBy("item_id", F.lit(of).alias("of"), "width", "hash").agg(*[F.min_by(c, "pos").alias(c) for c in ("item_tokens", "item_values")])


def anchors(wanted: DataFrame) -> DataFrame:
    """(run, key): for each window, the number of tokens and the hash of its anchor, each once."""
    df = with_runs(wanted.select("item_tokens", F.transform("item_tokens", lambda t: F.xxhash64(t)).alias("key")), "key")
    df = df.withColumn("places", F.transform("item_tokens", lambda t, i: F.struct((~t.startswith("\x02")).cast("int").alias("told"), i.alias("i"))))
    n, best = F.size("item_tokens"), None
    for run in range(1, ANCHOR + 1):
        told = lambda i: F.aggregate(F.slice("places", i + 1, F.lit(run)), F.lit(0), lambda s, x: s + x["told"])  # noqa: B023, E731
        ways = F.transform(F.sequence(F.lit(0), F.greatest(n - run, F.lit(0))), lambda i: F.struct(told(i).alias("told"), (-i).alias("place"), F.get(f"key{run}", i).alias("key")))  # noqa: B023
        test = n >= run if run == ANCHOR else n == run
        best = F.when(test, F.array_max(ways)) if best is None else best.when(test, F.array_max(ways))
    return df.select(F.least(n, F.lit(ANCHOR)).alias("run"), best["key"].alias("key")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_words: int = 5, min_windows: int = 6, min_share: float = 0.5, min_consistent: float = 0.5, *, short_items: bool = False, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, n_windows (of the item, found), item_windows, n_slots, slot_consistency, verbatim.

    A pair counts if at least ``min_windows`` or ``min_share`` of the item's windows are found and at least
    ``min_consistent`` of its slots are consistent, or if as many of its plain windows are found: then, unless
    the former holds as well, the row counts plain windows, has no slots and is verbatim. verbatim: every slot stands for itself.
    """
    names = {"item_id": item_id, "text": item_text}
    wanted = table(item_windows(benchmark, "t", width, min_words, **names).union(item_windows(benchmark, "v", width, 1 if short_items else min_words, **names)), "windows")
    widths = sorted(r[0] for r in wanted.select("width").distinct().collect())  # width values at most
    totals = table(wanted.groupBy("of", "item_id").agg(F.count(F.lit(1)).alias("item_windows")), "items")
    keys = table(anchors(wanted), "anchors")
    runs = sorted(r[0] for r in keys.select("run").distinct().collect())  # ANCHOR values at most
    keys = small(keys.select("key").distinct(), KEY_ROWS)

    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = named.select("doc_id", marked_words(F.col("text")).alias("words"))
    found = found.select("doc_id", F.transform("words", lambda w: F.xxhash64(_token(w))).alias("t"), F.transform("words", lambda w: F.xxhash64(_value(w))).alias("v"))
    found = with_runs(with_runs(found, "t"), "v")
    found = found.select("doc_id", F.explode(F.concat(F.array().cast("array<long>"), *[F.col(f"{of}{run}") for of in ("t", "v") for run in runs])).alias("key"))
    hit = small(table(found.join(keys, "key", "left_semi").select("doc_id").distinct(), "hits"), KEY_ROWS)
    # The documents with any anchor are read again, now with the values that their placeholders stand for.
    again = named.join(hit, "doc_id", "left_semi").select("doc_id", template(F.col("text")).alias("tokens"))
    again = again.withColumns({of: hashed("tokens", of) for of in ("t", "v")})
    at = again.select("doc_id", "tokens", F.explode(F.concat(F.array().cast(WINDOWS), *[windows(of, of, w) for of in ("t", "v") for w in widths])).alias("w"))
    at = at.select("doc_id", "w.*", F.slice("tokens", F.col("w.pos") + 1, F.col("w.width")).alias("window")).join(small(wanted.drop("item_tokens")), ["of", "width", "hash"])
    found = table(at.select("of", "doc_id", "item_id", "hash", "item_values", F.transform("window", lambda x: x["v"]).alias("values"), F.transform("window", lambda x: x["t"]).alias("types")), "found")
    counts = found.groupBy("of", "doc_id", "item_id").agg(F.countDistinct("hash").alias("n_windows")).join(small(totals), ["of", "item_id"])
    parts = found.where("of = 't'")
    slot = F.explode_outer(F.filter(F.arrays_zip("types", "item_values", "values"), lambda x: x["types"].startswith("\x02")))
    slots = parts.select("doc_id", "item_id", slot.alias("s")).where("s is not null").groupBy("doc_id", "item_id", F.col("s.item_values").alias("item_value"))
    slots = slots.agg(F.count_distinct("s.values").alias("n"), F.max((F.col("s.values") == F.col("s.item_values")).cast("int")).alias("same"))
    slots = slots.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_slots"), F.avg(((F.col("n") == 1) | (F.col("same") == 1)).cast("double")).alias("slot_consistency"), F.min((F.col("same") == 1) & (F.col("n") == 1)).alias("verbatim"))
    found = counts.where("of = 't'").join(slots, ["doc_id", "item_id"], "left")
    enough = (F.col("n_windows") >= min_windows) | (F.col("n_windows") >= min_share * F.col("item_windows"))
    consistent = F.coalesce(F.col("slot_consistency"), F.lit(1.0))
    found = found.where(enough & (consistent >= min_consistent)).select("doc_id", "item_id", "n_windows", "item_windows", F.coalesce("n_slots", F.lit(0).cast("long")).alias("n_slots"), consistent.alias("slot_consistency"), F.coalesce("verbatim", F.lit(True)).alias("verbatim"))
    copied = counts.where("of = 'v'").where(enough).select("doc_id", "item_id", "n_windows", "item_windows", F.lit(0).cast("long").alias("n_slots"), F.lit(1.0).alias("slot_consistency"), F.lit(True).alias("verbatim"))
    # A pair found both ways keeps the row of the template windows.
    columns = found.columns
    both = found.withColumn("way", F.lit(0)).union(copied.withColumn("way", F.lit(1))).groupBy("doc_id", "item_id")
    return both.agg(F.min(F.struct("way", *columns[2:])).alias("x")).select("doc_id", "item_id", *[f"x.{c}" for c in columns[2:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    doc_id = options.get("doc_id", "doc_id")
    bad = small(table(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_qs_bad")).distinct(), "contaminated"))
    return docs.join(bad, F.col(doc_id) == F.col("_qs_bad"), "left_anti")
