from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantsieve.llm import line_dedup, quality_rules
from tests.llm.conftest import LONG, ODD

LINE = "this line of over forty code points repeats across documents"


def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda x: re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holds = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holds.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stays = [x for x in lines if i is None or len(holds.get(key(x), ())) < min_docs or max(holds[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(docs_of):
    texts = [f"\t {LINE.upper()} \r\nown line {i}\n{LINE}\n" + (f"{LINE} x\n" if i < 4 else "") for i in range(7)] + ODD + [LINE + "é" * 3] * 5 + [" " + LINE] * 5
    ids = [*range(len(texts) - 2), 3, None]
    docs = docs_of(texts, ids, pos=1, key="k", n_lines="old")
    got = line_dedup.line_dedup(docs)
    assert got.columns == docs.columns + ["n_dropped"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == brute_lines(list(zip(ids, texts, strict=True)))


def test_line_dedup_empty(docs_of):
    assert line_dedup.line_dedup(docs_of([])).count() == 0


def brute_counts(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(wins)
    covered = {i + j for i, w in enumerate(wins) if n[w] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(docs_of):
    texts = [*ODD, "a b c a b c a b", "x x x x x", "l 1\nl 1\n \nl 2\n l 1", "#tag $5 *|<>&% é É", "a b c d a b c\n" * 20]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs_of(texts, words=1, kept="old", n_words="old")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_counts(t)
        assert tuple(r[c] for c in quality_rules.COUNTS) == want, t and t[:30]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
        assert (r["char_distance"] is None) == (want[0] < 50)


def test_jensen_shannon(spark):
    df = spark.sql("select array(1L, 3L) as p, array(2L, 2L, 4L) as q, array(0L) as z")
    r = df.select(quality_rules.jensen_shannon(F.col("p"), F.col("q")).alias("d"), quality_rules.jensen_shannon(F.col("p"), F.col("p")).alias("same"), quality_rules.jensen_shannon(F.col("p"), F.col("z")).alias("none")).first()
    p, q = [0.25, 0.75, 0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert r["d"] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and r["same"] == pytest.approx(0) and r["none"] is None


def test_rules_reject_what_diverges(docs_of):
    good = ["the cat of the house and a dog in the yard is here to eat for now with what was on that plate number " + " ".join(f"unlike{chr(97 + i % 26)}{chr(97 + k % 26)}" for k in range(40)) for i in range(30)]
    bad = " ".join(f"%%%{i}###***" for i in range(80))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs_of([*good, bad])).collect()}
    assert all(got[i] for i in range(30)) and not got[30]


def test_rules_null_language_and_empty(docs_of):
    docs = docs_of([LONG, LONG], lang=None).withColumn("lang", F.lit(None).cast("string"))
    assert quality_rules.quality_rules(docs).count() == 2
    assert quality_rules.quality_rules(docs_of([])).count() == 0
    assert "Python" not in quality_rules.quality_rules(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_rules_keep_columns_and_null_ids(docs_of):
    """keep names the columns returned; rows without an id, and repeated rows, are judged like any other."""
    docs = docs_of([LONG, LONG, LONG, None], ids=[None, 1, 1, None], _qs_of="x", kept="old")
    got = quality_rules.quality_rules(docs, max_word_share=0.7, keep=["doc_id"])
    assert got.columns == ["doc_id", "n_words", *quality_rules.COUNTS[1:], "char_distance", "word_distance", "base_failed", "kept"]
    assert sorted(((r["doc_id"], r["n_words"]) for r in got.collect()), key=str) == [(1, 30_000), (1, 30_000), (None, 0), (None, 30_000)]
    assert quality_rules.quality_filter(docs.drop("_qs_of")).columns == docs.drop("_qs_of").columns


def test_lines_of_one_id_with_different_texts(docs_of):
    """Places are told apart by text: a line dropped from one text leaves another text of that id its own lines."""
    texts = [f"{LINE}\nfirst", f"second\n{LINE}", f"{LINE}\nfirst", *[LINE] * 5]
    got = line_dedup.line_dedup(docs_of(texts, ids=[0, 0, 0, 1, 2, 3, 4, 5])).where("doc_id = 0")
    assert sorted((r["text"], r["n_dropped"]) for r in got.collect()) == [("first", 1), ("first", 1), ("second", 1)]


def test_word_share_rejects_texts_without_common_words(spark, docs_of):
    """Words of the same letters throughout, so that only the common words tell the menu from the prose."""
    pipeline = pytest.importorskip("corpus_pipeline", reason="the pipeline has been removed")
    rest = lambda i, n: [f"thn{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}ou" for k in range(n)]
    common = "the of and to in a is that".split()
    prose = [" ".join(w if k % 4 else common[k // 4 % 8] for k, w in enumerate(rest(i, 80))) for i in range(20)]
    folded = " ".join(w if k % 4 else f"{w.title()}," for k, w in enumerate(prose[0].split()))
    docs = docs_of([*prose, folded, " ".join(rest(3, 80)), " ".join(rest(3, 30))])
    got = {r["doc_id"] for r in pipeline.quality_stage(spark, docs, "").collect()}
    assert got - {20} == set(range(20))
    r = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, max_word_share=0.7).collect()}
    assert r[20]["word_distance"] < 0.1 < r[21]["word_distance"] < 0.5 and r[22]["word_distance"] is None
    assert "_qs_limit" not in quality_rules.quality_rules(docs).columns


def brute_common(docs, common, min_words=50):
    held = {}
    for lang, t in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(ws) >= min_words:
            held.setdefault(lang, Counter()).update(w.lower().strip(quality_rules.PUNCTUATION) for w in set(ws))
    return {lang: sorted((w for w in n if w), key=lambda w: (-n[w], w.encode()))[:common] for lang, n in held.items()}


def test_common_words_against_brute_force(spark):
    """Every language has words of its own, a null one too; short texts don't count; ties go by the words; repeats within a text don't weigh."""
    stems = [f"{a}{b}" for a in "bdfgkl" for b in "aeiou"]
    docs = []
    for i in range(60):
        lang = ["xx", "yy", None][i % 3]
        ws = [stems[(k * (i % 7 + 1)) % (9 + i % 20)] for k in range(45 + i % 11)]
        docs.append((lang, " ".join(w.title() + "," if k % 5 == i % 5 else w for k, w in enumerate(ws)) + " -- «É» É"))
    docs += [("xx", "zz " * 5000), ("short", "one two"), ("yy", None), ("yy", "")]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(7)
    for common in (3, 16, 500):
        got = {r["_qs_in"]: r["_qs_list"] for r in quality_rules.common_words(df, common).collect()}
        assert got == brute_common(docs, common)
    assert quality_rules.common_words(df.limit(0), 5).count() == 0


def test_counts_of_derived_words_against_brute_force(spark, docs_of):
    """Histograms of the words found: one entry a word, in the order of the list, folded; others first."""
    texts = ["The cat, THE dog. the «cat» " * 20, "cat the bird " * 30, *ODD]
    docs = docs_of(texts).withColumn("lang", F.expr("if(doc_id = 1, 'zz', lang)"))
    lists = spark.createDataFrame([("en", ["the", "cat", "eel"])], "_qs_in string, _qs_list array<string>")
    got = {r["doc_id"]: r["_qs_common"] for r in quality_rules.quality_features(docs, fold=True, keep=["doc_id"], lists=lists).collect()}
    assert got[0] == [20, 60, 40, 0] and got[1] == [90]
    assert all(got[i + 2] == [len((t or "").split()), 0, 0, 0] for i, t in enumerate(ODD))


def prose(i, common, n=80):
    """A text of its own words of one shape; every fourth is a common one, where any is given."""
    own = [f"thn{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + (k // 26 + i // 26) % 26)}ou" for k in range(n)]
    return " ".join(common[k // 4 % len(common)] if common and k % 4 == 0 else w for k, w in enumerate(own))


def test_derived_words_of_an_unlisted_language(docs_of):
    """A text without its language's common words goes, though no list of that language is written anywhere; a language of few documents is judged by the base rule alone."""
    own = "ja on ei se että oli hän mutta niin kun".split()
    docs = docs_of([*[prose(i, own) for i in range(40)], prose(41, None), prose(42, None)]).withColumn("lang", F.expr("if(doc_id = 41, 'few', 'fi')"))
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, **quality_rules.PRODUCTION).collect()}
    assert all(rows[i]["kept"] for i in range(40))
    assert not rows[40]["kept"] and not rows[40]["base_failed"]
    assert rows[41]["kept"] and rows[41]["word_distance"] is None and rows[41]["char_distance"] is None


def test_references_leave_rejected_documents_out(docs_of):
    """Junk that fails the base rule moves no reference: distances of the rest are those without it."""
    good = [prose(i, "the of and to in a is that".split()) for i in range(30)]
    junk = ["%%% ### " * 100 for _ in range(60)]
    options = quality_rules.PRODUCTION | {"common": 8}
    with_junk, without = ({r["doc_id"]: r["char_distance"] for r in quality_rules.quality_rules(docs_of(t), **options).where("doc_id < 30").collect()} for t in ([*good, *junk], good))
    assert with_junk == pytest.approx(without) and max(without.values()) < 0.3
    default = quality_rules.quality_rules(docs_of([*good, *junk]), max_word_share=0.75).where("doc_id < 30").agg(F.min("char_distance")).first()[0]
    assert default > max(without.values())


def test_production_rules_on_odd_rows(docs_of):
    docs = docs_of([*ODD, LONG], ids=[None, 1, 1, 2, 3, 4, 4, None], w="x", r=1, n=2, ws="y", lang=None, common="z").withColumn("lang", F.lit(None).cast("string"))
    got = quality_rules.quality_rules(docs, **quality_rules.PRODUCTION)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == 8
    assert "Python" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert quality_rules.quality_rules(docs_of([]), **quality_rules.PRODUCTION).count() == 0


def test_words_are_folded_after_they_are_counted(docs_of):
    """Neither pass folds every word of every text: the vocabulary folds what the first count leaves, the features fold whole texts."""
    docs = docs_of([LONG])
    plan = quality_rules.common_words(docs, 5)._jdf.queryExecution().optimizedPlan().toString()
    counted = plan[plan.rindex("Aggregate") :]
    assert "explode" in counted and "trim" not in counted.lower()[counted.index("\n") :]
    for lists in (None, quality_rules.common_words(docs, 5)):
        features = quality_rules.quality_features(docs, fold=True, keep=["doc_id"], lists=lists)
        top = features._jdf.queryExecution().optimizedPlan().toString().lower().partition("- join ")[0]
        assert "lower(" in top and "lower(lambda" not in top and "lower(namedlambda" not in top


def test_found_words_are_those_folded_one_by_one(spark, docs_of):
    """Signs of patterns inside words, marks at their ends, words that begin others, other scripts, marks alone and long runs of them."""
    listed = ["a", "a-b", "a.b", "a|b", "x\\e", "don't", "οδος", "i̇", "été", "𝒳y", "c[d", "中"]
    texts = ["A a-b, (a.b) aab a|b X\\E \"Don't\" -- don't don''t ΟΔΟΣ, οδοσ İ; «Été» …été… 𝒳y! c[d] (c[d( 中 中文 a\x0ba\x0ca", "-" * 50_000 + "a " + "a" + "-" * 50_000, "a -- a-- --a a--b", "x a a", *ODD, "a " * 3000]
    lists = spark.createDataFrame([("en", listed)], "_qs_in string, _qs_list array<string>")
    docs = docs_of(texts)
    folded = F.transform(quality_rules.words(F.coalesce("text", F.lit(""))), quality_rules._folded_word)
    want = {r["doc_id"]: [len(r["w"]) - sum(r["w"].count(x) for x in listed), *map(r["w"].count, listed)] for r in docs.select("doc_id", folded.alias("w")).collect()}
    got = {r["doc_id"]: r["_qs_common"] for r in quality_rules.quality_features(docs, fold=True, keep=["doc_id"], lists=lists).collect()}
    assert got == want and all(n > 0 for n in want[0][1:])
