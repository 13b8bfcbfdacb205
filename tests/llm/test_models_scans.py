from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantsieve.llm import decontaminate, license_scan, queries, site_quality, toxicity
from tests.llm.conftest import ODD

ITEM = "If a train from Lyon to Paris covers 480 km in 3 hours, how many minutes does it need to cover 100 km at the same steady speed along the way?"
SAME = "x y. If a train from Turin to Milan covers 520 km in 4 hours, how many minutes does it need to cover 130 km at the same steady speed along the way? z"
MIXED = "If a train from Turin to Milan covers 520 km in 4 hours, how many minutes does it need to cover 130 km at the same steady speed along the way?"


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "tiny item"), (3, None), (None, ITEM), (4, "five words stand in here")], "item_id long, text string").withColumn("hash", F.lit(1))


def test_decontamination(docs_of, bench):
    texts = [*ODD, ITEM, f"before. {ITEM} after", SAME, "a clean document about trains from nowhere to somewhere else", "so five words stand in here too", "tiny item"]
    docs = docs_of(texts, tokens=1, item_id=9)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(7, 1), (8, 1), (9, 1), (11, 4)}
    assert got[7, 1]["verbatim"] and not got[9, 1]["verbatim"] and got[9, 1]["slot_consistency"] == 1.0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {7, 8, 9, 11}


def test_inconsistent_slots(spark, docs_of):
    item = "Ann gave 5 apples to bob and then 5 pears to tim and then 5 plums to lea and then 5 figs to max"
    changed = "Ann gave 6 apples to bob and then 7 pears to tim and then 8 plums to lea and then 9 figs to max"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.contaminated(docs_of([changed]), bench, min_consistent=0.9).count() == 0
    assert decontaminate.contaminated(docs_of([changed.replace("7", "6").replace("8", "6").replace("9", "6")]), bench, min_consistent=0.9).count() == 1


def test_verbatim_copies_of_any_kind(spark, docs_of):
    """Items without a template window, copies in upper case, and items shorter than any window."""
    sums, names = "Compute 12 + 7 = 19 , 3 x 4 = 12 , 9 - 5 = 4 , 8 / 2 = 4", "Name Anna Berta Clara Dora Emma Frida Greta Hanna Ida Julia"
    bench = spark.createDataFrame([(1, ITEM), (2, sums), (3, names), (4, "Define osmosis briefly")], "item_id long, text string")
    shouted = SAME.replace("x y.", "so far.").upper().replace("520", "555")
    texts = [f"so. {sums} and on", f"so. {names} and on", f"so far it went. {ITEM.upper()}", shouted, "please define Osmosis, briefly.", "a clean document about osmosis", sums.replace("12", "31")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(texts), bench, short_items=True).collect()}
    assert got == {(0, 2), (1, 3), (2, 1), (3, 1), (4, 4)}
    assert {r["doc_id"] for r in decontaminate.contaminated(docs_of(texts), bench).collect()} == {0, 1, 2, 3}


def plain_template(text):
    """(token, value) of each word, written apart from the operator."""
    out, before, gap = [], "", ""
    for m in re.finditer(r"([ \t\n\x0b\x0c\r]*)([^ \t\n\x0b\x0c\r]+)", text or ""):
        gap, raw = m.groups()
        word = "".join(c for c in raw if c.isalpha() or c.isnumeric() or c == "%")
        opened = re.match(r"[\W_]*", raw.replace("%", "x"))[0]
        inner = raw[len(opened) :]
        name = len(inner) > 1 and inner[0].isupper() and inner[1].islower() and before and before[-1] not in ".!?:" and gap.strip(" \t") == ""
        if word:
            low = word.lower()
            out.append(("<name>" if name else "<number>" if "0" <= low[0] <= "9" else "<unit>" if low in decontaminate.UNITS else low, low))
        before = raw
    return out


def brute_pairs(texts, items, width=8, min_words=5, min_windows=6, min_share=0.5, min_consistent=0.5):
    def cut(tokens, n):
        return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]

    pairs = set()
    for j, item in items:
        it = plain_template(item)
        n = min(len(it), width)
        t_windows, first = {}, cut(it, n)
        for w in first:
            if sum(t.startswith("<") for t, _ in w) * 2 <= n and len(it) >= min_words:
                t_windows.setdefault(tuple(t for t, _ in w), w)
        v_windows = {tuple(v for _, v in w) for w in first}
        for i, text in texts:
            ws = cut(plain_template(text), n)
            hit = [(t_windows[k], w) for w in ws if (k := tuple(t for t, _ in w)) in t_windows]
            found = len({tuple(t for t, _ in w) for _, w in hit})
            slots = {}
            for mine, theirs in hit:
                for (t, a), (_, b) in zip(mine, theirs):
                    if t.startswith("<"):
                        slots.setdefault(a, set()).add(b)
            good = [len(b) == 1 or a in b for a, b in slots.items()]
            copied = len(v_windows & {tuple(v for _, v in w) for w in ws})
            if found and (found >= min_windows or found >= min_share * len(t_windows)) and (not good or sum(good) / len(good) >= min_consistent):
                pairs.add((i, j))
            if copied and (copied >= min_windows or copied >= min_share * len(v_windows)):
                pairs.add((i, j))
    return pairs


def test_decontamination_against_brute_force(spark, sf_dir, docs_of):
    """Over the given documents and items, and over copies of items with other numbers and names, all of which are found."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:40]
    made = [(1000 + k, f"{name} had {a} coins and gave {b} of them to a friend who then lost {a} kg of apples on the way to {place} market, how many were left") for k, (name, place, a, b) in enumerate([("Ann", "Paris", 5, 3), ("the boy", "Rome", 17, 12)])]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    changed = [(10_000 + k, f"so it goes. {t} ok?") for k, t in enumerate(x.replace("5", "61").replace("3", "22").replace("17", "8").replace("12", "4").replace("Paris", "Oslo").replace("Rome", "Bonn") for _, x in made)]
    table = spark.createDataFrame(docs + changed, "doc_id long, text string")
    bench = spark.createDataFrame(items + made, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table, bench, short_items=True).collect()}
    assert got == brute_pairs(docs + changed, items + made)
    assert {(10_000, 1000), (10_001, 1001)} <= got


def test_decontamination_of_empty_tables(spark, docs_of, bench):
    assert decontaminate.contaminated(docs_of([]), bench).count() == 0
    assert decontaminate.contaminated(docs_of([ITEM]), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of([ITEM, ITEM], [None, None]), bench).count() == 0


def test_licenses(docs_of):
    texts = [*ODD, "Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later\nsee the MIT license, mit license", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "licensed under CC BY-NC 4.0.", "the license of mit", "mit-license x MIT  LICENSE"]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(texts, labels=1)).collect()}
    assert [got[i]["labels"] for i in range(7, 13)] == ["mit", "gpl,mit", "gpl,lgpl", "cc-by-nc", "", "mit"]
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"]) == (2, 10, 12)
    assert got[12]["n_base"] == 2 and got[12]["n_words"] == 5
    for i, t in enumerate(texts):
        r = got[i]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        assert r["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
        assert all(s["end"] <= len(t) for s in r["spans"])
    assert license_scan.scan(docs_of([])).count() == 0
    assert len(license_scan.rules()) > 200


def examples(parsed):
    """Texts that a parsed regex matches: every branch, optional parts with and without, repeats once."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            ways = [chr(arg)]
        elif op == "BRANCH":
            ways = [x for p in arg[1] for x in examples(p)]
        elif op == "SUBPATTERN":
            ways = examples(arg[-1])
        elif op == "MAX_REPEAT":
            ways = [*([""] if arg[0] == 0 else []), *examples(arg[2])]
        elif op == "IN":
            ways = [next(chr(x[1]) if str(x[0]) == "LITERAL" else chr(x[1][0]) if str(x[0]) == "RANGE" else {"CATEGORY_DIGIT": "1", "CATEGORY_SPACE": " ", "CATEGORY_WORD": "a", "CATEGORY_NOT_SPACE": "a"}[str(x[1])] for x in arg)]
        else:
            assert op in ("AT", "ASSERT_NOT"), op
            ways = [""]
        out = [a + b for a in out for b in ways]
    return out


def every_rule(text):
    """The detections if all rules are tried on a text, whatever keywords it holds."""
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    start = lambda m: m.start("id") if "id" in m.re.groupindex else m.start()
    return license_scan.accepted(license_scan.Detection(start(m), m.end(), r) for r in license_scan.rules() for m in r.pattern.finditer(low))


def rule_examples():
    """(rule, a text that it matches), many for each rule."""
    inner, parse = {"name": 2, "spdx": 3, "address": 4}, re._parser.parse
    by_kind = {(r.label, r.form): r for r in license_scan.rules()}
    for family in license_scan.FAMILIES:
        for form, _, _, kind, around in license_scan.FORMS:
            if kind.startswith("only ") and kind != f"only {family[0]}":
                continue
            for name in examples(parse(family[inner[kind.split()[0] if kind in inner else "name"]])):
                for t in examples(parse(around.format(name="NAME", word="license", version="(?: 2)"))):
                    yield by_kind[family[0], form], t.replace("NAME", name)
    by_pattern = {r.pattern.pattern: r for r in license_scan.rules()}
    for label, form, _, text in license_scan.TEXTS:
        for t in examples(parse(text.replace(" ... ", " some words "))):
            yield by_pattern[license_scan._flexible(text)], t


def test_detections_are_those_of_all_rules():
    """Keywords lose nothing: on examples of every rule, wrapped ones, and 1,000 mixed texts."""
    rng, pool = random.Random(4), []
    for rule, t in rule_examples():
        assert rule.pattern.search(t), (rule.label, rule.form, t)
        if rule.form not in ("spdx", "address"):
            assert rule.pattern.search(t.replace(" ", "\n * ")), (rule.label, rule.form, t)
        pool.append(t)
    assert len(pool) > 1500 and len({id(r) for r, _ in rule_examples()}) == len(license_scan.rules())
    for t in rng.sample(pool, 700):
        assert license_scan.detect(t) == every_rule(t), t
    for _ in range(1000):
        parts = rng.choices(pool, k=rng.randint(1, 3)) + rng.choices(["Some prose.", "mit", "General", "public\n", "licence:", "spdx-"], k=4)
        rng.shuffle(parts)
        t = rng.choice([" ", "\n", "\n# "]).join(parts)
        t = t.replace(" ", rng.choice([" ", "\n", "  "])) if rng.random() < 0.5 else t.upper()
        assert license_scan.detect(t) == every_rule(t), t


def test_every_rule_has_a_keyword():
    assert all(k for r in license_scan.rules() for k in r.keywords)
    with pytest.raises(ValueError, match="empty keyword"):
        license_scan._words(("",))
    assert len(license_scan.TEXTS) >= 150


def test_wrapped_names_and_expressions():
    labels = lambda t: sorted({d.rule.label for d in license_scan.detect(t)})
    assert labels("see example.com/proprietary-license") == ["proprietary"]
    assert labels("licensed under the Mozilla\nPublic License") == ["mpl"]
    assert labels("the GNU Lesser\nGeneral Public License") == ["lgpl"]
    assert labels("License: Creative Commons Attribution-Non-Commercial 4.0") == ["cc-by-nc"]
    assert labels("SPDX-License-Identifier: (MIT OR Apache-2.0)") == ["apache", "mit"]
    assert labels("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR BSD-3-Clause") == ["bsd-3-clause", "classpath-exception", "gpl"] or labels("SPDX-License-Identifier: GPL-2.0-only OR BSD-3-Clause") == ["bsd-3-clause", "gpl"]


def test_score_takes_the_surest_detection(docs_of):
    lines = ["Licensed under the MIT License.", "some words on the ISC License"]
    more = ["MIT License", "SPDX-License-Identifier: MIT"]
    rows = license_scan.scan(docs_of(["\n".join(lines), "\n".join(lines[::-1]), "\n".join(more), "\n".join(more[::-1])])).collect()
    scores = [r["score"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert scores[0] == scores[1] and scores[2] == scores[3] > 0.99


def test_bodies_and_headers_are_found():
    for text, label in [
        ("see wtfpl.net for terms", "wtfpl"),
        ('Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software")', "mit"),
        ("Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that", "bsd"),
        ("with the Classpath exception", "classpath-exception"),
    ]:
        assert label in [d.rule.label for d in license_scan.detect(text)], text


def test_base_phrases_against_brute_force(docs_of):
    import random

    rng = random.Random(3)
    bits = ["MIT", "mit", "License", "license", "licenses", "apache", "general", "public", "Lice\u00e9nse", "x", "mit-license", "\u00a0"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "\n", ", ", "-", ""]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    rows = {r["doc_id"]: r for r in license_scan.scan(docs_of(texts)).collect()}
    some = 0
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = sorted((k, label) for phrase, label in [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")] for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split())
        some += bool(found)
        want = (len(ws), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})))
        assert tuple(rows[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want, t
    assert some > 50


def test_alternative_names_are_found():
    for text, label in [("the GNU Library General Public License", "lgpl"), ("License: Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa"), ("License: Creative Commons Attribution-NoDerivatives 4.0", "cc-by-nd"), ("License: Creative Commons Attribution 4.0", "cc-by"), ("licensed under CC Zero", "cc0"), ("see wtfpl.net", "wtfpl")]:
        assert label in [d.rule.label for d in license_scan.detect(text)], text


def test_contained_detections_are_suppressed():
    found = license_scan.detect("Licensed under the GNU Lesser General Public License, version 2.1")
    assert [(d.rule.label, d.rule.form) for d in found] == [("lgpl", "grant")]
    assert [d.rule.label for d in license_scan.detect("licensed under cc by-nc-sa 4.0: https://creativecommons.org/licenses/by-nc-sa/4.0")] == ["cc-by-nc-sa"] * 2


def toxic_corpus(n=600):
    rng = np.random.default_rng(0)
    texts, toxic = [], []
    for i in range(n):
        ws = [f"w{rng.integers(0, 400)}" for _ in range(40)]
        bad = i % 8 == 0
        if bad:
            ws[int(rng.integers(0, 40))] = ["scum", "moron"][i // 8 % 2]
        texts.append(" ".join(ws))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_learns(spark, docs_of):
    texts, toxic = toxic_corpus()
    docs = docs_of([*texts, *ODD], score=1, toxic=2)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    out = [i for i in range(len(texts)) if rows[i]["held_out"]]
    assert 100 < len(out) < 200
    assert np.mean([rows[i]["predicted"] == toxic[i] for i in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and len(rows) == len(texts) + len(ODD)
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(7), toxicity.fit(docs.repartition(3), labels)).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}


def test_toxicity_without_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(ODD)
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0}
    assert toxicity.score(docs_of([]), toxicity.fit(docs_of([]), labels)).count() == 0


def test_non_negative_risk_holds_back():
    """With positives among the unlabelled, scores of unlabelled positives still rise."""
    pos = [np.array([1, k], np.int32) for k in range(10, 60)]
    unl = [np.array([2, k % 40 + 100], np.int32) for k in range(400)] + [np.array([1, k % 40 + 200], np.int32) for k in range(50)]
    m = toxicity.train(pos, unl, 0.11, min_z=2)
    s = m.scores(unl)
    assert s[:400].max() < 0.3 < s[400:].min()


def test_site_quality(spark, docs_of):
    rng = np.random.default_rng(1)
    good = lambda: "The " + " ".join(f"word{rng.integers(0, 500)}" for _ in range(80)) + " of the house."
    bad = lambda: " ".join(f"w{rng.integers(0, 500)}###" for _ in range(80))
    texts, hosts = [], []
    for i in range(240):
        host = i % 4
        texts.append(bad() if (host == 3 and i % 5) or i % 20 == 0 else good())
        hosts.append(f"h{host}")
    docs = docs_of([*texts, *ODD]).withColumn("source", F.when(F.col("doc_id") < 240, F.concat(F.lit("h"), (F.col("doc_id") % 4).cast("string"))))
    labels = spark.createDataFrame([(i, int("###" not in t)) for i, t in enumerate(texts) if i % 2], "doc_id long, quality int")
    rows = site_quality.site_quality(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(rows) == len(texts) + len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert np.mean([by[i]["kept"] == ("###" not in t) for i, t in enumerate(texts)]) > 0.95
    assert by[3]["host_score"] < by[1]["host_score"]
    assert all(0 <= r["quality_score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert site_quality.site_quality(docs_of([]), none, F.col("source"), F.col("lang")).count() == 0
    assert site_quality.site_quality(docs_of(["a b"]), none, F.col("source"), F.col("lang")).count() == 1


@pytest.mark.parametrize("few", [20_000, 0])
def test_site_quality_against_brute_force(spark, docs_of, monkeypatch, few):
    """Posteriors and scores worked out in plain loops from the documents' own probabilities; the same with sites broadcast and dealt out."""
    monkeypatch.setattr(site_quality, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(5)
    n = 150
    texts = [" ".join(f"w{rng.integers(0, 90)}{'#' * (i % 7 == int(rng.integers(0, 3)))}" for _ in range(60)) for i in range(n)]
    ids = [*range(n - 6), 3, 3, None, None, 5, 7]
    docs = docs_of(texts, ids, host="x", path="y", p=0.5, x=1)
    site = F.when(F.length("text") % 11 > 0, F.concat(F.lit("h"), (F.length("text") % 5).cast("string")))
    sub = F.when(F.length("text") % 3 > 0, (F.length("text") % 3).cast("string"))
    labels = spark.createDataFrame([(i, int(texts[i].count("#") < 8)) for i in range(0, n - 6, 2)] + [(0, 0), (0, 1), (None, 1)], "doc_id long, quality int")
    got = site_quality.site_quality(docs, labels, site, sub).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, ids))

    def sums(key):
        out = {}
        for r in got:
            out.setdefault(key(r), []).append(r["doc_score"])
        return out

    def strength(groups, above):
        v = b = total = 0.0
        for key, ps in groups.items():
            if len(ps) > 1:
                m, mu = sum(ps) / len(ps), above(key)
                noise = (sum(p * p for p in ps) / len(ps) - m * m) / (len(ps) - 1)
                v, b, total = v + len(ps) * ((m - mu) ** 2 - noise), b + len(ps) * mu * (1 - mu), total + len(ps)
        return site_quality.STRENGTH[1] if not total or v <= 0 else min(max(b / v - 1, site_quality.STRENGTH[0]), site_quality.STRENGTH[1])

    mean = sum(r["doc_score"] for r in got) / len(got)
    hosts, paths = sums(lambda r: r["host"]), sums(lambda r: (r["host"], r["path"]))
    k_host = strength(hosts, lambda _: mean)
    above = {h: (sum(ps) + k_host * mean) / (len(ps) + k_host) for h, ps in hosts.items()}
    k_path = strength(paths, lambda key: above[key[0]])
    logit = lambda p: np.log(p / (1 - p))
    for r in got:
        ps = paths[r["host"], r["path"]]
        others = (sum(ps) - r["doc_score"] + k_path * above[r["host"]]) / (len(ps) - 1 + k_path)
        z = logit(r["doc_score"]) + logit(min(max(others, 0.001), 0.999)) - logit(mean)
        assert (r["host_score"], r["path_score"], r["quality_score"]) == pytest.approx((above[r["host"]], others, 1 / (1 + np.exp(-z))), abs=1e-9)
        assert r["kept"] == (r["quality_score"] >= 0.5)
    assert {r["host"] for r in got} > {None} and {r["path"] for r in got} > {None}


def test_odd_rows_of_scans(docs_of, bench):
    """Null and repeated ids, and repeated texts, are rows like any other."""
    rows = license_scan.scan(docs_of(["mit license", "mit license", None], [None, 4, 4])).collect()
    assert sorted((str(r["doc_id"]), r["n_base"]) for r in rows) == [("4", 0), ("4", 1), ("None", 1)]
    found = decontaminate.contaminated(docs_of([ITEM, SAME, ITEM, "clean"], [6, 6, None, 6]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(6, 1)}


def test_url_levels(spark):
    host, path = site_quality.url_levels(F.col("u"))
    df = spark.createDataFrame([("http://www.A.com:80/fr/8?p=2",), ("https://m.b.net/en/25#top",), (None,), ("x",)], "u string").select(host.alias("h"), path.alias("p"))
    assert [tuple(r) for r in df.collect()] == [("a.com", "fr"), ("m.b.net", "en"), (None, None), ("", "")]


SQL_TWINS = ["op1_chat_formatting", "op2_line_dedup", "op4_near_dedup", "op9_quality_rules"]


@pytest.mark.parametrize("name", SQL_TWINS)
def test_query_against_sql(spark, duck, sf_dir, name):
    from tests.conftest import rows

    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(queries.ORACLES[name]).df())
