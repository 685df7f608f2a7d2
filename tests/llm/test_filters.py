import random

import numpy as np
from pyspark.sql import functions as F

from tests_llm_plain import slow_lines, slow_measures
from tidepool.llm import compression_quality, langid, line_dedup, quality_rules, toxicity


def test_measures():
    r = random.Random(5)
    for text in ["", None, " \n ", "é # x", "a a a a", "a b c a b c", *("".join(r.choice("ab #|\n\té\x0b") for _ in range(80)) for _ in range(200))]:
        assert quality_rules.measure(text)[:5] == slow_measures(text)


def test_bound_is_exact():
    assert abs(quality_rules.tail(1, 10, 0.1) - (0.9**10 + 10 * 0.1 * 0.9**9)) < 1e-12
    assert quality_rules.safe(0, 1000, 0.01, 0.01) and not quality_rules.safe(0, 100, 0.01, 0.01) and not quality_rules.safe(0, 0, 0.5, 0.5)


def prose(r, n=80):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_rules(spark):
    r = random.Random(1)
    rows = [(i, prose(r), 1) for i in range(1500)] + [(5000 + i, prose(r).replace(" ", "### "), 0) for i in range(300)] + [(9000, None, None), (9001, "", 1), (9002, "short", 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    docs = d.select("doc_id", "text", F.lit(7).alias("kept"), F.lit(1).alias("n_words"))
    out = {x.doc_id: x.quality_rules for x in quality_rules.judge(docs, d.select("doc_id", "quality")).collect()}
    assert sum(not out[i].kept for i in range(1500)) <= 30
    assert sum(not out[5000 + i].kept for i in range(300)) >= 290
    assert out[9000].base_failed and out[9001].base_failed and not out[9002].kept
    none = quality_rules.judge(docs, d.select("doc_id", "quality").limit(0))
    assert none.where("quality_rules.kept").count() == 1800
    assert quality_rules.judge(docs.limit(0), d.select("doc_id", "quality")).count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    rows = [(i, prose(r) + (" grubnak " + prose(r, 5) + " vilethorn" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(1500)] + [(7000, None, 0), (7001, "", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    docs = d.select("doc_id", "text", F.lit(1).alias("score"))
    model = toxicity.fit(docs, d.select("doc_id", "toxic"), usable=F.col("doc_id") % 3 != 0)
    out = {x.doc_id: x.s for x in docs.select("doc_id", toxicity.scorer(spark, model)("text").alias("s")).collect()}
    assert all((out[i] >= 0.5) == (i % 10 == 0) for i in range(1500)) and out[7000] < 0.5
    blank = toxicity.fit(docs, d.select("doc_id", "toxic").limit(0))
    assert blank.score("grubnak") == 0.0


def test_non_negative_risk_separates():
    positive, other = ([np.array(r, np.int32) for r in side] for side in ([[0], [0, 1], [0]], [[1], [1], [0], [], [1], []]))
    w, b = toxicity.train(positive, other, 2, 0.3, 0.1)
    assert b + w[0] > 0 > b + w[1]


def test_compression(spark):
    r = random.Random(3)
    rows = [(i, prose(r, 150) if i % 2 else prose(r, 150).replace(" ", "$$$ "), i % 2) for i in range(400)] + [(900, None, 1), (901, "", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = compression_quality.fit(d, d.select("doc_id", "quality"), usable=F.col("doc_id") % 3 != 1)
    out = {x.doc_id: x.s for x in d.select("doc_id", compression_quality.scorer(spark, model)("text").alias("s")).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(i % 2) for i in range(400)]) > 0.97
    assert out[900] == out[901] and all(0 <= s <= 1 for s in out.values())
    none = compression_quality.fit(d, d.select("doc_id", "quality").limit(0))
    assert none.intercept == 0.0


def test_languages(spark):
    r = random.Random(4)
    parts = {"xx": ["ka", "ro", "mi"], "yy": ["schl", "ung", "tze"], "zz": ["èle", "oux", "ai"]}
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(60)), lang) for i, lang in enumerate(sorted(parts) * 60)]
    rows += [(900, None, "xx"), (901, "123 ?!", "yy"), (902, "", None), (903, "karomi", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = langid.learn(d, usable=F.col("doc_id") % 4 != 2)
    out = {x.doc_id: x.at for x in d.select("doc_id", langid.identifier(spark, profiles)("text").alias("at")).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:180]) and out[903].lang_pred == "xx"
    assert [out[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert langid.Identifier({}).predict("abc") == ("und", 0.0)


def test_lines(spark):
    r = random.Random(6)
    base = [[r.choice("abcdefghij") * 3 for _ in range(n)] for n in (4, 7, 8, 9, 9, 12, 30) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "\n\n")]
    for d in range(3, 60):
        lines = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at, what = r.randrange(len(w)), r.random()
                w[at : at + 1] = [] if what < 0.3 else [w[at], "new"] if what < 0.6 else ["sub"]
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as line", "2 as h")
    out = line_dedup.dedup_lines(d.repartition(3))
    assert {x.doc_id: x.line_dedup.text for x in out.collect()} == slow_lines(rows)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0
    loose = spark.createDataFrame([(None, "one two three four"), (None, "one two three four")], "doc_id bigint, text string")
    assert {x.line_dedup.text for x in line_dedup.dedup_lines(loose).collect()} == {"one two three four"}
