"""Few labels, repeated rows and strata without evidence: nothing clean may go for want of labels."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidepool.llm import quality_rules, toxicity
from tidepool.llm.shared import scratch


def prose(r, n=60):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("known", [0, 1, 2, 3])
def test_few_toxic_labels_reject_nothing_clean(spark, tmp_path, known):
    r = random.Random(known)
    rows = [(i, prose(r) + (" grubnak vilethorn" if i % 10 == 0 else ""), "xx", "s", 1, "own") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    labels = spark.createDataFrame([(10 * i, 1, 1) for i in range(known)] + [(10 * i + 1, 1, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert not any(model.score(t) >= 0.5 for i, t, *_ in rows if i % 10)
    if known == 3:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/labels.parquet")
        clean = scratch(corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)), "clean")
        assert {x.doc_id for x in clean.collect()} >= {i for i in range(120) if i % 10} and clean.columns == docs.columns
        assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() >= 100


def test_toxicity_of_repeated_rows(spark):
    r = random.Random(7)
    rows = [(i, prose(r) + (" grubnak vilethorn" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(1000)]
    one = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    many = one.crossJoin(spark.range(200)).select("doc_id", "text")
    again = many.union(spark.createDataFrame([(3, "another text")], "doc_id bigint, text string"))  # an id with two texts
    model = toxicity.fit(again, one.select("doc_id", "toxic"), sample=60)
    assert model.weights and all((model.score(t) >= 0.5) == bool(y) for _, t, y in rows)


def plain_fit_words(rows):
    """The words that a fit must find: so much more frequent among toxic texts that no chance brings it about."""
    toxic, clean = ([toxicity.vocabulary(t) for _, t, y in rows if y == side] for side in (1, 0))
    counts = [Counter(w for s in side for w in s) for side in (toxic, clean)]
    return {w for w, n in counts[0].items() if n >= 0.5 * len(toxic) and counts[1][w] <= 0.01 * len(clean)}


def test_toxicity_learns_what_a_plain_count_shows(spark):
    r = random.Random(8)
    rows = [(i, prose(r, 30) + ("".join(r.sample([" vile", " grub", " nak", " thorn"], 3)) if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    want = plain_fit_words(rows)
    assert want == {"vile", "grub", "nak", "thorn"} == set(model.weights) and all(w > 0 for w in model.weights.values())
    hits = [sum(w in toxicity.vocabulary(t) for w in want) for _, t, _ in rows]
    assert [model.score(t) >= 0.5 for _, t, _ in rows] == [n >= 2 for n in hits]


def test_strata_are_proven_one_by_one(spark):
    """40 good texts in the shortest stratum, all with symbols, and thousands in the next, whose bad texts have them."""
    r = random.Random(9)
    short = [(i, prose(r, 70).replace(" ", "# "), 1) for i in range(40)]
    middle = [(1000 + i, prose(r, 120), 1) for i in range(1500)] + [(5000 + i, prose(r, 120).replace(" ", "### "), 0) for i in range(200)]
    d = spark.createDataFrame(short + middle, "doc_id bigint, text string, quality int")
    out = {x.doc_id: x.quality_rules.kept for x in quality_rules.judge(d.select("doc_id", "text"), d.select("doc_id", "quality")).collect()}
    assert all(out[i] for i in range(40))
    assert sum(not out[1000 + i] for i in range(1500)) <= 30 and sum(not out[5000 + i] for i in range(200)) >= 190


def test_who_can_be_proven():
    assert quality_rules.able({0: 40, 1: 3000, 2: 180}, 0.02, 0.05) == {1: 3000}
    assert quality_rules.able({0: 40, 1: 3000, 2: 190}, 0.02, 0.05) == {1: 3000, 2: 190}
    assert quality_rules.able({}, 0.02, 0.05) == {} == quality_rules.able({0: 100}, 0.02, 0.05)


def test_ties_and_repeats_in_rules(spark):
    """Texts that tie with a cutoff stay; repeated rows and labels count as often as they come, and as the least."""
    text = " ".join(["word"] * 10 + [f"w{i}#" for i in range(60)])
    m = quality_rules.measure(text)
    share = m[2] / m[1]
    d = spark.createDataFrame([(1, text)] * 3 + [(2, text + " plain words here"), (3, "w " * 100_000)], "doc_id bigint, text string")
    for cutoff, kept in ((share, True), (share - 1e-9, False)):
        got = quality_rules.judge(d, None, chosen={s: [("symbol_share", cutoff)] for s in range(4)})
        assert [x.quality_rules.kept for x in got.where("doc_id = 1").collect()] == [kept] * 3
        assert not got.where("doc_id = 3").first().quality_rules.kept  # nothing but repeats, however long
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (2, 7)], "doc_id bigint, quality int")
    assert quality_rules.cutoffs(d, labels) == {0: [], 1: [], 2: [], 3: []}


def plain_proposals(rows, ratio):
    """rows: label and each rule's level. The proposal in plain loops."""
    out, left, total = [], list(rows), Counter(label for label, _ in rows)
    for _ in range(quality_rules.STEPS):
        best = None
        for rule in quality_rules.RULES:
            for k in range(len(quality_rules.CUTOFFS)):
                hit = [label for label, levels in left if levels[rule] >= len(quality_rules.CUTOFFS) - k]
                bad, lost = hit.count(0), hit.count(1)
                if bad and bad * total[1] >= ratio * (lost + 1) * total[0]:
                    best = max(best or ((0, 0), "", 0), ((bad / (lost + 1), -k), rule, quality_rules.CUTOFFS[k]))
        if best is None:
            break
        out.append(best[1:])
        left = [x for x in left if x[1][best[1]] < len(quality_rules.CUTOFFS) - quality_rules.CUTOFFS.index(best[2])]
    return out


def test_proposals_in_plain_code(spark):
    r = random.Random(10)
    rows = [(r.choice((0, 0, 1, 1, 1)), {rule: 0 for rule in quality_rules.RULES}) for _ in range(400)]
    for label, levels in rows:
        if not label:
            levels[r.choice(quality_rules.RULES)] = r.randint(3, 20)
        elif r.random() < 0.05:
            levels[r.choice(quality_rules.RULES)] = r.randint(1, 6)
    d = spark.createDataFrame([(0, label, *levels.values()) for label, levels in rows], "group int, label int, " + ", ".join(f"{x} tinyint" for x in quality_rules.RULES))
    want = plain_proposals(rows, 10.0)
    assert want and quality_rules.propose(d, {0}, 10.0) == {0: want}
