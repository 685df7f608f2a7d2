import random

from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.operators import near


def test_all_pairs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 7)))
    texts = ["", " \n", "short", "Short ", "a" * 60, "a" * 70, None]
    for n in (8, 9, 10, 12, 14, 16, 30, 31, 40, 60, 120, 500, 1500):
        base = " ".join(word() for _ in range(4 * n))
        for _ in range(7):  # pieces from the start, the middle and the end of one text
            length = int(len(base) * r.uniform(0.74, 1))
            at = r.choice([0, 0, len(base) - length, r.randint(0, len(base) - length)])
            texts.append(base[at : at + length])
        texts += [base, base.upper(), f"{base[:240]} {word()} {word()} {base[250:]}", f"{base}\n {word()}", f"{word()} {base}"]
    order = list(range(len(texts)))
    r.shuffle(order)
    d = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id bigint, text string").repartition(4).cache()
    got = {(x.other, x.doc_id, x.equal) for x in near.all_pairs(d).collect()}
    rows = d.where("text is not null").select("doc_id", "text", text.for_dedup(F.col("text")).alias("t"))
    reps = rows.groupBy("t").agg(F.min("doc_id").alias("rep"))
    want = {(x.rep, x.doc_id, True) for x in rows.join(reps, "t").where("doc_id <> rep").collect()}
    a, b = (rows.join(reps, "t").where("doc_id = rep").select(F.col("doc_id").alias(i), F.col("text").alias(t)) for i, t in (("a", "ta"), ("b", "tb")))
    brute = a.crossJoin(b).where("a < b").where(text.near_duplicate(F.col("ta"), F.col("tb"))).select("a", "b").collect()
    assert got == want | {(x.a, x.b, False) for x in brute}
    assert len(brute) > 300 and any(e for *_, e in got)


def test_near_all_pairs_query_compares_all(spark, tmp_path):
    from tidepool.plans import retrieval

    a, b = ("one shared head of more than forty characters " + " ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = [(1, a), (2, b), (3, a), (4, f"other head {b}"), (5, "tiny"), (6, " TINY")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.other, x.doc_id, x.equal) for x in retrieval.near_duplicate_all_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, 3, True), (2, 4, False), (5, 6, True)}
