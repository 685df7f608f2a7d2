"""Quality rules whose cutoffs are chosen under a proven risk.

Every text gets a few measures of its words, symbols and lines. The labelled rows
that pass the base rule are dealt by their ids into two parts. In each stratum (a
class of length)

1. the first part, a third, proposes a sequence of cutoffs: time and again the rule
   and cutoff that rejects the most bad texts for each good one among those that the
   sequence hasn't rejected yet, as long as it tells for bad texts (RATIO);
2. the second part tests the sequence from its start, a step at a time: a step, with
   all before it, is safe if the exact binomial bound shows that together they
   reject at most a limited share of good texts. The first that isn't safe ends the
   sequence (fixed-sequence testing), so steps need no correction among each other.

Each stratum is tested by its own good texts alone; neighbours with few labels lend each
other proposals, never evidence. Strata share the allowed chance of failure (Holm: a stratum
whose whole sequence is safe hands its share on to those that stopped). A stratum with too
few good texts to show anything even if none were rejected has no cutoffs, and takes no share:
there the base rule alone holds. So with a probability of 1 - FAILURE no stratum loses more
than MAX_FALSE of its good texts beyond those that fail the base rule, which the bound leaves
out. With the defaults a stratum needs about 150 to 220 good texts in the testing part.

Counts cover all labelled rows; the driver sees counts for strata, rules and steps.

Defined results: null and empty texts have no words and fail the base rule; labels
that are null or neither 0 nor 1 count as missing, repeated ones as the least;
repeated rows count as often as they come; texts that tie with a cutoff stay;
without enough labels only the base rule holds. All columns of docs stay, but one
called like the result's is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidepool.llm.shared import bounded_batches, prefilter, scratch, unused

#: Share of a stratum's good texts that all its cutoffs together may reject, and the chance that any bound fails.
MAX_FALSE, FAILURE = 0.02, 0.05
#: How many times likelier a step must hit a bad text than a good one: the likelihood ratio from which a diagnostic test
#: is customarily held conclusive (Jaeschke, Guyatt and Sackett, JAMA 1994).
RATIO = 10.0
#: Steps of a sequence, and one in how many labelled rows proposes.
STEPS, PROPOSING = 8, 3
#: Upper ends of the strata, in words.
STRATA = (100, 400, 1600)
#: Rules: a measure and its cutoffs, mildest first. A text is rejected above the cutoff.
CUTOFFS = tuple(round(0.9 * 0.8**k, 6) for k in range(24))
RULES = ("symbol_share", "repeat_share", "dup_line_share", "shout_share", "long_word")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Fixed: the symbols that count.
SYMBOLS = b"#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words which comes twice or more. Windows are told by 64-bit hashes: of a text's n windows two are taken for equal by chance with probability n^2 / 2^65."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = (h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[1 : n + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n + 2, bool)
    for k in range(3):
        inside[k : k + n] |= again
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    visible = len(text) - sum(map(text.count, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), visible, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper


@F.pandas_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES), dtype="int64")


def base_failed(m):
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def stratum(m) -> Column:
    out = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        out = F.when(m["n_words"] < STRATA[k], k).otherwise(out)
    return out


def value(m, rule: str):
    """A rule's measure, from a struct of MEASURES."""
    n = {name: m[name].cast("double") for name in MEASURES}
    words, chars = F.greatest(n["n_words"], F.lit(1.0)), F.greatest(n["word_chars"], F.lit(1.0))
    return {
        "symbol_share": n["n_symbols"] / chars,
        "repeat_share": n["n_repeat_words"] / words,
        "dup_line_share": n["n_dup_lines"] / F.greatest(n["n_lines"], F.lit(1.0)),
        "shout_share": n["n_upper"] / chars,
        "long_word": n["word_chars"] / words / 40,
    }[rule]


def tail(k: int, n: int, p: float) -> float:
    """Exact probability of at most k successes in n trials."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(x) for x in range(1, n + 2)])
    logs = lg[n] - lg[i] - lg[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(np.exp(top) * np.exp(logs - top).sum())


def safe(rejected: int, n: int, share: float, level: float) -> bool:
    """Whether, at this level, more than `share` of rejections among good texts can be ruled out."""
    return n > 0 and tail(rejected, n, share) <= level


#: The cutoffs of a stratum in the order in which they are tested: rule and cutoff.
Sequence = list[tuple[str, float]]


def merged(good: dict[int, int], share: float, failure: float) -> dict[int, int]:
    """A group for each stratum, to propose together: neighbours join until each group has as many good texts as a proof takes."""
    groups = [[s] for s in range(len(STRATA) + 1)]
    while len(groups) > 1:
        sizes = [sum(good.get(s, 0) for s in g) for g in groups]
        least = min(range(len(groups)), key=sizes.__getitem__)
        if safe(0, sizes[least], share, failure / len(groups)):
            break
        near = min((k for k in (least - 1, least + 1) if 0 <= k < len(groups)), key=sizes.__getitem__)
        a, b = sorted((least, near))
        groups[a : b + 1] = [groups[a] + groups[b]]
    return {s: g[0] for g in groups for s in g}


def able(good: dict[int, int], share: float, failure: float) -> dict[int, int]:
    """The strata whose good texts can show something at an equal part of the chance of failure: as many of the largest as can."""
    sizes = sorted(good.items(), key=lambda x: (-x[1], x[0]))
    while sizes and not safe(0, sizes[-1][1], share, failure / len(sizes)):
        sizes.pop()
    return dict(sizes)


def step_of(hits: Callable[[str, float], Column], of: Column, sequences: dict[int, Sequence]) -> Column:
    """The first step that rejects a text in its group's sequence; null if none does. hits: whether a rule's cutoff rejects it; of: its group."""
    out = F.lit(None).cast("int")
    for g, sequence in sorted(sequences.items()):
        first = F.lit(None).cast("int")
        for k, (rule, cutoff) in reversed(list(enumerate(sequence))):
            first = F.when(hits(rule, cutoff), k).otherwise(first)
        out = F.when(of == g, first).otherwise(out)
    return out


def level(m, rule: str) -> Column:
    """How many of a rule's cutoffs lie below a text's measure: the strictest ones."""
    return F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: value(m, rule) > c)).cast("tinyint")


def by_level(rule: str, cutoff: float) -> Column:
    return F.col(rule) >= len(CUTOFFS) - CUTOFFS.index(cutoff)


def propose(rows: DataFrame, groups: set[int], ratio: float) -> dict[int, Sequence]:
    """A sequence of cutoffs for each group, from counts of the rows that it hasn't rejected yet; a small job for each step. rows: group, label, and each rule's level."""
    found: dict[int, Sequence] = {g: [] for g in groups}
    going, total = set(found), {}
    told = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES)))
    for _ in range(STEPS):
        left = rows.where(step_of(by_level, F.col("group"), found).isNull())
        hits: dict[tuple, np.ndarray] = {}
        for r in left.select("group", "label", told.alias("at")).groupBy("group", "label", "at.rule", "at.level").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each group, label, rule and level
            hits.setdefault((r["group"], r["label"], r["rule"]), np.zeros(len(CUTOFFS) + 1, np.int64))[len(CUTOFFS) - r["level"] :] += r["n"]
        total = total or {(g, label): int(n[-1]) for (g, label, _), n in hits.items()}
        for g in sorted(going):
            best = None
            for rule in RULES:
                for k, cutoff in enumerate(CUTOFFS):
                    hit, lost = (int(hits[g, label, rule][k]) if (g, label, rule) in hits else 0 for label in (0, 1))
                    if hit and hit * total.get((g, 1), 0) >= ratio * (lost + 1) * total[g, 0]:
                        worth = (hit / (lost + 1), -k)
                        best = max(best, (worth, rule, cutoff)) if best else (worth, rule, cutoff)
            if best is None:
                going.discard(g)
            else:
                found[g].append(best[1:])
        if not going:
            break
    return found


def tested(steps: dict[int, list[int]], good: dict[int, int], share: float, failure: float) -> dict[int, int]:
    """How many steps of each stratum's sequence are safe. steps: for each stratum the good texts that each step rejects first."""
    part = failure / max(1, len(good))

    def walk(g: int, level: float) -> int:
        lost = 0
        for k, n in enumerate(steps[g]):
            lost += n
            if not safe(lost, good[g], share, level):
                return k
        return len(steps[g])

    open_, level, out = set(good), part, {}
    while open_:
        new = {g: walk(g, level) for g in open_}
        done = {g for g in open_ if new[g] == len(steps[g])}
        out |= new
        if not done or done == open_:
            break
        open_ -= done
        level = failure / len(open_)
    return out


def cutoffs(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_false: float = MAX_FALSE, failure: float = FAILURE, ratio: float = RATIO) -> dict[int, Sequence]:
    """The safe cutoffs of each stratum, from all labelled rows that pass the base rule. Only their measures are written, only counts reach the driver."""
    ids = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.min(label).cast("int").alias("label"))
    ids = scratch(ids, "labels")
    some = prefilter(docs.select(docs[key].alias("id"), docs[text].alias("text")), "id", ids)
    m = F.col("m")
    rows = some.select("id", measures("text").alias("m")).where(~base_failed(m)).join(ids, "id")
    rows = rows.select(stratum(m).alias("stratum"), "label", (F.pmod(F.xxhash64("id"), F.lit(PROPOSING)) == 0).alias("proposes"), *(level(m, r).alias(r) for r in RULES))
    rows = scratch(rows, "measured")
    good = {r["stratum"]: r["n"] for r in rows.where("not proposes and label = 1").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = merged(good, max_false, failure)
    of = F.create_map(*(F.lit(x) for pair in sorted(groups.items()) for x in pair))[F.col("stratum")]
    rows = rows.withColumn("group", of)
    sequences = propose(rows.where("proposes"), set(groups.values()), ratio)
    first = rows.where("not proposes and label = 1").groupBy("stratum", step_of(by_level, F.col("group"), sequences).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    strata = able(good, max_false, failure)
    steps = {s: [0] * len(sequences[groups[s]]) for s in strata}
    for r in first.collect():  # a row for each stratum and step
        if r["k"] is not None and r["stratum"] in steps:
            steps[r["stratum"]][r["k"]] = r["n"]
    held = tested(steps, strata, max_false, failure)
    return {s: sequences[g][: held.get(s, 0)] for s, g in groups.items()}


def verdict(m, chosen: dict[int, Sequence]) -> Column:
    """Whether a text's measures pass the base rule and the chosen cutoffs."""
    return ~base_failed(m) & step_of(lambda rule, cutoff: value(m, rule) > cutoff, stratum(m), chosen).isNull()


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", at: str = "quality_rules", chosen: dict[int, Sequence] | None = None) -> DataFrame:
    """docs with a struct column `at`: MEASURES, base_failed and kept, by given cutoffs or those that the labels allow."""
    bounded_batches(docs.sparkSession)
    chosen = cutoffs(docs, labels, text, key, label) if chosen is None else chosen
    own = unused("__m", docs)
    m = F.col(own)
    fields = [*(m[x].alias(x) for x in MEASURES), base_failed(m).alias("base_failed"), verdict(m, chosen).alias("kept")]
    return docs.withColumn(own, measures(docs[text])).withColumn(at, F.struct(*fields)).drop(own)
