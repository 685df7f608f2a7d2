"""Full-text search: query syntax, matching and BM25, as column expressions.

A query becomes a small tree of phrases. Index is a plan over chunks: a row for each
occurrence of a term; it needs nothing written and suits small tables and single
questions. What is kept on disk, and searched again and again, is operators.segments; both
answer alike, and search(), ladder() and hybrid.hybrid() take either.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import TOKEN

# Column weights and BM25 constants.
FIELDS = {"text": 1.0, "heading": 8.0, "section_path": 2.0, "title": 6.0}
K1, B, LEAST_IDF, NEAR_GAP = 1.2, 0.75, 1e-6, 5
#: Function words of several languages beyond those of FUNCTION_WORDS.
STOPWORDS = frozenset(
    (
        "a an the and or but if then at by for with about into to from up down in out on off over of as it its is am are was were be been have has had do does did does not no can will how what "
        "which who whom this that these those when where why i me my we our you your he him his she her they them their comment la le les un une des du de et ou mais dans sur avec sans pour par "
        "que qui est sont ce cet cette je tu il elle nous vous ils elles wie was wer der die das ein eine und oder nicht mit ohne von zu zum zur bei nach ich er sie es wir ihr ist sind im "
        "el los las una y o como cuando donde para con sin por del al ser yo e os do da dos em na no com se lo gli di che chi per sono het een van op en vs via etc"
    ).split()
)
#: Languages whose function words go, as Spark's own lists have them.
FUNCTION_WORDS = ("english", "french", "german", "spanish", "portuguese", "italian", "dutch")


def all_stopwords() -> frozenset[str]:
    """stopwords() of a running session; without one (as in a worker) they can't be read, and must be passed on."""
    return stopwords()


@functools.cache
def stopwords(languages: tuple[str, ...] = FUNCTION_WORDS) -> frozenset[str]:
    """STOPWORDS and the lists that come with Spark for these languages. Needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return STOPWORDS | {w.lower() for name in languages for w in StopWordsRemover.loadDefaultStopWords(name)}


def folding() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters they fold to."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = folding()


def fold(x: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def fold_py(x: str) -> str:
    return x.lower().translate(str.maketrans(MARKED, PLAIN))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokens_py(x: str) -> tuple[str, ...]:
    """The tokens of tokens(): runs of letters, numbers and private-use characters."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in fold_py(x))
    return tuple(w for w in kept.split(" ") if w)


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    shown: str = ""

    def __str__(self) -> str:
        return f'"{self.shown or " ".join(self.terms)}"'


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    gap: int = NEAR_GAP

    def __str__(self) -> str:
        return f"NEAR({' '.join(map(str, self.phrases))}, {self.gap})"


@dataclass(frozen=True)
class Every:
    parts: tuple

    def __str__(self) -> str:
        return " AND ".join(f"({p})" if isinstance(p, Some) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Some:
    parts: tuple

    def __str__(self) -> str:
        return " OR ".join(map(str, self.parts))


@dataclass(frozen=True)
class Query:
    """What a query means: the strict form, the loose one, and the words that count."""

    primary: object | None
    fallback: object | None
    words: tuple[str, ...]


_UNIT = re.compile(r'"([^"]+)"|(\S+)')


def trimmed(word: str) -> str:
    """Without punctuation, symbols and separators at the edges."""
    edge = lambda c: unicodedata.category(c)[0] in "PSZ"
    a, b = 0, len(word)
    while a < b and edge(word[a]):
        a += 1
    while b > a and edge(word[b - 1]):
        b -= 1
    return word[a:b]


def phrase(text: str) -> Phrase | None:
    shown = re.sub(r"[\"']", " ", text).strip()
    return Phrase(tokens_py(shown), shown) if shown else None


def units(query: str, keywords: tuple[str, ...] = (), stopwords: frozenset[str] = frozenset()) -> tuple[tuple[str, ...], tuple[Phrase, ...], tuple[Phrase, ...]]:
    """The words of a query that count, the phrases that they are, and those of the keywords. Stopwords go unless fewer than two units would stay."""
    found = [(q.strip(), True) if q else (trimmed(w), False) for q, w in _UNIT.findall(query)]
    found = [u for u in found if u[0]]
    kept = [u for u in found if u[1] or u[0].lower() not in stopwords]
    kept = kept if len(kept) >= 2 else found
    phrases = tuple(p for p in (phrase(w) for w, _ in kept) if p)
    return tuple(w for w, _ in kept), phrases, tuple(p for p in (phrase(trimmed(k)) for k in keywords) if p)


def parse(query: str, keywords: tuple[str, ...] = (), stopwords: frozenset[str] | None = None) -> Query:
    """Quoted phrases and words; without stopwords given, all of stopwords() count as such."""
    words, phrases, needed = units(query, keywords, all_stopwords() if stopwords is None else stopwords)
    strict = None if not phrases else phrases[0] if len(phrases) == 1 else Near(phrases) if len(phrases) <= 3 else Every(phrases)
    loose = None if not phrases else phrases[0] if len(phrases) == 1 else Some(phrases)

    def both(node):
        parts = ((node,) if node is not None else ()) + needed
        return None if not parts else parts[0] if len(parts) == 1 else Every(parts)

    return Query(both(strict), both(loose), words)


def tokenized(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key and one token array for each searched column; columns that chunks lack count as empty."""
    empty = F.array().cast("array<string>")
    return chunks.select(key, *((tokens(F.col(f)) if f in chunks.columns else empty).alias(f"t_{f}") for f in FIELDS))


def close(mine: Column, size: int | Column, others: list[tuple[Column, int | Column]], gap: int) -> Column:
    """The starts that form a clump with one start of each other phrase."""

    def clump(x: Column, low_end: Column, high: Column, rest: list[tuple[Column, int]]) -> Column:
        if not rest:
            return high - low_end <= gap
        (places, width), more = rest[0], rest[1:]
        # of all phrases the end of the first to start and the start of the last
        return F.exists(places, lambda y: clump(x, F.least(low_end, y + width), F.greatest(high, y), more))

    return F.filter(mine, lambda x: clump(x, x + size, x, others))


def starts(p: Phrase, places) -> Column:
    """Where a phrase starts, from its terms' positions in a field."""

    def earlier(spots: Column, k: int) -> Column:
        return F.transform(spots, lambda x: x - k) if k else spots

    shifted = [earlier(places(t), k) for k, t in enumerate(p.terms)]
    return reduce(F.array_intersect, shifted) if shifted else F.array().cast("array<int>")


def leaves(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    return [p for x in (node.phrases if isinstance(node, Near) else node.parts) for p in leaves(x)]


def _evaluate(node, counter: list[int]) -> tuple[Column, list[Column]]:
    """Whether a row matches, and for each leaf its weighted number of counting occurrences."""
    if isinstance(node, Phrase):
        k = counter[0]
        counter[0] += 1
        sizes = [F.size(F.col(f"o{k}_{f}")) for f in FIELDS]
        return reduce(lambda a, b: a | b, [s > 0 for s in sizes]), [reduce(lambda a, b: a + b, [s * w for s, w in zip(sizes, FIELDS.values(), strict=True)])]
    if isinstance(node, Near):
        first = counter[0]
        counter[0] += len(node.phrases)
        hit, scores = F.lit(False), [F.lit(0.0)] * len(node.phrases)
        for f, w in FIELDS.items():
            places = [(F.col(f"o{first + i}_{f}"), len(p.terms)) for i, p in enumerate(node.phrases)]
            clumps = [close(x, n, places[:i] + places[i + 1 :], node.gap) for i, (x, n) in enumerate(places)]
            hit = hit | (F.size(clumps[0]) > 0)
            scores = [s + F.size(c) * w for s, c in zip(scores, clumps, strict=True)]
        return hit, scores
    parts = [_evaluate(p, counter) for p in node.parts]
    join = (lambda a, b: a & b) if isinstance(node, Every) else (lambda a, b: a | b)
    return reduce(join, [m for m, _ in parts]), [s for _, scores in parts for s in scores]


@dataclass(frozen=True)
class Index:
    """rows: key, len (the chunk's tokens), field, pos and term of every occurrence; stats: n (chunks) and average (tokens), in one row."""

    rows: DataFrame
    stats: DataFrame
    key: str = "chunk_id"


def index(chunks: DataFrame, key: str = "chunk_id") -> Index:
    """The index of all chunks as a plan."""
    t = tokenized(chunks, key)
    length = reduce(lambda a, b: a + b, [F.size(f"t_{f}") for f in FIELDS])

    def spots(n: int, f: str) -> Column:
        return F.transform(f"t_{f}", lambda w, i: F.struct(F.lit(n).cast("tinyint").alias("field"), i.cast("int").alias("pos"), w.alias("term")))

    rows = t.select(key, length.alias("len"), F.inline(F.concat(*(spots(n, f) for n, f in enumerate(FIELDS)))).alias("field", "pos", "term"))
    return Index(rows, t.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("average")), key)


def bm25(index: Index, node) -> DataFrame:
    """key and score of every matching chunk; statistics are of all chunks of the index. One plan: document frequencies and corpus statistics are subqueries."""
    found, key = leaves(node), index.key
    asked = sorted({t for p in found for t in p.terms})
    places = [(t, n) for t in asked for n in range(len(FIELDS))]
    wanted = reduce(lambda a, b: a | b, [F.col("term") == t for t in asked]) if asked else F.lit(False)
    held = [F.collect_list(F.when((F.col("term") == t) & (F.col("field") == n), F.col("pos"))).alias(f"a{i}") for i, (t, n) in enumerate(places)]
    rows = index.rows.where(wanted).groupBy(key, "len").agg(F.count(F.lit(1)).alias("__n"), *held)
    names = {place: F.col(f"a{i}") for i, place in enumerate(places)}
    rows = rows.select(key, "len", *(starts(p, lambda t, n=n: names[t, n]).alias(f"o{k}_{f}") for k, p in enumerate(found) for n, f in enumerate(FIELDS)))
    match, counts = _evaluate(node, [0])
    has = [reduce(lambda a, b: a | b, [F.size(f"o{k}_{f}") > 0 for f in FIELDS]) for k in range(len(found))]
    holding = rows.agg(F.struct(*(F.count_if(h).alias(f"d{k}") for k, h in enumerate(has))).alias("d")).scalar()
    corpus = index.stats.select(F.struct("n", "average").alias("c")).scalar()
    scored = rows.select(key, "len", match.alias("__match"), holding.alias("__d"), corpus.alias("__c"), *(f.cast("double").alias(f"__f{k}") for k, f in enumerate(counts)))
    score = F.lit(0.0)
    for k in range(len(found)):
        n, df, f = F.col("__c.n"), F.col(f"__d.d{k}"), F.col(f"__f{k}")
        idf = F.ln((n - df + 0.5) / (df + 0.5))
        norm = F.lit(K1 * (1 - B)) + F.col("len") * F.lit(K1 * B) / F.coalesce(F.nullif(F.col("__c.average"), F.lit(0.0)), F.lit(1.0))
        score = score + F.when(idf > 0, idf).otherwise(LEAST_IDF) * (K1 + 1) * f / (f + norm)
    return scored.where("__match").select(key, score.alias("score"))


def search(index: Index, chunks: DataFrame, node, limit: int, where: Column | None = None, partial: bool = False) -> DataFrame:
    """The best chunks by BM25, all columns of chunks and their score. Filters come after the match; statistics stay the index's. A kept index answers with the columns that it holds.

    partial: chunks may lack some of the index (those of documents that aren't to be
    found); they count for the statistics and are left out before the best are taken.
    """
    if not isinstance(index, Index):
        return index.search(node, limit, where, chunks.select(index.key) if partial else None)
    hits, key = bm25(index, node), index.key
    if partial or where is not None:
        hits = hits.join((chunks if where is None else chunks.where(where)).select(key), key, "left_semi")
    best = F.broadcast(hits.orderBy(F.desc("score"), key).limit(limit))  # at most `limit` rows
    return best.join(chunks, key).select(*chunks.columns, "score").orderBy(F.desc("score"), key)


def like(chunks: DataFrame, words: tuple[str, ...], limit: int, where: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """Chunks that contain all words as text, those with the first word earliest first; score 1 / rank."""
    from pyspark.sql import Window

    if not words and where is None:
        return chunks.limit(0).withColumn("score", F.lit(0.0))
    low = F.lower("text")
    conditions = [F.contains(low, F.lit(w.lower())) for w in words] + ([where] if where is not None else [])
    order = [F.instr(low, words[0].lower())] if words else []
    best = chunks.where(reduce(lambda a, b: a & b, conditions)).withColumn("__at", order[0] if order else F.lit(0)).orderBy("__at", key).limit(limit)
    return best.withColumn("score", 1.0 / F.row_number().over(Window.orderBy("__at", key))).drop("__at")  # at most `limit` rows


def ladder(index: Index, chunks: DataFrame, query: Query, limit: int, where: Column | None = None, filtered: bool = False, partial: bool = False, loose: bool = True) -> DataFrame:
    """Strict matches; if there are none, loose ones (unless they aren't wanted); without any word, what the filters alone let through."""
    if query.primary is None:
        if filtered and not isinstance(index, Index):
            return index.substring(query.words, limit, where, chunks.select(index.key) if partial else None)
        return like(chunks, query.words, limit, where, index.key) if filtered else chunks.limit(0).withColumn("score", F.lit(0.0))
    strict = search(index, chunks, query.primary, limit, where, partial)
    if not loose or str(query.fallback) == str(query.primary) or not strict.isEmpty():
        return strict
    return search(index, chunks, query.fallback, limit, where, partial)
