"""The queries of this subpackage's operators, thin layers over them, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe, compression_quality, conversations, langid, line_dedup, minhash, packing, quality_rules, spelling, token_counts, toxicity, vector_packing, vector_search
from tidepool.llm.oracle import OP12_SQL, OP13_SQL
from tidepool.llm.shared import crc_mod, read

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(ids: np.ndarray, at: np.ndarray) -> dict:
        flat, bounds = ids.astype("<u4"), at.tolist()
        return {"ids_crc32": pa.array([zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())}

    out = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), columns=digest, kinds="ids_crc32 bigint")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *(f"quality_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3)
    model = compression_quality.fit(docs, read(spark, sf_dir, "labels"), usable=remainder != 1)
    scored = docs.select("doc_id", (remainder == 1).alias("held_out"), compression_quality.scorer(spark, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"line_dedup.{c}" for c in ("n_lines", "n_removed", "n_words", "n_words_removed", "text")))


OP4_SQL = r"""
with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) + 1 i, unnest(string_split(text, chr(10))) t from documents),
w as (select doc_id, i, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from l),
s as (select doc_id, i, w, array_to_string(w, ' ') k, len(w) n from w where len(w) >= 4 or len(w) > 0 and len(regexp_extract_all(t, '[\p{L}\p{N}]')) >= 20),
f as (select k, any_value(w) w, any_value(n) n, min({'d': doc_id, 'i': i}) p from s group by k),
v as (select k, p, n, j, array_to_string(list_concat(w[1:j - 1], w[j + 1:]), ' ') x from (select *, unnest(range(1, n + 1)) j from f where n >= 8)),
g as (select x, j, min(p) p from v group by x, j having count(distinct k) > 1),
near as (
  select v.k from v join g on v.x = g.x and v.j = g.j where g.p < v.p
  union select v.k from v join f on v.x = f.k where f.n >= 8 and f.p < v.p
  union select f.k from f join v on v.x = f.k where f.n >= 8 and v.p < f.p),
gone as (select s.doc_id, s.i, s.n from s join f using (k) where {'d': s.doc_id, 'i': s.i} > f.p or s.k in (select k from near)),
c as (select w.doc_id, count(*) n_lines, count(gone.i) n_removed, sum(len(w.w)) n_words, coalesce(sum(gone.n), 0) n_words_removed,
  coalesce(string_agg(w.t, chr(10) order by w.i) filter (gone.i is null), '') text
  from w left join gone on w.doc_id = gone.doc_id and w.i = gone.i group by w.doc_id)
select doc_id, n_lines, n_removed, cast(n_words as bigint) n_words, cast(n_words_removed as bigint) n_words_removed, text from c
"""


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) k from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
u as (select a, b from e union select b, a from e),
r as (select doc_id x, doc_id y from documents union select r.x, u.b from r join u on r.y = u.a),
c as (select x doc_id, min(y) component_id from r group by x)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from c left join n using (doc_id)
"""


def op7_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), usable=remainder != 0)
    scored = docs.select("doc_id", (remainder == 0).alias("held_out"), toxicity.scorer(spark, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP9_SQL = """
with q as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
s as (select a.vec_id query_id, b.vec_id vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) score
  from q a join q b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) rank, vec_id, score from s)
select query_id, cast(rank as integer) rank, vec_id, cast(score as bigint) score from r where rank <= 10
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4)
    profiles = langid.learn(docs, usable=remainder != 2)
    found = docs.select("doc_id", (remainder == 2).alias("held_out"), langid.identifier(spark, profiles)("text").alias("at"))
    return found.select("doc_id", "held_out", "at.lang_pred", "at.score")


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(ids: list[np.ndarray]) -> dict:
        return {"ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())}

    out = vector_packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), columns=digest, kinds="ids_crc32 bigint")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with the contract's damage: by crc32(`conv_id:turn`) % 20 one is dropped, emptied, left without stops, repeated, or made a user's."""
    id_and_turn = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    m = F.col("m")
    told = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(id_and_turn.cast("binary")) % 20).alias("m")).where(m != 0)
    text = F.when(m == 1, "").when(m == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = told.select("conv_id", "turn", F.when(m == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(m == 3, 2).otherwise(1).alias("copies"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.Repair(damaged(rows))
    out = rows.select("conv_id").distinct()
    for other in (found.conversations, found.transcripts()):
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    counts = (F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    def altered(doc_id: int | None, found: Counter) -> Counter:
        """The contract's slips: a run loses a letter if 31 divides the checksum of it and the document's id."""
        if doc_id is None:
            return found
        start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
        for word, n in found.items():
            h = zlib.crc32(word.encode(), start)
            out[spelling.without(word, h % len(word)) if h % 31 == 0 else word] += n
        return out

    return spelling.spelling_variants(read(spark, sf_dir, "documents"), altered=altered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_compression_quality": op3_compression_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_pu_toxicity": op7_pu_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_pivot_topk": op9_pivot_topk,
    "op10_language_id": op10_language_id,
    "op11_vector_packing": op11_vector_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op6_minhash_near_dedup": OP6_SQL, "op9_pivot_topk": OP9_SQL, "op12_conversation_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
