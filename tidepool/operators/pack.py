"""Context packs: the best hits of a query within a budget of tokens, without near-duplicates.

What a hit adds depends on those kept before it, so each query's few hits are
folded in order; queries are independent and spread over the cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import plain

#: The share of the budget that one section may take, and the fewest tokens it may have.
SHARE, FLOOR = 0.45, 64
EMPTY = "No matching documentation found. Add a source, then list what is indexed.\n"


def fold(hits: list[dict], budget: int, distinct: bool = False) -> tuple[list[dict], int, int]:
    """Sections in order, their tokens, and the tokens of the raw hits seen. hits: best first. distinct: a section that repeats another once both are cut is left out, too."""
    cap = max(FLOOR, int(budget * SHARE))
    kept: list[dict] = []
    total = raw = 0
    for hit in hits:
        raw += plain.estimate_tokens(hit["text"] or "")
        label = plain.section_label(hit["heading"], hit["title"], hit["section_path"], hit["uri"] or "")
        body = plain.strip_lead(plain.clean_body(hit["text"] or ""), label)
        if not body or any(plain.near_duplicate(k["text"], body) for k in kept):
            continue
        left = budget - total
        if left <= 0 and kept:
            break
        allowed = min(left if left > 0 else budget, cap)
        for most in (allowed * 4, max(16, (allowed - 1) * 4)):
            if plain.estimate_tokens(body) > allowed:
                body = plain.truncate(body, most)
        if distinct and any(plain.near_duplicate(k["text"], body) for k in kept):
            continue
        tokens = plain.estimate_tokens(body)
        if kept and total + tokens > budget:
            break
        total += tokens
        kept.append({"rank": len(kept) + 1, "title": hit["title"], "uri": hit["uri"], "heading": label, "text": body, "score": hit["score"], "tokens": tokens})
    return kept, total, raw


def pack(hits: DataFrame, budget: int = 2400, query: str = "query_id", distinct: bool = False) -> DataFrame:
    """One row per section: query, rank, title, uri, heading, text, score, tokens, and of the pack total_tokens, raw_tokens, saved_percent.

    hits: query, position (best first), and the columns of a hit. Positions come
    from a top-k, so a query's group is small. distinct: see fold.
    """
    kind = hits.schema[query].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("position").astype(object).where(lambda x: x.notna(), None).to_dict("records")
        kept, total, raw = fold(rows, budget, distinct)
        out = pd.DataFrame(kept, columns=["rank", "title", "uri", "heading", "text", "score", "tokens"])
        out.insert(0, query, frame[query].iloc[0])
        return out.assign(total_tokens=total, raw_tokens=raw, saved_percent=max(0, round(100 * (1 - total / raw))) if raw else 0)

    columns = [query, "position", "text", "heading", "section_path", "uri", "title", "score"]
    kinds = f"`{query}` {kind}, rank int, title string, uri string, heading string, text string, score double, tokens int, total_tokens int, raw_tokens int, saved_percent int"
    return hits.select(*columns).groupBy(query).applyInPandas(run, kinds)


def markdown(sections: DataFrame, query: str = "query_id", title: str | None = None) -> DataFrame:
    """One markdown text per query: a heading, then each section's label, place and text."""
    part = F.concat_ws("\n", F.concat(F.lit("## "), F.col("rank"), F.lit(". "), F.coalesce("heading", "title", F.lit("Excerpt"))), "uri", F.lit(""), "text", F.lit(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"])
    head = F.concat(F.lit("# "), F.col(title or query).cast("string"), F.lit("\n\n"))
    body = F.regexp_replace(F.array_join("parts", "\n"), r"\s+$", "")
    return sections.groupBy(*dict.fromkeys([query, title or query])).agg(parts.alias("parts")).select(query, F.concat(head, body, F.lit("\n")).alias("markdown"))


def as_json(sections: DataFrame, query: str = "query_id") -> DataFrame:
    """One JSON text per query with all sections and totals."""
    one = F.struct("rank", "title", "uri", "heading", "text", "score", "tokens")
    packs = sections.groupBy(query, "total_tokens", "raw_tokens", "saved_percent").agg(F.array_sort(F.collect_list(one)).alias("sections"))
    return packs.select(query, F.to_json(F.struct(F.col(query).alias("query"), "sections", "total_tokens", "raw_tokens", "saved_percent")).alias("json"))
