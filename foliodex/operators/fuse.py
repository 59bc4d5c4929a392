"""Rank fusion, reranking, statement coverage, neighbour context and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .analyze import is_comparison_intent

KEY = ["qid", "doc_name", "chunk_index"]
RRF_K, POOL = 60, 80
WEIGHTS = {"bm25": 1.0, "metadata": 0.9, "dense": 1.0}


def rrf(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """KEY, rrf and a rank per list (1-based, null if absent): one union and one aggregation, no chain of joins."""
    weights = WEIGHTS | (weights or {})
    parts = [df.select(*KEY, F.lit(name).alias("list"), "rank", (F.lit(weights[name]) / (k + F.col("rank"))).alias("part")) for name, df in lists.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*KEY).agg(F.round(F.sum("part"), 9).alias("rrf"), *[F.max(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists])


def pool(fused: DataFrame, k: int = POOL) -> DataFrame:
    """The k best of each question and filing; ties by the lists' ranks in their order."""
    ranks = [F.asc_nulls_last(c) for c in fused.columns if c.endswith("_rank")]
    order = Window.partitionBy("qid", "doc_name").orderBy(F.desc("rrf"), *ranks, F.asc("chunk_index"))
    return fused.withColumn("rrf_order", F.row_number().over(order)).where(F.col("rrf_order") <= k)


def enrich(candidates: DataFrame, chunks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Candidates with their chunk's columns and their filing's metadata, with defaults where it is missing."""
    out = candidates.join(chunks, ["doc_name", "chunk_index"])
    part = F.get(F.split("doc_name", "_"), F.lit(0))
    if meta is None:
        return out.withColumns({"company": part, "filing_type": F.lit("Filing"), "fiscal_year": F.lit(""), "source_filename": F.lit("")})
    out = out.join(meta, "doc_name", "left")
    return out.withColumns({"company": F.coalesce("company", part), "filing_type": F.coalesce("filing_type", F.lit("Filing")), "fiscal_year": F.coalesce("fiscal_year", F.lit("")), "source_filename": F.coalesce("source_filename", F.lit(""))})


def _if(ok: Column, value: float) -> Column:
    return F.when(ok, F.lit(value)).otherwise(F.lit(0.0))


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def structure_features(df: DataFrame) -> DataFrame:
    """Boosts by the terms that group or name what is asked; needs question, analysis and chunk columns and concept_matched."""
    df = df.withColumns({"_text": _lower("text"), "_meta": tx.metadata_text(), "_asked": tx.distinctive(F.col("question"))})
    q = F.lower("question")
    named = F.filter("terms", lambda t: q.contains(t))
    metric = F.array_distinct(F.flatten(F.transform(named, lambda t: tx.distinctive(t))))
    ident = F.filter(F.flatten(F.array(*[tx.identity_tokens(F.col(c)) for c in ("doc_name", "company", "filing_type", "source_filename", "fiscal_year")])), lambda t: ~t.rlike("^[0-9]+$"))
    df = df.withColumns({"metric_terms": metric, "_ident": ident})
    df = df.withColumn("grouping_terms", F.filter("_asked", lambda t: ~F.array_contains("metric_terms", t) & ~F.array_contains("_ident", t)))
    df = df.withColumns(
        {
            "_in_meta": F.filter("grouping_terms", lambda t: F.col("_meta").contains(t)),
            "_in_body": F.filter("grouping_terms", lambda t: F.col("_text").contains(t)),
            "metric_matches": F.filter("metric_terms", lambda t: F.concat_ws(" ", "_meta", "_text").contains(t)),
            "comparison_intent": is_comparison_intent(F.col("question")),
        }
    )
    matched = F.size(F.array_union("_in_meta", "_in_body"))
    table = F.col("chunk_type") == "table"
    df = df.withColumns(
        {
            "grouping_coverage": matched / F.greatest(F.lit(1), F.size("grouping_terms")),
            "metric_matched": (F.size("metric_matches") > 0) | F.col("concept_matched"),
            "_matched": matched,
            "query_term_boost": F.least(F.lit(20.0), F.size("_in_meta") * 6.0 + F.size("_in_body") * 2.0),
            "_header": table & (F.size(F.array_union("_in_meta", "metric_matches")) > 0),
            "filing_purpose_matches": F.when(F.col("query_type") == "DOCUMENT_PURPOSE", F.filter(lx.strings(lx.PURPOSE_EVIDENCE), lambda m: F.concat_ws(" ", "_meta", "_text").contains(m))).otherwise(F.array().cast("array<string>")),
        }
    )
    compare = F.col("comparison_intent")
    return df.withColumns(
        {
            "table_header_boost": _if(F.col("_header"), 15.0) + _if(F.col("_header") & (F.col("_matched") > 0), 10.0),
            "comparison_dimension_boost": _if(compare & F.col("metric_matched") & (F.col("grouping_coverage") >= 0.25), 35.0)
            + F.when(compare & table & F.col("metric_matched") & (F.col("_matched") > 0), 20.0).when(compare & (F.col("_matched") == 0), -10.0).otherwise(0.0),
            "filing_purpose_boost": F.when(F.size("filing_purpose_matches") > 0, F.least(F.lit(35.0), 12.0 + F.size("filing_purpose_matches") * 5.0)).otherwise(0.0),
        }
    ).drop("_asked", "_ident", "_in_meta", "_in_body", "_header", "_matched", "_meta", "_text")


def rerank(candidates: DataFrame) -> DataFrame:
    """Candidates with their evidence columns and rerank_score, in one projection after the pool's cut.

    Needs question and analysis columns, chunk columns, rrf, bm25_rank and dense_rank.
    """
    text, title = _lower("text"), _lower("table_title")
    body = F.replace(F.replace(F.concat_ws(" ", title, text), F.lit("shee t"), F.lit("sheet")), F.lit("flow s"), F.lit("flows"))
    df = candidates.withColumns(
        {
            "_body": body,
            "concept_matched": F.when(F.size("terms") > 0, F.exists("terms", lambda t: text.contains(t) | title.contains(t))).otherwise(F.size("concepts") > 0),
            "has_period_match": F.exists("target_years", lambda y: text.contains(y)),
            "has_numeric_value": F.coalesce(F.col("text"), F.lit("")).rlike(lx.NUMBER_IN_TEXT),
        }
    )
    df = structure_features(df)
    b, statement, explicit = F.col("_body"), F.coalesce("statement_type", F.lit("OTHER")), F.col("explicit_statement")
    requested = (F.size("concepts") > 0) | (F.size("terms") > 0)
    table = F.col("chunk_type") == "table"
    agreement = F.when(F.col("bm25_rank").isNotNull() & F.col("dense_rank").isNotNull(), 20.0).when(table & (F.col("bm25_rank") <= 10), 15.0).otherwise(0.0)
    content = 100.0 * F.col("rrf") + _if(F.col("concept_matched"), 60.0) + _if(requested & ~F.col("concept_matched"), -40.0) + _if(F.col("has_period_match"), 20.0) + _if(F.col("has_numeric_value"), 20.0) + agreement
    has = b.contains
    primary = (
        F.when(explicit == "BALANCE_SHEET", has("consolidated balance sheet") | (has("current assets") & has("total assets") & has("total liabilities")))
        .when(explicit == "CASH_FLOW_STATEMENT", has("consolidated statement of cash flows") | (has("cash flows from operating activities") & has("cash flows from investing activities")))
        .when(explicit == "INCOME_STATEMENT", has("consolidated statement of income") | has("consolidated statement of operations"))
        .otherwise(F.lit(False))
    )
    asked_for = (statement == explicit) | F.upper(F.coalesce("section", F.lit(""))).contains(explicit)
    by_statement = F.when(explicit != "ANY", _if(asked_for, 25.0) + _if(primary, 60.0)).otherwise(_if((F.col("inferred_statement") != "ANY") & (statement == F.col("inferred_statement")), 15.0))
    by_target = F.when(F.size("target_statements") == 0, 0.0).when(F.array_contains("target_statements", statement), 35.0).when(statement.isin("EQUITY_STATEMENT", "RISK_FACTORS", "BUSINESS"), -45.0).when((statement == "FOOTNOTES") & F.col("requires_calculation"), -20.0).otherwise(0.0)
    which = tx.any_in(F.lower("question"), lx.WHICH_GROUP)
    by_group = F.when(which, _if(_lower("subsection").rlike(r"^\s*note\s+\d+\b"), -30.0) + _if(has("segment result"), 30.0)).otherwise(0.0)
    boosts = sum((F.col(c) for c in ("table_header_boost", "comparison_dimension_boost", "filing_purpose_boost")), F.col("query_term_boost"))
    meta = by_statement + by_target + _if(F.col("requires_calculation") & tx.any_in(b, lx.UNRELATED), -25.0) + _if(F.col("query_type").isin("NUMERIC_LOOKUP", "CALCULATION") & table, 15.0) + by_group + boosts
    return df.withColumns(
        {
            "agreement_boost": agreement,
            "concept_penalty": _if(requested & ~F.col("concept_matched"), 40.0),
            "content_evidence_score": F.greatest(F.lit(0.0), content),
            "metadata_boost": meta,
            "rerank_score": F.round(content + meta, 6),
        }
    ).drop("_body")


def rerank_order(df: DataFrame) -> DataFrame:
    return df.withColumn("rerank_order", F.row_number().over(Window.partitionBy("qid", "doc_name").orderBy(F.desc("rerank_score"), F.asc("rrf_order"))))


def blend_cross_encoder(df: DataFrame, logit: Column, first: int = 30, weight: float = 30.0) -> DataFrame:
    """The first candidates reordered by rerank score + weight * sigmoid(model logit); the tail stays behind them."""
    head = F.col("rerank_order") <= first
    final = F.when(head, F.col("rerank_score") + weight / (1 + F.exp(-logit)))
    df = df.withColumn("final_score", F.coalesce(final, F.col("rerank_score")))
    return df.withColumn("final_order", F.row_number().over(Window.partitionBy("qid", "doc_name").orderBy(F.desc(head), F.desc(F.when(head, F.col("final_score"))), F.asc("rerank_order"))))


def ensure_coverage(ordered: DataFrame, top_k: int) -> DataFrame:
    """The top_k of each question and filing, with the best chunk of every statement a calculation needs.

    Missing statements come in the order they are asked for. While there is room they are appended; after that each takes
    the last place, so a second one puts the first one out, as the gate's rule expects.
    """
    top = ordered.where(F.col("rerank_order") <= top_k)
    group = ["qid", "doc_name"]
    held = top.groupBy(*group).agg(F.collect_set("statement_type").alias("held"), F.count("*").alias("n"), F.first("target_statements").alias("wanted"), F.first("requires_calculation").alias("calc"))
    short = held.where("calc and size(wanted) >= 2").select(*group, "n", F.posexplode(F.filter("wanted", lambda s: ~F.array_contains("held", s))).alias("nth", "statement_type"))
    best = ordered.withColumn("k", F.row_number().over(Window.partitionBy(*group, "statement_type").orderBy("rerank_order"))).where("k = 1").drop("k")
    extra = best.join(short, [*group, "statement_type"]).withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy("nth"))).withColumn("turns", F.count("*").over(Window.partitionBy(*group)))
    place = F.least(F.col("n") + F.col("turn"), F.lit(top_k))
    extra = extra.withColumn("place", place)
    # of those that take one place the last stays
    extra = extra.withColumn("last_turn", F.max("turn").over(Window.partitionBy(*group, "place"))).where("turn = last_turn")
    taken = extra.select(*group, F.col("place").alias("rerank_order"))
    kept = top.join(taken, [*group, "rerank_order"], "left_anti").withColumn("final_rank", F.col("rerank_order")).withColumn("backfilled", F.lit(False))
    added = extra.withColumn("final_rank", F.col("place")).withColumn("backfilled", F.lit(True))
    return kept.unionByName(added.select(*kept.columns))


def neighbours(chunks: DataFrame, window: int = 1) -> DataFrame:
    """doc_name, chunk_index, merged_text: a chunk's text with those next to it in its section or on its page, each text once."""
    w = Window.partitionBy("doc_name").orderBy("chunk_index")
    near = []
    for step in range(-window, window + 1):
        other = (lambda c, s=step: F.col(c) if s == 0 else F.lag(c, -s).over(w) if s < 0 else F.lead(c, s).over(w))
        same = other("section").eqNullSafe(F.col("section")) | other("page_num").eqNullSafe(F.col("page_num"))
        near.append(F.when(other("chunk_index").isNotNull() & same, F.coalesce(other("text"), F.lit(""))))
    texts = F.array_distinct(F.filter(F.array(*near), lambda x: x.isNotNull()))
    return chunks.select("doc_name", "chunk_index", F.array_join(texts, "\n\n").alias("merged_text"))


def match_scores(questions: DataFrame, meta: DataFrame) -> DataFrame:
    """qid, doc_name, doc_match_score of every question and filing (filing metadata is the small, bounded side)."""
    q = F.lower("question")
    asked = questions.select("qid", "question", q.alias("_q"), F.array_union(tx.identity_tokens(F.col("question")), tx.years(F.col("question"))).alias("_tokens"), tx.years(F.col("question")).alias("_years"))
    year = _lower("fiscal_year")
    own = tx.years(year)
    filings = meta.select(
        "doc_name",
        F.lower("doc_name").alias("_doc"),
        F.lower(tx.company_name(F.col("company"))).alias("_company"),
        _lower("filing_type").alias("_type"),
        F.regexp_replace(_lower("source_filename"), r"(?<=.)\.[^.]*$", "").alias("_stem"),
        F.when((F.size(own) == 0) & (year != ""), tx.years(F.lower("doc_name"))).otherwise(own).alias("_own_years"),
    )
    both = asked.crossJoin(filings)
    hits = lambda tokens: F.size(F.filter(tokens, lambda t: F.array_contains("_tokens", t))).cast("double")
    has = lambda c: (F.col(c) != "") & F.col("_q").contains(F.col(c))
    compact = F.replace("_type", F.lit("-"), F.lit(""))
    score = (
        _if(has("_doc"), 10.0)
        + _if(has("_stem"), 8.0)
        + _if(has("_company") & (F.col("_company") != "unknown company") & F.col("_company").contains(" "), 6.0)
        + 3.0 * hits(tx.identity_tokens(F.col("_company")))
        + hits(tx.identity_tokens(F.col("_doc")))
        + 1.5 * F.size(F.array_intersect("_own_years", "_years"))
        + _if(has("_type"), 1.0)
        + _if((compact != "") & F.col("_q").contains(compact), 1.0)
    )
    return both.select("qid", "doc_name", score.alias("doc_match_score"))


def route(scores: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Each question's filings: those with the best score if it reaches the threshold, else all."""
    best = F.max("doc_match_score").over(Window.partitionBy("qid"))
    return scores.withColumn("_best", best).where((F.col("_best") < threshold) | (F.col("doc_match_score") == F.col("_best"))).drop("_best")
