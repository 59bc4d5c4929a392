"""Questions to evidence in one plan: analysis, retrieval, fusion, reranking, coverage, context, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analyze, answer, fuse, gate, index
from ..sources.staging import staged

INFO = ["question", "query_type", "concepts", "terms", "metric", "requires_calculation", "is_comparison", "explicit_statement", "inferred_statement", "target_statements", "target_years", "context_limit"]


def evidence(questions: DataFrame, chunks: DataFrame, *, meta: DataFrame | None = None, dense: DataFrame | None = None, top_k: int = 12) -> DataFrame:
    """Ranked passages (qid, final_rank, chunk and evidence columns, merged text) for (qid, doc_name, question) over chunks.

    dense: scores (qid, doc_name, chunk_index, score) of a vector search, if there is one. Every cut (50, 80, top_k)
    comes before the join that widens rows.
    """
    asked = questions if "expanded_query" in questions.columns else staged(analyze.analyze(questions), "asked")
    scoped = chunks.join(asked.select("doc_name").distinct(), "doc_name", "left_semi")
    counted = staged(index.tokenized(scoped), "terms")
    posts, stats = index.postings(counted), index.corpus_stats(counted)
    terms = index.query_terms(asked, F.col("expanded_query")).join(asked.select("qid", "doc_name"), "qid")
    lists = {
        "bm25": index.search_bm25(index.bm25(terms, posts, index.term_stats(posts, stats), stats, ["doc_name"])),
        "metadata": index.ranked(index.marker_scores(asked, scoped), 50, [F.desc("score"), F.asc("chunk_index")]),
    }
    if dense is not None:
        lists["dense"] = index.search_dense(dense)
    pooled = fuse.pool(fuse.rrf(lists))
    if dense is None:
        pooled = pooled.withColumn("dense_rank", F.lit(None).cast("int"))
    # at most 80 rows a question and filing: the cut is written, so that reranking is a plan of its own
    wide = staged(fuse.enrich(pooled, scoped, meta).join(asked.select("qid", *INFO), "qid"), "pool")
    ordered = staged(fuse.rerank_order(fuse.rerank(wide)), "reranked")
    covered = fuse.ensure_coverage(ordered, top_k)
    merged = fuse.neighbours(scoped)
    return covered.join(merged, ["doc_name", "chunk_index"], "left").withColumn("text", F.coalesce("merged_text", "text")).drop("merged_text")


def ask(questions: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """qid, question, gate_status, gate_reason and the passages that the gate let through, as one row a question."""
    asked = staged(analyze.analyze(questions), "asked")
    passages = staged(evidence(asked, chunks, **options), "passages")
    verdict = gate.gate(asked, passages)
    kept = passages.where(F.col("final_rank") <= F.col("context_limit")).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("final_rank", "chunk_index", "page_num", "rerank_score"))).alias("passages"))
    return asked.select("qid", "doc_name", "question").join(verdict, "qid").join(kept, "qid", "left")


def answer_questions(questions: DataFrame, chunks: DataFrame, provider: answer.AnswerProvider, **options) -> DataFrame:
    """One row a question: gate_status, gate_reason, found, answer, page_num, sources with their locations, metrics, confidence, overall.

    Only questions that pass the gate are put to the provider; the others, and replies that hold no answer, are not
    found and have no confidence.
    """
    asked = staged(analyze.analyze(questions), "asked")
    passages = staged(evidence(asked, chunks, **options), "passages")
    verdict = staged(gate.gate(asked, passages), "verdict")
    passed = verdict.where("gate_status = 'SUFFICIENT_EVIDENCE'").select("qid")
    top = passages.where(F.col("final_rank") <= F.col("context_limit")).join(passed, "qid", "left_semi")
    contexts = gate.render_context(top).join(asked.select("qid", "question"), "qid")
    replies = staged(provider.replies(answer.prompts(contexts, gate.evidence_notes(top))), "replies")
    parsed = staged(answer.parse_answers(replies, top), "parsed")
    cited = parsed.select("qid", F.posexplode("sources").alias("at", "s")).select("qid", (F.col("at") + 1).alias("source_no"), "s.doc_name", "s.page_num", "s.evidence_text")
    enriched = answer.enrich_sources(cited, top).select("qid", F.struct("source_no", "doc_name", "page_num", "evidence_text", "location").alias("s"))
    sources = enriched.groupBy("qid").agg(F.sort_array(F.collect_list("s")).alias("sources"))
    first = F.get("sources", F.lit(0))
    best = answer.best_passages(top).join(sources.select("qid", first["location"].alias("location"), first["page_num"].alias("source_page")), "qid")
    scores = answer.score_breakdown(answer.confidence(best)).select("qid", "confidence", "answer_support", "location_accuracy", "source_reliability", "overall")
    said = parsed.select("qid", "found", "answer", "page_num", "metrics").join(sources, "qid", "left").join(scores, "qid", "left")
    return asked.select("qid", "doc_name", "question").join(verdict, "qid").join(said, "qid", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def route_questions(questions: DataFrame, meta: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(qid, question, doc_name, doc_match_score) for questions without a filing: the filings each is held against."""
    return fuse.route(fuse.match_scores(questions, meta), threshold).join(questions.select("qid", "question"), "qid")


def cross_filing(questions: DataFrame, chunks: DataFrame, meta: DataFrame, *, top_k: int = 12, threshold: float = 3.0) -> DataFrame:
    """Ranked passages of (qid, question, doc_name) over filings: in the one that is named, else in those a question is routed to.

    Each filing gives max(10, 2 * top_k) passages; the filing's match score is added to the rerank score (nothing for a named
    one), and the top_k of a question are ranked over its filings, of equals by name and place.
    """
    named = questions.where("doc_name IS NOT NULL").select("qid", "question", "doc_name", F.lit(0.0).alias("doc_match_score"))
    routed = route_questions(questions.where("doc_name IS NULL").select("qid", "question"), meta, threshold)
    # a question's search in one filing is a question of its own; the pairs are written, so their numbers stay
    pairs = staged(named.unionByName(routed.select(named.columns)).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    found = evidence(pairs.select(F.col("pair").alias("qid"), "doc_name", "question"), chunks, meta=meta, top_k=max(10, 2 * top_k))
    back = found.withColumnRenamed("qid", "pair").drop("final_rank").join(pairs.select("pair", "qid", "doc_match_score"), "pair").drop("pair")
    scored = back.withColumn("rerank_score", F.col("rerank_score") + F.col("doc_match_score"))
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "doc_name", "chunk_index")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k)
