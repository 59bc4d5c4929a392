"""Model replies to answers: parsing, metrics, citations, confidence, and the provider interface."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

SOURCE = "array<struct<doc_name: string, page_num: int, evidence_text: string>>"


class AnswerProvider(Protocol):
    """Writes a reply to each prompt; called on the driver's side, outside executors."""

    def replies(self, prompts: DataFrame) -> DataFrame:
        """(qid, reply) for (qid, prompt)."""


class TableProvider:
    """Replies from a table, for tests and replays."""

    def __init__(self, table: DataFrame):
        self.table = table

    def replies(self, prompts: DataFrame) -> DataFrame:
        return prompts.join(self.table.select("qid", "reply"), "qid", "left").select("qid", "reply")


def prompts(contexts: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(qid, prompt): the task, the reply's form, the notes and the evidence of each question (own wording)."""
    task = (
        "Answer from the evidence alone. Write ANSWER: and the answer, or ANSWER: NOT_FOUND if the evidence does not hold it; then CALCULATION: and ANALYSIS: if they help; then one line "
        'SOURCE: [document] Page n - "quote" for each passage used; then METRICS: with lines label: .. | value: .. | period: .. | note: ..'
    )
    out = contexts
    if notes is not None:
        lines = notes.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("note_no", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("notes"))
        out = out.join(lines, "qid", "left")
    else:
        out = out.withColumn("notes", F.lit(None).cast("string"))
    return out.select("qid", F.concat_ws("\n\n", F.lit(task), F.concat(F.lit("QUESTION: "), F.col("question")), F.concat(F.lit("NOTES\n"), F.col("notes")), F.col("context")).alias("prompt"))


def metrics(reply: Column) -> Column:
    """The rows of a reply's METRICS block: label and value, perhaps period and note; at most six."""
    block = F.regexp_extract(reply, lx.REPLY_METRICS, 1)
    rows = F.transform(F.split(block, "\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-•*]+", "")))

    def fields(line: Column) -> Column:
        def of(name: str) -> Column:
            hits = F.filter(F.split(line, r"\|"), lambda p: (F.lower(F.trim(F.substring_index(p, ":", 1))) == name) & p.contains(":") & (F.trim(F.regexp_replace(p, "(?s)^[^:]*:", "")) != ""))
            return F.substring(F.trim(F.regexp_replace(F.element_at(F.when(F.size(hits) > 0, hits), -1), "(?s)^[^:]*:", "")), 1, 80)

        return F.struct(*[of(n).alias(n) for n in ("label", "value", "period", "note")])

    return F.slice(F.filter(F.transform(rows, fields), lambda m: m["label"].isNotNull() & m["value"].isNotNull()), 1, 6)


def parse_answers(replies: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, found, answer, page_num, evidence_text, sources, metrics of (qid, reply), with (qid, final_rank, doc_name, page_num, text)."""
    top = passages.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("final_rank", "doc_name", "page_num", "text"))).alias("top"))
    df = replies.join(top, "qid", "left").withColumn("_r", F.trim(F.coalesce("reply", F.lit(""))))
    r = F.col("_r")
    answer = F.trim(F.regexp_extract(r, lx.REPLY_ANSWER, 1))
    head = F.upper(F.rtrim(F.trim(F.substring_index(answer, "\n", 1)), F.lit(".:")))
    group = lambda pattern, n: F.regexp_extract_all(r, F.lit(pattern), F.lit(n))
    trio = F.arrays_zip(group(lx.REPLY_PAGE_SOURCE, 1).alias("doc"), group(lx.REPLY_PAGE_SOURCE, 2).alias("page"), group(lx.REPLY_PAGE_SOURCE, 3).alias("quote"))
    by_page = F.transform(trio, lambda x: F.struct(F.when(F.trim(x["doc"]) != "", F.trim(x["doc"])).alias("doc_name"), x["page"].cast("int").alias("page_num"), F.trim(x["quote"]).alias("evidence_text")))
    pairs = F.filter(F.arrays_zip(group(lx.REPLY_PASSAGE_SOURCE, 1).alias("n"), group(lx.REPLY_PASSAGE_SOURCE, 2).alias("quote")), lambda x: x["n"].cast("int").between(1, F.size("top")))
    by_place = F.transform(pairs, lambda x: F.struct(F.get("top", x["n"].cast("int") - 1)["doc_name"].alias("doc_name"), F.get("top", x["n"].cast("int") - 1)["page_num"].cast("int").alias("page_num"), F.trim(x["quote"]).alias("evidence_text")))
    best = F.get("top", F.lit(0))
    from_top = F.array(F.struct(best["doc_name"].alias("doc_name"), best["page_num"].cast("int").alias("page_num"), F.substring(F.coalesce(best["text"], F.lit("")), 1, 150).alias("evidence_text")))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("doc_name"), F.lit(1).alias("page_num"), F.substring(answer, 1, 100).alias("evidence_text")))
    df = df.withColumns({"answer": answer, "found": (answer != "") & (head != "NOT_FOUND"), "_pages": by_page.cast(SOURCE), "_places": F.coalesce(by_place.cast(SOURCE), F.array().cast(SOURCE))})
    sources = F.when(F.size("_pages") > 0, F.col("_pages")).when(F.size("_places") > 0, F.col("_places")).when(best.isNotNull(), from_top.cast(SOURCE)).otherwise(bare.cast(SOURCE))
    df = df.withColumn("sources", F.when(F.col("found"), sources).otherwise(F.array().cast(SOURCE)))
    first = F.get("sources", F.lit(0))
    return df.select(
        "qid", "found", F.when(F.col("found"), F.col("answer")).alias("answer"), first["page_num"].alias("page_num"), first["evidence_text"].alias("evidence_text"), "sources",
        F.when(F.col("found"), metrics(r)).alias("metrics"), F.when(F.col("found"), "answer").otherwise("abstained or unparseable").alias("parser_decision"),
    )


def best_passages(passages: DataFrame) -> DataFrame:
    """The passage of each question with the strongest evidence; of equals the first."""
    keys = [F.desc(F.coalesce(F.col(c), F.lit(False))) for c in ("concept_matched", "has_period_match", "has_numeric_value")] + [F.desc("content_evidence_score"), F.desc("rerank_score"), F.asc("final_rank")]
    return passages.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(*keys))).where("_k = 1").drop("_k")


def confidence(best: DataFrame) -> DataFrame:
    """best with confidence: 0.98 with concept, period and value, 0.95 with the concept or a score over 40, else 0.90."""
    return best.withColumn("confidence", _support(0.98, 0.95, 0.90))


def _support(all_three: float, strong: float, else_: float) -> Column:
    return F.when(F.col("concept_matched") & F.col("has_period_match") & F.col("has_numeric_value"), all_three).when(F.col("concept_matched") | (F.col("content_evidence_score") > 40), strong).otherwise(else_)


def score_breakdown(best: DataFrame) -> DataFrame:
    """Support, location and reliability of an answer and their blend; needs location and source_page of its first source."""
    structured = F.lower(F.coalesce("chunk_type", F.lit(""))).isin("table", "statement", "financial_statement") | (F.coalesce("statement_type", F.lit("")) != "")
    paged = F.coalesce("page_num", F.lit(0)) != 0
    source_paged = F.coalesce("source_page", F.lit(0)) != 0
    df = best.withColumns(
        {
            "answer_support": _support(0.99, 0.95, 0.88),
            "location_accuracy": F.when((F.coalesce("location", F.lit("")) != "") & source_paged, 0.98).when(source_paged, 0.80).otherwise(0.45),
            "source_reliability": F.when(paged & structured, 1.0).when(paged, 0.90).otherwise(0.70),
        }
    )
    return df.withColumn("overall", F.round(0.5 * F.col("answer_support") + 0.3 * F.col("location_accuracy") + 0.2 * F.col("source_reliability"), 2))


def location() -> Column:
    """Where in its filing a chunk stands, from section, subsection and title, without generic labels."""
    section, sub = F.trim(F.coalesce("section", F.lit(""))), F.trim(F.coalesce("subsection", F.lit("")))
    title = F.trim(F.coalesce(F.when(F.col("statement_title") != "", F.col("statement_title")), F.when(F.col("table_title") != "", F.col("table_title"))))
    keep = lambda x: F.when(~F.lower(x).isin(*lx.GENERIC_LABELS), x)
    parts = F.array_distinct(F.filter(F.array(keep(section), keep(sub), title), lambda x: x.isNotNull()))
    joined = F.array_join(parts, " — ")
    return F.when(F.size(parts) > 0, F.when(F.length(joined) > 110, F.concat(F.substring(joined, 1, 110), F.lit("…"))).otherwise(joined))


def enrich_sources(sources: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, source_no, doc_name, page_num, evidence_text) with the filing and location of the passage that each one quotes.

    A location is stated only where the passage holds a third of the quote's words; of passages with the same score the first counts.
    """
    bare = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")
    src = sources.select("qid", "source_no", F.col("doc_name").alias("said_doc"), F.col("page_num").alias("said_page"), "evidence_text", F.array_distinct(tx.norm_words(F.col("evidence_text"))).alias("_words"), F.substring(bare(F.col("evidence_text")), 1, 18).alias("_frag"))
    both = src.join(passages, "qid", "left")
    text, want, have = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.trim(F.coalesce("said_doc", F.lit("")))), F.lower(F.trim(F.coalesce("doc_name", F.lit(""))))
    overlap = F.when(F.size("_words") > 0, F.size(F.filter("_words", lambda w: text.contains(w))) / F.size("_words")).otherwise(0.0)
    quoted = (F.length("_frag") >= 10) & bare(F.col("text")).contains(F.col("_frag"))
    score = (
        F.when(F.col("page_num") == F.col("said_page"), 5.0).otherwise(0.0) + F.when((want != "") & (have != "") & (have.contains(want) | want.contains(have)), 4.0).otherwise(0.0)
        + 6 * overlap + F.when(quoted, 3.0).otherwise(0.0) + F.when(F.lower(F.coalesce("chunk_type", F.lit(""))).isin("table", "statement", "financial_statement"), 0.5).otherwise(0.0)
    )
    scored = both.withColumns({"match_score": F.round(score, 6), "overlap": F.when(quoted, F.greatest(overlap, F.lit(0.5))).otherwise(overlap), "_location": location()})
    best = scored.withColumn("_k", F.row_number().over(Window.partitionBy("qid", "source_no").orderBy(F.desc("match_score"), "final_rank"))).where("_k = 1")
    matched = F.col("match_score") > 0
    return best.select("qid", "source_no", F.coalesce("said_doc", F.when(matched, F.col("doc_name"))).alias("doc_name"), F.col("said_page").alias("page_num"), "evidence_text", "match_score", F.round("overlap", 6).alias("overlap"), F.when(matched & (F.col("overlap") >= 0.34), F.col("_location")).alias("location"))


def apply_order(n: int, reply: Column) -> Column:
    """A judge's reply as an order of 1..n: the numbers it names, each once, then the others in place."""
    named = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(reply, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int")), lambda x: x.between(1, n)))
    return F.array_union(named, F.sequence(F.lit(1), F.lit(n)))


def server_sent(df: DataFrame) -> DataFrame:
    """Rows as server-sent events."""
    return df.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("event"))
