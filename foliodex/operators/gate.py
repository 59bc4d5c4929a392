"""The evidence gate and evidence notes: rules over the first passages of each question, as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .analyze import is_comparison_for_gate


def gate(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, gate_status, gate_reason for analysed questions and their ranked passages (qid, final_rank, chunk columns, concept_matched).

    A rule is a flag that some passage sets; all flags come from one grouping by question, and the first rule
    in order that fails gives the reason.
    """
    info = ["question", "terms", "concepts", "requires_calculation", "explicit_statement", "target_statements", "target_years", "query_type", "is_comparison", "context_limit"]
    asked = questions.select("qid", *info).withColumns({"_groups": F.filter(tx.gate_terms(F.col("question")), lambda t: ~F.array_contains(_metric_tokens(), t)), "_compares": is_comparison_for_gate(F.col("question"))})
    first = passages.drop(*[c for c in info if c in passages.columns]).join(asked, "qid").where(F.col("final_rank") <= F.col("context_limit"))
    text, title, search = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("table_title", F.lit(""))), F.col("_search")
    first = first.withColumn("_search", tx.search_text())
    statement = F.coalesce("statement_type", F.lit("OTHER"))
    wanted = F.filter(lx.concept_literal(), lambda c: F.array_contains("concepts", c["id"]))
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), lx.PLACE_NUMBER, "")
    figures = F.regexp_extract_all(clean, F.lit(f"({lx.NUMBER_IN_TEXT})"), 1)
    flags = first.groupBy("qid").agg(
        F.count("*").alias("n"),
        F.bool_or(F.exists("terms", lambda t: text.contains(t) | title.contains(t))).alias("concept"),
        F.array_distinct(F.flatten(F.collect_list(F.transform(F.filter(wanted, lambda c: F.exists(c["keywords"], lambda k: search.contains(k))), lambda c: c["id"])))).alias("inputs"),
        F.bool_or((statement == F.col("explicit_statement")) | F.upper(F.coalesce("section", F.lit(""))).contains(F.col("explicit_statement")) | F.coalesce("concept_matched", F.lit(False))).alias("statement"),
        F.collect_set("statement_type").alias("statements"),
        F.array_distinct(F.flatten(F.collect_list(F.filter("_groups", lambda t: search.contains(t))))).alias("groups"),
        F.bool_or(tx.any_in(search, lx.PURPOSE_EVIDENCE)).alias("purpose"),
        F.bool_or(F.exists("target_years", lambda y: search.contains(y))).alias("period"),
        F.bool_or(F.exists(figures, lambda n: ~F.array_contains("target_years", n)) | clean.contains("$") | clean.contains("(")).alias("value"),
    )
    df = asked.join(flags, "qid", "left")
    named = (F.size("terms") > 0) | (F.size("concepts") > 0)
    missing_inputs = F.filter("concepts", lambda c: ~F.array_contains("inputs", c))
    missing_statements = F.array_except("target_statements", "statements")
    need = F.when(F.size("_groups") <= 2, 1).otherwise(2)
    concepts = F.when(F.size("concepts") > 0, F.array_join("concepts", ", ")).otherwise("requested concept")
    reason = (
        F.when(F.col("n").isNull(), F.lit(lx.NO_CANDIDATES))
        .when(named & ~F.col("concept"), _failed("Concept Rule", concepts))
        .when(named & F.col("requires_calculation") & (F.size("concepts") > 1) & (F.size(missing_inputs) > 0), _failed("Calculation Inputs", F.array_join(missing_inputs, ", ")))
        .when((F.col("explicit_statement") != "ANY") & ~F.col("statement"), _failed("Statement Rule", F.col("explicit_statement")))
        .when(F.col("requires_calculation") & (F.size(missing_statements) > 0), _failed("Calculation Statements", F.array_join(missing_statements, ", ")))
        .when(F.col("_compares") & (F.size("_groups") > 0) & (F.size("groups") < need), _failed("Comparison Rule"))
        .when((F.col("query_type") == "DOCUMENT_PURPOSE") & ~F.col("purpose"), _failed("Document Purpose Rule"))
        .when((F.size("target_years") > 0) & ~F.col("period"), _failed("Period Rule", F.array_join("target_years", ", ")))
        .when(F.col("query_type").isin("NUMERIC_LOOKUP", "CALCULATION") & ~F.col("value"), _failed("Value Rule"))
    )
    passed = F.when(F.col("query_type") == "DOCUMENT_PURPOSE", lx.PURPOSE_PASSED).when(F.col("_compares"), lx.COMPARISON_PASSED).otherwise(lx.ALL_PASSED)
    status = F.when(F.col("n").isNull(), "NO_EVIDENCE").when(reason.isNotNull(), "WEAK_EVIDENCE").otherwise("SUFFICIENT_EVIDENCE")
    return df.select("qid", status.alias("gate_status"), F.coalesce(reason, passed).alias("gate_reason"))


def _failed(rule: str, missing: Column | None = None) -> Column:
    """The reason that a rule failed, with what is missing in its place."""
    before, _, after = f"Rule Failed [{rule}]: {lx.GATE_REASONS[rule]}".partition("{}")
    return F.lit(before) if missing is None else F.concat(F.lit(before), missing, F.lit(after))


def _metric_tokens() -> Column:
    """Gate terms of the accounting wordings that stand in the question."""
    return F.flatten(F.transform(F.filter("terms", lambda t: F.lower("question").contains(t)), lambda t: tx.gate_terms(t)))


def line_score(line: Column) -> Column:
    low = F.lower(line)
    return (
        4 * F.exists("target_years", lambda y: low.contains(y)).cast("int")
        + 5 * F.exists("terms", lambda t: low.contains(t)).cast("int")
        + 3 * ((F.size("concepts") > 0) & low.contains(F.lower("metric"))).cast("int")
        + 2 * line.rlike(lx.NOTE_NUMBER).cast("int")
        + tx.any_in(low, lx.EVIDENCE_WORDS).cast("int")
    )


def evidence_notes(passages: DataFrame, per_chunk: int = 3, most: int = 12) -> DataFrame:
    """qid, note_no, page_num, line, score, years, values: the best lines of the best passages, each (page, line) once."""
    rows = passages.select(
        "qid", "final_rank", "page_num", "chunk_type", "section", "table_title", "units", "target_years", "terms", "concepts", "metric", F.posexplode(tx.lines(F.col("text"))).alias("at", "line")
    ).withColumn("score", line_score(F.col("line")))
    best = rows.where("score > 0").withColumn("k", F.row_number().over(Window.partitionBy("qid", "final_rank").orderBy(F.desc("score"), "at"))).where(F.col("k") <= per_chunk)
    once = best.withColumn("d", F.row_number().over(Window.partitionBy("qid", "page_num", "line").orderBy("final_rank", "k"))).where("d = 1")
    numbered = once.withColumn("note_no", F.row_number().over(Window.partitionBy("qid").orderBy("final_rank", "k"))).where(F.col("note_no") <= most)
    return numbered.select(
        "qid", "note_no", "page_num", F.upper(F.coalesce("chunk_type", F.lit("text"))).alias("evidence_type"), F.substring("line", 1, 500).alias("line"), "score",
        F.array_join(F.array_distinct(F.regexp_extract_all("line", F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), 1)), ", ").alias("years"),
        F.array_join(F.array_distinct(F.regexp_extract_all("line", F.lit(f"({lx.NOTE_NUMBER})"), 1)), ", ").alias("values"),
    )


def render_context(passages: DataFrame, most_chars: int = 3000) -> DataFrame:
    """qid, context: the passages of each question as one text, the first marked as primary."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    label = lambda tag, name, skip="": F.when((c(name) != "") & (c(name) != skip), F.concat(F.lit(f"{tag}: "), c(name)))
    head = F.concat_ws(
        " | ", F.concat(F.lit("Passage "), F.col("final_rank")), F.when(F.col("final_rank") == 1, "PRIMARY ANSWER-BEARING EVIDENCE").otherwise("SUPPORTING CONTEXT"), F.concat(F.lit("DOCUMENT: "), F.col("doc_name")),
        label("COMPANY", "company", "Unknown Company"), label("FILING_TYPE", "filing_type", "Filing"), label("FILING_PERIOD", "fiscal_year", "Unknown"), label("SECTION", "section"), label("SUBSECTION", "subsection"),
        label("STATEMENT_TITLE", "statement_title"), label("STATEMENT", "statement_type"), label("TYPE", "chunk_type"), label("TABLE", "table_title"), label("TABLE_CONTEXT", "table_context"), label("UNIT", "units"),
        F.concat(F.lit("PAGE: "), F.coalesce(F.col("page_num").cast("string"), F.lit("?"))),
    )
    text = F.when(F.length("text") > most_chars, F.concat(F.substring("text", 1, most_chars), F.lit(" ...[truncated]"))).otherwise(c("text"))
    one = F.struct(F.col("final_rank"), F.concat(F.lit("["), head, F.lit("]\n"), text).alias("passage"))
    return passages.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["passage"]), "\n\n").alias("context"))
