"""Question analysis: type, concepts, statements, periods, units, and query expansion, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

EMPTY = F.array  # array() literal


def _none() -> Column:
    return F.array().cast("array<string>")


def _first_of(text: Column, lines, default: str) -> Column:
    out = F
    for name, words in lines:
        out = out.when(tx.any_in(text, words), F.lit(name))
    return out.otherwise(F.lit(default))


def question_type(q: Column) -> Column:
    """The type of a lower-cased question: purpose first, then the first type with two markers, then the first with one."""
    strong, weak = F, F
    for name, words in lx.TYPES:
        hits = F.size(F.filter(lx.strings(words), lambda w: q.contains(w)))
        strong = strong.when(hits >= 2, F.lit(name))
        weak = weak.when(hits >= 1, F.lit(name))
    purpose = tx.any_in(q, lx.PURPOSE_QUESTION) & tx.any_in(q, lx.PURPOSE_FILING)
    return F.when(purpose, "DOCUMENT_PURPOSE").otherwise(F.coalesce(strong, weak.otherwise(F.lit("GENERAL"))))


def concepts(q: Column) -> Column:
    """The concepts (id, statement, keywords) that a lower-cased question names by a substring, in lexicon order."""
    return F.filter(lx.concept_literal(), lambda c: F.exists(c["keywords"], lambda k: q.contains(k)))


def ratio(q: Column) -> Column:
    """The first derived ratio that a question names: (name, formula, concepts), or null."""
    out = F
    for name, aliases, needs, formula in lx.RATIOS:
        out = out.when(tx.any_in(q, aliases), F.struct(F.lit(name).alias("name"), F.lit(formula).alias("formula"), lx.concept_literal(needs).alias("inputs")))
    return out


def company(question: Column) -> Column:
    owner = F.regexp_extract(question, r"\b([A-Z][A-Za-z0-9&.\-]{1,30})'s\b", 1)
    caps = F.filter(F.regexp_extract_all(question, F.lit(r"(\b[A-Z][A-Z0-9&.-]{1,12}\b)"), 1), lambda t: ~t.isin(*lx.NOT_COMPANIES) & ~t.rlike("^20[0-9]{2}$"))
    return F.when(owner != "", owner).otherwise(F.coalesce(F.get(caps, F.lit(0)), F.lit("")))


def analyze(questions: DataFrame, question_col: str = "question") -> DataFrame:
    """questions with the columns of a question's analysis; an empty or null question is GENERAL."""
    raw = F.coalesce(F.col(question_col), F.lit(""))
    df = questions.withColumn("_q", F.lower(raw)).withColumns({"_type": question_type(F.col("_q")), "_found": concepts(F.col("_q")), "_ratio": ratio(F.col("_q"))})
    q, kind, found, named = F.col("_q"), F.col("_type"), F.col("_found"), F.col("_ratio")
    has_ratio = named.isNotNull()
    inputs = F.coalesce(named["inputs"], F.filter(found, lambda c: F.lit(False)))
    is_calculation = kind == "CALCULATION"
    prior = tx.any_in(q, lx.PRIOR_YEAR)
    stated = F.array_distinct(F.regexp_extract_all(q, F.lit(r"\b(?:fy)?(20[0-9]{2})\b"), 1))
    compared = F.when(prior, F.array_distinct(F.filter(F.transform(stated, lambda y: (y.cast("int") - 1).cast("string")), lambda y: ~F.array_contains(stated, y)))).otherwise(_none())
    both = F.concat(found, inputs)
    inferred = F.coalesce(F.get(both, F.lit(0))["statement"], F.lit("ANY"))
    explicit = _first_of(q, lx.EXPLICIT_STATEMENTS, "ANY")
    one = lambda ok, value: F.when(ok, F.array(value)).otherwise(_none())
    df = df.withColumns(
        {
            "query_type": F.when(has_ratio & ~kind.isin("CALCULATION", "COMPARISON", "TREND"), "CALCULATION").otherwise(kind),
            "requires_calculation": is_calculation | has_ratio,
            "is_comparison": F.when(is_calculation, tx.any_in(q, lx.CALCULATION_COMPARES)).otherwise(kind.isin("COMPARISON", "TREND")) | prior,
            "concepts": F.array_distinct(F.transform(both, lambda c: c["id"])),
            "terms": F.array_distinct(F.flatten(F.transform(both, lambda c: c["keywords"]))),
            "metric": F.coalesce(F.get(found, F.lit(0))["id"], F.lit("")),
            "inferred_statement": inferred,
            "explicit_statement": explicit,
            "comparison_years": compared,
            "target_years": F.array_distinct(F.concat(stated, compared)),
            "ratio_formula": F.coalesce(named["formula"], F.lit("")),
            "filing_type": F.when(q.rlike(r"\b10\s*-\s*k\b|\b10k\b"), "10-K").when(q.rlike(r"\b10\s*-\s*q\b|\b10q\b"), "10-Q").when(q.rlike(r"\b8\s*-\s*k\b|\b8k\b"), "8-K").otherwise(""),
            "_quarter": F.regexp_extract(q, r"\b(q[1-4]|first quarter|second quarter|third quarter|fourth quarter)\b", 1),
            "requested_unit": _first_of(q, lx.UNITS, ""),
            "comparison_direction": F.when(tx.any_in(q, lx.UP_WORDS), "increase").when(tx.any_in(q, lx.DOWN_WORDS), "decrease").otherwise(""),
            "company": company(raw),
        }
    )
    quarter = F.col("_quarter")
    df = df.withColumns(
        {
            "quarter": F.when(quarter.startswith("first"), "Q1").when(quarter.startswith("second"), "Q2").when(quarter.startswith("third"), "Q3").when(quarter.startswith("fourth"), "Q4").otherwise(F.upper(quarter)),
            "target_statements": F.array_distinct(
                F.concat(
                    one(F.col("explicit_statement") != "ANY", F.col("explicit_statement")),
                    one(F.col("inferred_statement") != "ANY", F.col("inferred_statement")),
                    one(tx.any_in(q, lx.MENTIONS_BALANCE), F.lit("BALANCE_SHEET")),
                    one(tx.any_in(q, lx.MENTIONS_INCOME), F.lit("INCOME_STATEMENT")),
                    F.transform(inputs, lambda c: c["statement"]),
                )
            ),
            "multi_evidence": F.col("is_comparison") | F.col("query_type").isin("COMPARISON", "TREND", "CALCULATION") | (F.size("target_years") > 1) | tx.any_in(q, lx.MULTIPLE),
            "requested_statement": F.when(F.col("explicit_statement") != "ANY", F.col("explicit_statement")).otherwise(F.col("inferred_statement")),
        }
    )
    return df.withColumn("context_limit", F.when(F.col("multi_evidence"), 10).otherwise(5)).withColumn("expanded_query", expanded(raw, q)).drop("_q", "_type", "_found", "_ratio", "_quarter")


def expanded(raw: Column, q: Column) -> Column:
    """The question and behind it wordings of filings that it lacks."""
    extra = [F.when(F.col("query_type") == "DOCUMENT_PURPOSE", lx.strings(lx.PURPOSE_EVIDENCE)).otherwise(_none())]
    for words, kind, first, second in lx.EXPANSIONS:
        ok = tx.any_in(q, first)
        if kind != "*":
            ok = ok & (F.col("query_type") == kind)
        if second:
            ok = ok & tx.any_in(q, second)
        extra.append(F.when(ok, lx.strings(words)).otherwise(_none()))
    absent = F.filter(F.array_distinct(F.concat(*extra, F.col("terms"))), lambda t: ~q.contains(t))
    return F.when(F.size(absent) > 0, F.concat_ws(" ", raw, F.array_join(absent, " "))).otherwise(raw)


def is_comparison_intent(question: Column) -> Column:
    """For reranking; needs the analysis columns."""
    q = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    return F.col("is_comparison") | F.col("query_type").isin("COMPARISON", "TREND") | tx.any_in(q, lx.COMPARISON_INTENT)


def is_comparison_for_gate(question: Column) -> Column:
    q = F.concat(F.lit(" "), F.lower(F.coalesce(question, F.lit(""))), F.lit(" "))
    return F.col("is_comparison") | F.col("query_type").isin("COMPARISON", "TREND") | tx.any_in(q, lx.COMPARISON_GATE) | q.rlike(lx.WHICH_ENTITY)
