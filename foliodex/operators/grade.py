"""Grading of answers and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


def within(a: Column, b: Column, relative: float, least: float) -> Column:
    """Whether some value of a lies near some value of b (arrays of double)."""
    return F.exists(b, lambda g: F.exists(a, lambda p: F.abs(p - g) <= F.greatest(F.lit(least), F.abs(g) * relative)))


def numeric_equivalent(predicted: Column, gold: Column, relative: float = 0.01) -> Column:
    """Null if gold has no number, else whether a predicted number is within the relative tolerance of one of gold's."""
    g, p = tx.numbers(gold), tx.numbers(predicted)
    return F.when(F.size(g) > 0, within(tx.number_values(p), tx.number_values(g), relative, 1e-9))


def purely_numeric(gold: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(gold, F.lit("")), lx.GRADE_NUMBER, ""), r"(?U)[^\w]", "")
    return F.length(bare) <= 6


def placed_numbers(text: Column) -> Column:
    """array<struct<value, at>>: every number of a text with its place, by walking over the pieces between numbers."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({lx.GRADE_NUMBER})"), 1)
    start = F.struct(F.lit(0).alias("from"), F.array().cast("array<struct<value: double, at: int>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        # where the next match begins: the first place at or after `from` from which the pattern matches this number
        rest = F.substring(text, acc["from"] + 1, 1_000_000_000)
        at = acc["from"] + F.regexp_instr(rest, F.lit(lx.GRADE_NUMBER)) - 1
        value = F.rtrim(F.regexp_replace(n, "[,$]", ""), F.lit("%")).try_cast("double")
        return F.struct((at + F.length(n)).cast("int").alias("from"), F.concat(acc["out"], F.array(F.struct(value.alias("value"), at.cast("int").alias("at")))).alias("out"))

    return F.filter(F.aggregate(found, start, step)["out"], lambda x: x["value"].isNotNull())


def delta_matches(predicted: Column, gold_values: Column, near: int = 40) -> Column:
    """Whether two near numbers of an answer differ by one of gold's values (15 %, or 0.15)."""
    p = placed_numbers(predicted)
    close = lambda x, y: (y["at"] > x["at"]) & (y["at"] - x["at"] <= near)
    return F.exists(gold_values, lambda g: F.exists(p, lambda x: F.exists(p, lambda y: close(x, y) & (F.abs(F.abs(x["value"] - y["value"]) - F.abs(g)) <= F.greatest(F.lit(0.15), F.abs(g) * 0.15)))))


def yes_no(text: Column) -> Column:
    return F.when(F.trim(F.lower(text)).rlike(r"^yes\b"), "yes").when(F.trim(F.lower(text)).rlike(r"^no\b"), "no")


def answers_match(predicted: Column, gold: Column, deltas: bool = True) -> Column:
    """Equality, containment, verdict, numbers, differences, then shared words."""
    p, g = tx.normalize_answer(predicted), tx.normalize_answer(gold)
    pn, gn = tx.numbers(predicted), tx.numbers(gold)
    pv, gv = tx.number_values(pn), tx.number_values(gn)
    long_words = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: F.length(w) > 3))
    gw, pw = long_words(g), long_words(p)
    shared = F.size(F.array_intersect(gw, pw))
    share = shared / F.greatest(F.size(gw), F.lit(1))
    gy, py = yes_no(gold), yes_no(predicted)
    out = (
        F.when((F.coalesce(predicted, F.lit("")) == "") | (F.coalesce(gold, F.lit("")) == ""), False)
        .when((p == g) | p.contains(g) | g.contains(p), True)
        .when(F.coalesce(gy != py, F.lit(False)), False)
        .when(F.size(F.array_intersect(pn, gn)) > 0, True)
        .when((F.size(gn) > 0) & (F.size(pn) > 0) & within(pv, gv, 0.01, 0.01), True)
    )
    if deltas:
        out = out.when((F.size(gn) > 0) & (F.size(pn) > 0) & delta_matches(predicted, gv), True)
    return (
        out.when((F.size(gw) == 0) | (F.size(gn) > 0), False)
        .when(share >= 0.6, True)
        .when(F.coalesce(gy == py, F.lit(False)) & (share >= 0.3) & (shared >= 2), True)
        .when(gy.isNull() & py.isNull() & (share >= 0.4) & (shared >= 2), True)
        .otherwise(False)
    )


def rubric(df: DataFrame, page_tolerance: int = 0) -> DataFrame:
    """reason and points of rows with found, correct, pages (cited) and gold_page: abstained 0, wrong -1, wrong page 0, else +1."""
    on_page = F.col("gold_page").isNull() | F.exists("pages", lambda p: F.abs(p - F.col("gold_page")) <= page_tolerance)
    reason = F.when(~F.col("found"), "0_not_found").when(~F.col("correct"), "-1").when(~on_page, "0_wrong_page").otherwise("+1")
    return df.withColumn("reason", reason).withColumn("points", F.when(F.col("reason") == "+1", 1).when(F.col("reason") == "-1", -1).otherwise(0))


def summary(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, points and their mean by reason, rolled up over `by`."""
    return graded.rollup(*(by or []), "reason").agg(F.count("*").alias("n"), F.sum("points").alias("points"), F.round(F.avg("points"), 6).alias("mean_points"))


def ranking_metrics(ranked: DataFrame, queries: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """recall_5/10/20, mrr and ndcg of (by.., qid, rank, rel) over all of (by.., qid); questions without results count as zero.

    The ideal order is that of the retrieved list itself.
    """
    group = [*by, "qid"]
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1)
    ideal = ranked.withColumn("best", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("rel"), "rank")))
    per = ideal.groupBy(*group).agg(
        *[F.max(F.when((F.col("rel") > 0) & (F.col("rank") <= n), 1.0).otherwise(0.0)).alias(f"recall_{n}") for n in (5, 10, 20)],
        F.coalesce(1.0 / F.min(F.when(F.col("rel") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("best") <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("best") + 1)).otherwise(0.0)).alias("idcg"),
    )
    all_of = queries.select(*group).distinct().join(per, group, "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    ndcg = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))
    return all_of.groupBy(*by).agg(F.count("*").alias("n_queries"), *[mean(F.col(c)).alias(c) for c in ("recall_5", "recall_10", "recall_20", "mrr")], mean(ndcg).alias("ndcg_10"))


def evidence_matches(evidence: Column, chunk: Column) -> Column:
    """Whether a chunk holds the first 120 characters of the evidence, or enough of its longer words."""
    e, c = tx.normalize_answer(evidence), tx.normalize_answer(chunk)
    terms = F.array_distinct(F.filter(F.split(e, " "), lambda w: (F.length(w) > 4) & ~w.rlike("^[0-9]+$")))
    hits = F.size(F.filter(terms, lambda t: c.contains(t)))
    need = F.least(F.lit(8), F.greatest(F.lit(3), F.floor(F.size(terms) * 0.25)))
    return (e != "") & (c != "") & (c.contains(F.substring(e, 1, 120)) | ((F.size(terms) > 0) & (hits >= need)))


def diagnose(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """qid, gold_page_rank, gold_evidence_rank and flags from (qid, gold_page, evidence_text) and (qid, rank, page_num, text)."""
    both = gold.join(ranked, "qid", "left")
    out = both.groupBy("qid").agg(
        F.min(F.when(F.col("page_num") == F.col("gold_page"), F.col("rank"))).alias("gold_page_rank"),
        F.min(F.when(evidence_matches(F.col("evidence_text"), F.col("text")), F.col("rank"))).alias("gold_evidence_rank"),
    )
    return out.withColumns({f"{what}_in_top_{n}": F.coalesce(F.col(f"{what}_rank") <= n, F.lit(False)) for what in ("gold_page", "gold_evidence") for n in (1, 5, 10)})


def classify_failure(df: DataFrame) -> DataFrame:
    """failure of rows with error, reason and the flags of diagnose()."""
    api = F.coalesce("error", F.lit("")).rlike("(?i)groq|api|rate|429|timeout|connect|network|ssl")
    near = F.col("gold_evidence_in_top_5") | F.col("gold_page_in_top_5")
    return df.withColumn("failure", F.when(api, "API_FAILURE").when(near & (F.col("reason") == "+1"), "RETRIEVAL_SUCCESS_ANSWER_CORRECT").when(near, "RETRIEVAL_SUCCESS_REASONING_FAILED").otherwise("RETRIEVAL_FAILED"))


def stage_drops(stages: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """The rows that each stage lost against the one before it: stage and keys."""
    lost = None
    for (_, before), (name, after) in zip(stages, stages[1:], strict=False):
        gone = before.select(*keys).join(after.select(*keys), keys, "left_anti").withColumn("stage", F.lit(name))
        lost = gone if lost is None else lost.unionByName(gone)
    return lost
