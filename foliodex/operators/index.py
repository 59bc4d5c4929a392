"""Indexes and retrieval: postings, BM25, purpose markers, dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

K1, B, FLOOR = 1.5, 0.75, 0.25


def tokenized(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_name, chunk_index, dl, terms (term, tf) of every chunk, counted inside its row: sorted tokens, cut where they change."""
    tokens = chunks.select("doc_name", "chunk_index", F.array_sort(tx.tokenize(F.coalesce(text_col, F.lit("")))).alias("tokens"))
    changes = "filter(transform(tokens, (x, i) -> if(i = 0 or x <> get(tokens, i - 1), i, null)), i -> i is not null)"
    cut = tokens.select("doc_name", "chunk_index", "tokens", F.size("tokens").alias("dl"), F.expr(changes).alias("starts"))
    terms = "transform(starts, (x, k) -> struct(get(tokens, x) as term, coalesce(get(starts, k + 1), dl) - x as tf))"
    return cut.select("doc_name", "chunk_index", "dl", F.expr(terms).alias("terms"))


def _terms(chunks: DataFrame, text_col: str) -> DataFrame:
    return chunks if {"dl", "terms"} <= set(chunks.columns) else tokenized(chunks, text_col)


def postings(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_name, chunk_index, term, tf, dl for every term of every chunk (dl: tokens of the chunk); chunks or their tokenized form."""
    return _terms(chunks, text_col).select("doc_name", "chunk_index", "dl", F.inline("terms")).select("doc_name", "chunk_index", "term", "tf", "dl")


def corpus_stats(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_name, n_chunks, avgdl: chunks without a token count too; chunks or their tokenized form."""
    return _terms(chunks, text_col).groupBy("doc_name").agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_name, term, df, idf: below zero an idf is FLOOR times the mean over the terms of its filing."""
    df = posts.groupBy("doc_name", "term").agg(F.count("*").alias("df"))
    raw = df.join(stats.select("doc_name", "n_chunks"), "doc_name").withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = raw.groupBy("doc_name").agg(F.avg("raw").alias("mean"))
    return raw.join(means, "doc_name").select("doc_name", "term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(query_terms: DataFrame, posts: DataFrame, terms: DataFrame, stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """qid, doc_name, chunk_index, score (rounded to 6 places) for (qid, term, qtf); with keys ["doc_name"] a query keeps to its filing.

    Postings are cut to the queries' terms before statistics are joined to them.
    """
    keys = keys or []
    hits = posts.join(query_terms, [*keys, "term"])
    scored = hits.join(terms.select("doc_name", "term", "idf"), ["doc_name", "term"]).join(stats.select("doc_name", "avgdl"), "doc_name")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("qid", "doc_name", "chunk_index").agg(F.round(F.sum(part), 6).alias("score"))


def query_terms(questions: DataFrame, expanded: Column) -> DataFrame:
    """qid, term, qtf: repeated terms weigh more."""
    return questions.select("qid", F.explode(tx.query_tokens(tx.synonyms(expanded))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def ranked(scores: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The k best rows of each group with their rank; Spark cuts groups before the exchange."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or ["qid", "doc_name"])).orderBy(*order))).where(F.col("rank") <= k)


def search_bm25(scores: DataFrame, k: int = 50, by: list[str] | None = None) -> DataFrame:
    return ranked(scores.where("score > 0"), k, [F.desc("score"), F.desc("chunk_index")], by)


def marker_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Purpose-marker scores; only DOCUMENT_PURPOSE questions take part, and are filtered before chunks are met."""
    asked = questions.where("query_type = 'DOCUMENT_PURPOSE'").select("qid", "doc_name", "target_years")
    marks = lx.PURPOSE_EVIDENCE
    text = tx.search_text()
    hits = sum((text.contains(m).cast("int") for m in marks[1:]), text.contains(marks[0]).cast("int"))
    fixed = 10 * hits + 15 * text.contains("item information").cast("int") + 8 * (text.contains("submission type") | text.contains("form type")).cast("int") + 8 * text.contains("filed as of date").cast("int")
    scored = chunks.withColumn("_text", text).withColumn("_fixed", fixed).join(asked, "doc_name")
    year = F.exists("target_years", lambda y: F.col("_text").contains(y)).cast("int")
    return scored.select("qid", "doc_name", "chunk_index", (F.col("_fixed") + 5 * year).cast("double").alias("score")).where("score > 0")


def unit(vector: Column) -> Column:
    """A vector of length one (a zero vector stays as it is)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dense_scores(queries: DataFrame, vectors: DataFrame, *, a_pass: int = 100_000) -> DataFrame:
    """qid, doc_name, chunk_index, score: exact cosine of (qid, vector) with every (doc_name, chunk_index, embedding).

    Queries are cut by their ids into passes of about a_pass; any number of them is answered. The matrix of a
    pass goes to each Arrow batch of vectors, and a batch yields each query's scores.
    """
    passes = -(-queries.count() // a_pass)
    if not passes:
        return vectors.select(F.lit(None).cast("long").alias("qid"), "doc_name", "chunk_index", F.lit(None).cast("double").alias("score")).limit(0)
    found = None
    for k in range(passes):
        scores = _scores_of(queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == k), vectors)
        found = scores if found is None else found.unionByName(scores)
    return found


def _scores_of(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The scores of one pass of dense_scores."""
    import numpy as np

    asked = queries.select("qid", "vector").toArrow()
    ids = asked.column("qid").to_pylist()
    matrix = np.asarray(asked.column("vector").combine_chunks().flatten(), float).reshape(len(ids), -1) if ids else np.empty((0, 0))
    matrix = matrix / np.where((n := np.linalg.norm(matrix, axis=1, keepdims=True)) == 0, 1, n)

    def run(batches):
        import pyarrow as pa

        for x in batches:
            v = np.array(x.column("embedding").to_pylist(), float).reshape(x.num_rows, -1)
            v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
            for k in range(0, len(ids), 64):
                s = v @ matrix[k : k + 64].T
                m = s.shape[1]
                take = pa.array(np.repeat(np.arange(x.num_rows), m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[k : k + 64] * x.num_rows), x.column("doc_name").take(take), x.column("chunk_index").take(take), pa.array(s.ravel())], ["qid", "doc_name", "chunk_index", "score"]
                )

    types = dict(vectors.dtypes) | {"qid": dict(queries.dtypes)["qid"]}
    return vectors.select("doc_name", "chunk_index", "embedding").mapInArrow(run, f"qid {types['qid']}, doc_name {types['doc_name']}, chunk_index {types['chunk_index']}, score double")


def search_dense(scores: DataFrame, k: int = 50, by: list[str] | None = None) -> DataFrame:
    return ranked(scores.withColumn("score", F.round("score", 6)), k, [F.desc("score"), F.asc("chunk_index")], by)
