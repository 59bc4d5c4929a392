"""The registered queries of the engine, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import analyze, answer, fuse, gate, grade, index, parse
from ..sources.staging import staged
from . import fixtures as fx
from . import pipeline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    return fx.made(spark, sf_dir, fx.DOCS, "documents")


def chunks(spark, sf_dir) -> DataFrame:
    return fx.made(spark, sf_dir, fx.CHUNKS, "orders")


def questions(spark, sf_dir) -> DataFrame:
    return fx.made(spark, sf_dir, fx.QUESTIONS, "nation")


# --- SQL that several oracles share. -----------------------------------------------------------------------------


def sql_tokens(x: str) -> str:
    found = f"regexp_extract_all(lower({x}), '{lx.TOKEN}')"
    return f"list_transform(list_filter({found}, lambda t: trim(t, '.,%$') <> ''), lambda t: CASE WHEN starts_with(t, '$') OR contains(t, '%') THEN t ELSE trim(t, '.,') END)"


def quoted(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def sql_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def sql_first(x: str, lines, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(x, w)} THEN {quoted(n)}" for n, w in lines) + f" ELSE {quoted(default)} END"


CTE_DOCS = f"docs AS ({fx.DOCS})"
CTE_CHUNKS = f"chunks AS ({fx.CHUNKS})"
CTE_QUESTIONS = f"questions AS ({fx.QUESTIONS})"
TOKENS = f"tok AS (SELECT doc_name, chunk_index, {sql_tokens('text')} AS tokens FROM docs)"


def sql_bm25(scope: str, per: str, k: int) -> str:
    """BM25 of benchmark items over documents; scope: the filing of a chunk, per: the groups that are ranked."""
    stop = sql_list(lx.QUERY_STOP)
    synonyms = " || ".join(f"CASE WHEN {sql_any('lower(text)', g)} THEN list_filter({sql_list(g)}, lambda p: NOT contains(lower(text), p)) ELSE [] END" for g in lx.SYNONYMS)
    return f"""
WITH {CTE_DOCS},
tok AS (SELECT {scope} AS doc_name, chunk_index, {sql_tokens('text')} AS tokens FROM docs),
posts AS (SELECT doc_name, chunk_index, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_name, chunk_index, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL),
stats AS (SELECT doc_name, count(*) AS n, avg(len(tokens)) AS avgdl FROM tok GROUP BY 1),
raw AS (SELECT doc_name, term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT doc_name, term, count(*) AS df FROM posts GROUP BY 1, 2) JOIN stats USING (doc_name)),
idf AS (SELECT doc_name, term, CASE WHEN r < 0 THEN {index.FLOOR} * avg(r) OVER (PARTITION BY doc_name) ELSE r END AS idf FROM raw),
ex AS (SELECT item_id, text, {synonyms} AS extra FROM benchmark),
qt AS (SELECT item_id, {sql_tokens("CASE WHEN len(extra) > 0 THEN text || ' ' || array_to_string(extra, ' ') ELSE text END")} AS t FROM ex),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest(CASE WHEN len(list_filter(t, lambda x: NOT list_contains({stop}, x))) > 0 THEN list_filter(t, lambda x: NOT list_contains({stop}, x)) ELSE t END) AS term FROM qt) GROUP BY ALL),
s AS (SELECT qid, doc_name, chunk_index, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM posts JOIN q USING (term) JOIN idf USING (doc_name, term) JOIN stats USING (doc_name) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY score DESC, chunk_index DESC) AS rank FROM s WHERE score > 0)
SELECT qid, doc_name, chunk_index, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {k}
"""


def benchmark_bm25(spark, sf_dir, scope: str) -> DataFrame:
    chunk = docs(spark, sf_dir)
    if scope == "corpus":
        chunk = chunk.withColumn("doc_name", F.lit("corpus"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    chunk = staged(index.tokenized(chunk), "terms")
    posts, stats = index.postings(chunk), index.corpus_stats(chunk)
    return index.bm25(index.query_terms(items, F.col("text")), posts, index.term_stats(posts, stats), stats)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("qid", "doc_name", "chunk_index", "score", F.col("rank").cast("int").alias("rank"))


# --- Retrieval. ---------------------------------------------------------------------------------------------------


@query(sql_bm25("'corpus'", "qid", 10))
def bm25_topk(spark, sf_dir):
    """F1-F3 over one corpus."""
    return _shown(index.search_bm25(benchmark_bm25(spark, sf_dir, "corpus"), 10, ["qid"]))


@query(sql_bm25("doc_name", "qid, doc_name", 5))
def bm25_per_source(spark, sf_dir):
    """F1-F3 with statistics per filing."""
    return _shown(index.search_bm25(benchmark_bm25(spark, sf_dir, "source"), 5))


@query(f"WITH {CTE_DOCS}, {TOKENS} SELECT doc_name, sum(len(tokens)) AS n_tokens, count(*) AS n_chunks, sum(len(list_distinct(tokens))) AS n_terms, max(len(tokens)) AS longest FROM tok GROUP BY 1")
def tokenize_stats(spark, sf_dir):
    """D1."""
    t = docs(spark, sf_dir).select("doc_name", tx.tokenize(F.col("text")).alias("t"))
    return t.groupBy("doc_name").agg(F.sum(F.size("t")).alias("n_tokens"), F.count("*").alias("n_chunks"), F.sum(F.size(F.array_distinct("t"))).alias("n_terms"), F.max(F.size("t")).cast("long").alias("longest"))


@query(f"""
WITH {CTE_DOCS}, {TOKENS},
df AS (SELECT doc_name, term, count(DISTINCT chunk_index) AS df FROM (SELECT doc_name, chunk_index, unnest(tokens) AS term FROM tok) GROUP BY 1, 2),
n AS (SELECT doc_name, count(*) AS n FROM tok GROUP BY 1),
raw AS (SELECT doc_name, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df JOIN n USING (doc_name)),
i AS (SELECT doc_name, df, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY doc_name) ELSE r END AS idf FROM raw)
SELECT doc_name, count(*) AS n_terms, sum(df) AS sum_df, max(df) AS max_df, round(avg(idf), 6) AS mean_idf, round(min(idf), 6) AS least_idf FROM i GROUP BY 1
""")
def term_stats(spark, sf_dir):
    """document frequencies and floored idf of every filing."""
    d = staged(index.tokenized(docs(spark, sf_dir)), "terms")
    posts, stats = index.postings(d), index.corpus_stats(d)
    t = index.term_stats(posts, stats)
    return t.groupBy("doc_name").agg(F.count("*").alias("n_terms"), F.sum("df").alias("sum_df"), F.max("df").alias("max_df"), F.round(F.avg("idf"), 6).alias("mean_idf"), F.round(F.min("idf"), 6).alias("least_idf"))


def _purpose_sql() -> str:
    marks = lx.PURPOSE_EVIDENCE
    search = "lower(concat_ws(' ', section, subsection, statement_title, table_title, table_context, '', chunk_type, '', text))"
    hits = " + ".join(f"CAST(contains(x, {quoted(m)}) AS INT)" for m in marks)
    return f"""
WITH {CTE_CHUNKS}, c AS (SELECT doc_name, chunk_index, {search} AS x FROM chunks),
s AS (SELECT doc_name, chunk_index, CAST(10 * ({hits}) + 15 * CAST(contains(x, 'item information') AS INT) + 8 * CAST(contains(x, 'submission type') OR contains(x, 'form type') AS INT)
  + 8 * CAST(contains(x, 'filed as of date') AS INT) + 5 * CAST(contains(x, '2018') AS INT) AS DOUBLE) AS score FROM c)
SELECT doc_name, chunk_index, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY score DESC, chunk_index) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


@query(_purpose_sql())
def marker_search(spark, sf_dir):
    """one purpose question to each filing."""
    c = chunks(spark, sf_dir).withColumns({"statement_type": F.lit(""), "units": F.lit("")})
    asked = c.select("doc_name").distinct().select(F.lit(1).alias("qid"), "doc_name", F.lit("DOCUMENT_PURPOSE").alias("query_type"), F.array(F.lit("2018")).alias("target_years"))
    return index.ranked(index.marker_scores(asked, c), 50, [F.desc("score"), F.asc("chunk_index")]).select("doc_name", "chunk_index", "score", F.col("rank").cast("int").alias("rank"))


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label"), F.col("embedding").alias("vector")), e.select(F.lit("corpus").alias("doc_name"), F.col("vec_id").alias("chunk_index"), "embedding", "label")


DENSE = "d AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_index, q.label AS q_label, v.label AS label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"


@query(f"WITH {DENSE} SELECT qid, chunk_index, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_index) AS rank FROM d) WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    """Exact cosine top-k; every twentieth vector asks."""
    asked, vectors = _vectors(spark, sf_dir)
    return index.search_dense(index.dense_scores(asked, vectors), 10, ["qid"]).select("qid", "chunk_index", "score", F.col("rank").cast("int").alias("rank"))


@query(f"""
WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_index) AS rank FROM d WHERE chunk_index <> qid),
t AS (SELECT *, CASE WHEN label = q_label THEN 1 ELSE 0 END AS rel FROM r WHERE rank <= 20),
p AS (SELECT qid, max(CASE WHEN rel = 1 AND rank <= 5 THEN 1.0 ELSE 0 END) AS r5, max(CASE WHEN rel = 1 AND rank <= 10 THEN 1.0 ELSE 0 END) AS r10, max(CASE WHEN rel = 1 THEN 1.0 ELSE 0 END) AS r20,
  coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr, sum(CASE WHEN rank <= 10 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(rel) AS n FROM t GROUP BY 1),
i AS (SELECT n, sum(1.0 / log2(k + 1)) AS idcg FROM (SELECT n, unnest(range(1, least(n, 10) + 1)) AS k FROM (SELECT DISTINCT CAST(n AS BIGINT) AS n FROM p)) GROUP BY 1)
SELECT 'dense' AS mode, count(*) AS n_queries, round(avg(CAST(r5 AS DOUBLE)), 6) AS recall_5, round(avg(CAST(r10 AS DOUBLE)), 6) AS recall_10, round(avg(CAST(r20 AS DOUBLE)), 6) AS recall_20, round(avg(mrr), 6) AS mrr,
  round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg_10 FROM p LEFT JOIN i USING (n)
""")
def ndcg_mrr_recall(spark, sf_dir):
    """K9-K11 with a vector's label as relevance."""
    asked, vectors = _vectors(spark, sf_dir)
    scores = index.dense_scores(asked, vectors).where("chunk_index <> qid")
    top = index.search_dense(scores, 20, ["qid"]).join(asked.select("qid", "q_label"), "qid").join(vectors.select("chunk_index", "label"), "chunk_index")
    rel = top.select(F.lit("dense").alias("mode"), "qid", "rank", (F.col("label") == F.col("q_label")).cast("int").alias("rel"))
    return grade.ranking_metrics(rel, asked.select(F.lit("dense").alias("mode"), "qid"), ["mode"])


EVENT_LISTS = """
SELECT user_id % 50 AS qid, event_type, event_id AS chunk_index, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY value DESC, event_id) AS rank FROM events
"""


def _lists(spark, sf_dir) -> dict[str, DataFrame]:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("qid"), "event_type", F.lit("f").alias("doc_name"), (F.col("event_id") % 400).alias("chunk_index"), "value", "event_id")
    best = e.groupBy("qid", "event_type", "doc_name", "chunk_index").agg(F.max("value").alias("score"))
    ranked = index.ranked(best, 50, [F.desc("score"), F.asc("chunk_index")], ["qid", "event_type"])
    kinds = {"bm25": "view", "metadata": "click", "dense": "purchase"}
    return {k: ranked.where(F.col("event_type") == v) for k, v in kinds.items()}


RRF_SQL = f"""
WITH b AS (SELECT user_id % 50 AS qid, event_type, event_id % 400 AS chunk_index, max(value) AS score FROM events GROUP BY 1, 2, 3),
l AS (SELECT qid, event_type, chunk_index, row_number() OVER (PARTITION BY qid, event_type ORDER BY score DESC, chunk_index) AS rank FROM b),
f AS (SELECT qid, chunk_index, round(sum(CASE event_type WHEN 'click' THEN 0.9 ELSE 1.0 END / CAST(60 + rank AS DOUBLE)), 9) AS rrf, max(CASE WHEN event_type = 'view' THEN rank END) AS bm25_rank,
  max(CASE WHEN event_type = 'click' THEN rank END) AS metadata_rank, max(CASE WHEN event_type = 'purchase' THEN rank END) AS dense_rank
  FROM l WHERE rank <= 50 AND event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)
SELECT qid, chunk_index, rrf, CAST(bm25_rank AS INT) AS bm25_rank, CAST(metadata_rank AS INT) AS metadata_rank, CAST(dense_rank AS INT) AS dense_rank, CAST(rrf_order AS INT) AS rrf_order FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, bm25_rank NULLS LAST, metadata_rank NULLS LAST, dense_rank NULLS LAST, chunk_index) AS rrf_order FROM f) WHERE rrf_order <= 80
"""


@query(RRF_SQL)
def rrf_fusion(spark, sf_dir):
    """Three weighted lists."""
    out = fuse.pool(fuse.rrf(_lists(spark, sf_dir)))
    return out.select("qid", "chunk_index", "rrf", *[F.col(c).cast("int").alias(c) for c in ("bm25_rank", "metadata_rank", "dense_rank", "rrf_order")])


# --- Text functions and parsing. ------------------------------------------------------------------------------------


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, w, CAST(greatest(1, ceil((len(w) - 1200) / 1100.0) + 1) AS BIGINT) AS n FROM w)
SELECT doc_id, k AS window_no, len(w[k * 1100 + 1 : k * 1100 + 1200]) AS n_words, md5(array_to_string(w[k * 1100 + 1 : k * 1100 + 1200], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, n)) AS k FROM n)
""")
def window_chunks(spark, sf_dir):
    """C14."""
    w = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(tx.windows(tx.whitespace_words(F.col("text")))).alias("window_no", "t"))
    return w.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " "))).cast("long").alias("n_words"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(r"""
WITH a AS (SELECT page_id, translate(regexp_replace(html, '<[^>]*>', ' ', 'g'), '‘’“”–—−' || chr(160), '''''""--- ') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n\s*\n+', E'\n', 'g'), ' *\n *', E'\n', 'g') AS t FROM a)
SELECT page_id, length(trim(t, E' \n\t\r')) AS n_chars, md5(trim(t, E' \n\t\r')) AS digest FROM b
""")
def normalize_text(spark, sf_dir):
    """C1 (without NFKC)."""
    t = read(spark, sf_dir, "pages").select("page_id", tx.normalize(F.regexp_replace("html", "<[^>]*>", " ")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


def _scores_sql() -> str:
    head = "lower(concat_ws(' ', section, subsection, statement_title, table_title, table_context))"
    parts = []
    for name, heads, bodies in lx.STATEMENTS:
        body = " + ".join(f"CASE WHEN contains(b, {quoted(w)}) THEN {2 if ' ' in w else 1} ELSE 0 END" for w in bodies)
        bonus = {
            "BALANCE_SHEET": "CASE WHEN contains(b, 'total assets') AND (contains(b, 'total liabilities') OR contains(b, 'current liabilities')) THEN 8 ELSE 0 END",
            "INCOME_STATEMENT": "CASE WHEN (contains(b, 'net income') OR contains(b, 'net earnings')) AND (contains(b, 'earnings per share') OR contains(b, 'cost of sales')) THEN 6 ELSE 0 END",
            "CASH_FLOW_STATEMENT": "CASE WHEN contains(b, 'operating activities') AND contains(b, 'investing activities') THEN 8 ELSE 0 END",
            "EQUITY_STATEMENT": "CASE WHEN (contains(b, 'retained earnings') OR contains(b, 'treasury stock')) AND (contains(b, 'common stock') OR contains(b, 'additional paid-in capital')) THEN 6 ELSE 0 END",
        }[name]
        parts.append(f"CASE WHEN note THEN greatest(0, x) ELSE x + 4 END AS {name}".replace("x + 4", f"(CASE WHEN {sql_any('h', heads)} THEN 8 ELSE 0 END + {body} + {bonus})").replace("greatest(0, x)", f"greatest(0, CASE WHEN {sql_any('h', heads)} THEN 8 ELSE 0 END + {body} + {bonus} - 4)"))
    units = "CASE " + " ".join(f"WHEN {sql_any('u', w)} THEN {quoted(n)}" for n, w in lx.TABLE_UNITS) + " END"
    best = "greatest(BALANCE_SHEET, INCOME_STATEMENT, CASH_FLOW_STATEMENT, EQUITY_STATEMENT)"
    strong = " ".join(f"WHEN strong AND {best} >= 8 AND {n} = {best} THEN '{n}'" for n in ("BALANCE_SHEET", "INCOME_STATEMENT", "CASH_FLOW_STATEMENT", "EQUITY_STATEMENT"))
    cascade = " ".join(f"WHEN {sql_any('w', x)} THEN '{n}'" for n, x in lx.CASCADE)
    return f"""
WITH {CTE_CHUNKS}, c AS (SELECT doc_name, chunk_index, {head} AS h, lower(text) AS b, concat_ws(' ', {head}, lower(CASE WHEN chunk_type = 'table' THEN text[1:1200] ELSE text[1:250] END)) AS w, lower(concat(table_title, chr(10), text)) AS u,
  chunk_type = 'table' OR statement_title <> '' AS strong,
  (starts_with(lower(subsection), 'note') OR contains({head}, 'notes to consolidated')) AND NOT regexp_matches(statement_title, '(?i)' || {quoted(lx.STATEMENT_HEADING)}) AS note FROM chunks),
s AS (SELECT doc_name, chunk_index, w, u, strong, {', '.join(parts)} FROM c)
SELECT doc_name, chunk_index, CAST(BALANCE_SHEET AS INT) AS balance, CAST(INCOME_STATEMENT AS INT) AS income, CAST(CASH_FLOW_STATEMENT AS INT) AS cash, CAST(EQUITY_STATEMENT AS INT) AS equity,
  CASE {strong} {cascade} ELSE 'OTHER' END AS statement_type, {units} AS units FROM s
"""


def typed(c: DataFrame) -> DataFrame:
    c = c.withColumn("_s", parse.scores_column())
    return c.withColumns({"statement_type": parse.type_column(F.col("_s")), "units": parse.units_column()})


@query(_scores_sql())
def structure_scores(spark, sf_dir):
    """C10-C12."""
    c = typed(chunks(spark, sf_dir))
    names = {"balance": "BALANCE_SHEET", "income": "INCOME_STATEMENT", "cash": "CASH_FLOW_STATEMENT", "equity": "EQUITY_STATEMENT"}
    return c.select("doc_name", "chunk_index", *[F.col("_s")[v].alias(k) for k, v in names.items()], "statement_type", "units")


SEC = """
SELECT CAST(s_suppkey AS BIGINT) AS chunk_index, concat(replace(s_name, '#', '_'), '_2019_10K') AS doc_name, concat('<SEC-HEADER> ACCESSION NUMBER: 0000-', CAST(s_suppkey AS STRING), '-19 CONFORMED SUBMISSION TYPE: 10-K', chr(10),
 CASE WHEN s_suppkey % 3 = 0 THEN concat('COMPANY CONFORMED NAME: ', s_name, ' Holdings CENTRAL INDEX KEY: 77') WHEN s_suppkey % 3 = 1 THEN concat('Company Name: ', s_name, ' LP') ELSE 'no name' END, chr(10),
 CASE WHEN s_suppkey % 2 = 0 THEN concat('FORM 10-Q CONFORMED PERIOD OF REPORT: 2019', CASE WHEN s_suppkey % 4 = 0 THEN '0331' ELSE '1231' END) ELSE 'FILED AS OF DATE: 2019-02-14' END) AS text FROM supplier
"""


@query(f"""
WITH s AS ({SEC})
SELECT doc_name, coalesce(nullif(trim(regexp_extract(text, '(?i)COMPANY CONFORMED NAME:\\s*(.+?)(?:\\s+[A-Z][A-Z /-]+:|\\n|$)', 1)), ''), nullif(trim(regexp_extract(text, '(?i)COMPANY NAME:\\s*(.+?)(?:\\n|$)', 1)), ''), string_split(doc_name, '_')[1]) AS company,
  CASE WHEN regexp_matches(text, '(?i)FORM\\s+10-Q') THEN '10-Q' ELSE '10-K' END AS filing_type,
  coalesce(nullif(regexp_replace(regexp_extract(text, 'CONFORMED PERIOD OF REPORT: (\\d{{8}})', 1), '^(\\d{{4}})(\\d\\d)(\\d\\d)$', '\\1-\\2-\\3'), ''), 'Unknown') AS fiscal_year,
  nullif(regexp_extract(text, 'FILED AS OF DATE: ([0-9-]+)', 1), '') AS filing_date, regexp_extract(text, 'ACCESSION NUMBER: ([0-9-]+)', 1) AS accession_number FROM s
""")
def sec_header_extract(spark, sf_dir):
    """Each supplier is a filing of one chunk with a header."""
    s = fx.made(spark, sf_dir, SEC, "supplier").withColumn("chunk_index", F.lit(0))
    return parse.filing_metadata(s)


@query()
def parse_pages(spark, sf_dir):
    """C2-C18 over raw web pages by the table function (a walk with state: no SQL)."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_name"), "html")
    return parse.parse_filings(p).select("doc_name", "chunk_index", "page_num", "section", "subsection", "statement_type", "chunk_type", "units", F.length("text").alias("n_chars"))


@query(r"""
WITH l AS (SELECT doc_id, k, list_extract(ls, k) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, E'\n') AS ls FROM documents)))
SELECT doc_id, count(DISTINCT key) AS n_lines, sum(length(line)) FILTER (WHERE first) AS kept_chars FROM (SELECT doc_id, line, key, row_number() OVER (PARTITION BY doc_id, key ORDER BY k) = 1 AS first FROM
  (SELECT doc_id, k, line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS key FROM l) WHERE key <> '') GROUP BY 1
""")
def dedupe_lines(spark, sf_dir):
    """Lines equal but for case and blanks count once."""
    l = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    l = l.withColumn("key", F.trim(F.regexp_replace(F.lower("line"), r"\s+", " "))).where("key <> ''")
    first = l.groupBy("doc_id", "key").agg(F.min_by("line", "k").alias("line"))
    return first.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("kept_chars"))


@query(r"""
WITH t AS (SELECT event_id, concat(props, ' ', CAST(ts AS STRING), ' 12019 FY2021Q3 x2020') AS t FROM events)
SELECT event_id, list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?:^|[^0-9])(20[0-9]{2})'), lambda x: x[-4:]))) AS y FROM t
""".replace("SELECT event_id, list_sort", "SELECT event_id, array_to_string(list_sort").replace(")) AS y", ")), ',') AS years"))
def years_in_text(spark, sf_dir):
    """D9."""
    t = read(spark, sf_dir, "events").select("event_id", F.concat("props", F.lit(" "), F.col("ts").cast("string"), F.lit(" 12019 FY2021Q3 x2020")).alias("t"))
    return t.select("event_id", F.array_join(F.array_sort(tx.years(F.col("t"))), ",").alias("years"))


@query(f"""
WITH a AS ({fx.ANSWERS}), m AS (SELECT qid, list_filter(list_transform(regexp_extract_all(predicted || ' ', '(-?\\$?\\d[\\d,]*\\.?\\d*%?)(?:[^\\w]|$)', 1), lambda x: replace(replace(x, ',', ''), '$', '')), lambda x: x <> '') AS n FROM a)
SELECT qid, len(list_distinct(n)) AS n_numbers FROM m
""".replace("len(list_distinct(n)) AS n_numbers", "array_to_string(list_sort(list_distinct(n)), ' ') AS numbers"))
def extract_numbers(spark, sf_dir):
    """D13."""
    return fx.made(spark, sf_dir, fx.ANSWERS, "part").select("qid", F.array_join(F.array_sort(tx.numbers(F.col("predicted"))), " ").alias("numbers"))


# --- Question analysis. -----------------------------------------------------------------------------------------------


def _type_sql() -> str:
    hits = ", ".join("(" + " + ".join(f"CAST(contains(q, {quoted(w)}) AS INT)" for w in words) + f") AS h{k}" for k, (_, words) in enumerate(lx.TYPES))
    strong = " ".join(f"WHEN h{k} >= 2 THEN '{n}'" for k, (n, _) in enumerate(lx.TYPES))
    weak = " ".join(f"WHEN h{k} >= 1 THEN '{n}'" for k, (n, _) in enumerate(lx.TYPES))
    ratio = sql_any("q", [a for _, aliases, _, _ in lx.RATIOS for a in aliases])
    return f"""
WITH {CTE_QUESTIONS}, l AS (SELECT qid, question, lower(question) AS q FROM questions), h AS (SELECT *, {hits} FROM l),
t AS (SELECT *, CASE WHEN {sql_any('q', lx.PURPOSE_QUESTION)} AND {sql_any('q', lx.PURPOSE_FILING)} THEN 'DOCUMENT_PURPOSE' {strong} {weak} ELSE 'GENERAL' END AS kind FROM h)
SELECT qid, CASE WHEN {ratio} AND kind NOT IN ('CALCULATION', 'COMPARISON', 'TREND') THEN 'CALCULATION' ELSE kind END AS query_type, kind = 'CALCULATION' OR {ratio} AS requires_calculation,
  CASE WHEN kind = 'CALCULATION' THEN {sql_any('q', lx.CALCULATION_COMPARES)} ELSE kind IN ('COMPARISON', 'TREND') END OR {sql_any('q', lx.PRIOR_YEAR)} AS is_comparison,
  {sql_first('q', lx.EXPLICIT_STATEMENTS, 'ANY')} AS explicit_statement, {sql_first('q', lx.UNITS, '')} AS requested_unit,
  CASE WHEN {sql_any('q', lx.UP_WORDS)} THEN 'increase' WHEN {sql_any('q', lx.DOWN_WORDS)} THEN 'decrease' ELSE '' END AS comparison_direction,
  CASE WHEN regexp_matches(q, '\\b10\\s*-\\s*k\\b|\\b10k\\b') THEN '10-K' WHEN regexp_matches(q, '\\b10\\s*-\\s*q\\b|\\b10q\\b') THEN '10-Q' WHEN regexp_matches(q, '\\b8\\s*-\\s*k\\b|\\b8k\\b') THEN '8-K' ELSE '' END AS filing_type,
  CASE regexp_extract(q, '\\b(q[1-4]|first quarter|second quarter|third quarter|fourth quarter)\\b', 1) WHEN '' THEN '' WHEN 'first quarter' THEN 'Q1' WHEN 'second quarter' THEN 'Q2' WHEN 'third quarter' THEN 'Q3' WHEN 'fourth quarter' THEN 'Q4'
    ELSE upper(regexp_extract(q, '\\b(q[1-4])\\b', 1)) END AS quarter FROM t
"""


@query(_type_sql())
def query_type(spark, sf_dir):
    """E2, E3, E5-E7."""
    return analyze.analyze(questions(spark, sf_dir)).select("qid", "query_type", "requires_calculation", "is_comparison", "explicit_statement", "requested_unit", "comparison_direction", "filing_type", "quarter")


def _concept_sql() -> str:
    found = " || ".join(f"CASE WHEN {sql_any('q', k)} THEN ['{a}'] ELSE [] END" for a, _, k in lx.CONCEPTS)
    ratio = "CASE " + " ".join(f"WHEN {sql_any('q', aliases)} THEN {sql_list(needs)}" for _, aliases, needs, _ in lx.RATIOS) + " ELSE [] END"
    dim = ", ".join(f"('{a}', '{b}', {len(k)})" for a, b, k in lx.CONCEPTS)
    return f"""
WITH {CTE_QUESTIONS}, l AS (SELECT qid, lower(question) AS q FROM questions), f AS (SELECT qid, {found} AS own, {ratio} AS needs FROM l),
c AS (SELECT qid, own, own || list_filter(needs, lambda x: NOT list_contains(own, x)) AS ids FROM f), dim(id, statement, n) AS (VALUES {dim})
SELECT qid, array_to_string(ids, ',') AS concepts, coalesce(own[1], '') AS metric, coalesce((SELECT statement FROM dim WHERE id = ids[1]), 'ANY') AS inferred_statement FROM c
"""


@query(_concept_sql())
def concept_match(spark, sf_dir):
    """E4-E5."""
    return analyze.analyze(questions(spark, sf_dir)).select("qid", F.array_join("concepts", ",").alias("concepts"), "metric", "inferred_statement")


@query(f"""
WITH {CTE_QUESTIONS}, l AS (SELECT qid, question, lower(question) AS q FROM questions),
y AS (SELECT qid, question, q, list_distinct(regexp_extract_all(q, '\\b(?:fy)?(20[0-9]{{2}})\\b', 1)) AS ys FROM l)
SELECT qid, array_to_string(list_sort(CASE WHEN {sql_any('q', lx.PRIOR_YEAR)} THEN list_distinct(ys || list_transform(ys, lambda x: CAST(CAST(x AS INT) - 1 AS VARCHAR))) ELSE ys END), ',') AS years,
  CASE WHEN regexp_extract(question, '\\b([A-Z][A-Za-z0-9&.\\-]{{1,30}})''s\\b', 1) <> '' THEN regexp_extract(question, '\\b([A-Z][A-Za-z0-9&.\\-]{{1,30}})''s\\b', 1)
    ELSE coalesce(list_filter(regexp_extract_all(question, '\\b[A-Z][A-Z0-9&.-]{{1,12}}\\b'), lambda t: NOT list_contains({sql_list(lx.NOT_COMPANIES)}, t) AND NOT regexp_matches(t, '^20[0-9]{{2}}$'))[1], '') END AS company FROM y
""")
def query_years_company(spark, sf_dir):
    """E8-E9."""
    return analyze.analyze(questions(spark, sf_dir)).select("qid", F.array_join(F.array_sort("target_years"), ",").alias("years"), "company")


def _expand_sql() -> str:
    known = {name: (statement, words) for name, statement, words in lx.CONCEPTS}
    case = lambda ok, values: f"CASE WHEN {ok} THEN {sql_list(values)} ELSE [] END"
    own_words = " || ".join(case(sql_any("q", k), k) for _, _, k in lx.CONCEPTS)
    own_statements = " || ".join(case(sql_any("q", k), [s]) for _, s, k in lx.CONCEPTS)
    of_ratio = lambda f: "CASE " + " ".join(f"WHEN {sql_any('q', aliases)} THEN {sql_list(f(needs))}" for _, aliases, needs, _ in lx.RATIOS) + " ELSE [] END"
    extra = [case("query_type = 'DOCUMENT_PURPOSE'", lx.PURPOSE_EVIDENCE)]
    for words, kind, first, second in lx.EXPANSIONS:
        ok = [sql_any("q", first), *([f"query_type = '{kind}'"] if kind != "*" else []), *([sql_any("q", second)] if second else [])]
        extra.append(case(" AND ".join(ok), words))
    once = lambda x: f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"
    return f"""
WITH ty AS ({_type_sql()}), yc AS ({ORACLE_SQL['query_years_company']}), qs AS ({fx.QUESTIONS}), l AS (SELECT qid, question, lower(question) AS q FROM qs),
f AS (SELECT l.*, ty.* EXCLUDE (qid), yc.years, {own_statements} AS own, {of_ratio(lambda needs: [known[n][0] for n in needs])} AS inputs,
  {' || '.join(extra)} || {own_words} || {of_ratio(lambda needs: [w for n in needs for w in known[n][1]])} AS words FROM l JOIN ty USING (qid) JOIN yc USING (qid)),
g AS (SELECT *, CASE WHEN explicit_statement <> 'ANY' THEN [explicit_statement] ELSE [] END || (own || inputs)[1:1] || {case(sql_any('q', lx.MENTIONS_BALANCE), ['BALANCE_SHEET'])} || {case(sql_any('q', lx.MENTIONS_INCOME), ['INCOME_STATEMENT'])} || inputs AS targets,
  list_filter(words, lambda w: NOT contains(q, w)) AS absent,
  is_comparison OR query_type IN ('COMPARISON', 'TREND', 'CALCULATION') OR contains(years, ',') OR {sql_any('q', lx.MULTIPLE)} AS multi_evidence FROM f)
SELECT qid, CASE WHEN len(absent) > 0 THEN question || ' ' || array_to_string({once('absent')}, ' ') ELSE question END AS expanded_query, array_to_string({once('targets')}, ',') AS target_statements,
  multi_evidence, CASE WHEN multi_evidence THEN 10 ELSE 5 END AS context_limit FROM g
"""


@query(_expand_sql())
def query_expand(spark, sf_dir):
    """E10-E13, G9."""
    return analyze.analyze(questions(spark, sf_dir)).select("qid", "expanded_query", F.array_join("target_statements", ",").alias("target_statements"), "multi_evidence", "context_limit")


def _intent_sql() -> str:
    return f"""
WITH ty AS ({_type_sql()}), qs AS ({fx.QUESTIONS}), l AS (SELECT qid, ' ' || lower(question) || ' ' AS q FROM qs)
SELECT qid, is_comparison OR query_type IN ('COMPARISON', 'TREND') OR {sql_any('q', lx.COMPARISON_INTENT)} AS intent,
  is_comparison OR query_type IN ('COMPARISON', 'TREND') OR {sql_any('q', lx.COMPARISON_GATE)} OR regexp_matches(q, '{lx.WHICH_ENTITY}') AS gate FROM l JOIN ty USING (qid)
"""


@query(_intent_sql())
def comparison_intent(spark, sf_dir):
    """What reranking and the gate take for a comparison."""
    return analyze.analyze(questions(spark, sf_dir)).select("qid", analyze.is_comparison_intent(F.col("question")).alias("intent"), analyze.is_comparison_for_gate(F.col("question")).alias("gate"))


def _terms_sql() -> str:
    strip = "trim(t, '$.,%')"
    found = f"list_transform(regexp_extract_all(x, '{lx.TOKEN}'), lambda t: {strip})"
    kept = lambda stop: f"list_filter({found}, lambda t: length(t) >= 3 AND NOT list_contains({sql_list(stop)}, t) AND NOT regexp_matches(t, '^[0-9]+$'))"
    listed = lambda x: f"md5(array_to_string(list_sort(list_distinct({x})), ' '))"
    squeezed = "list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"
    return f"""
WITH d AS (SELECT doc_id, text, lower(text) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, {listed(kept(lx.RELEVANCE_STOP))} AS sought, {listed(kept(lx.GATE_STOP))} AS gate_terms,
  {listed("list_filter(regexp_split_to_array(x, '[^a-z0-9]+'), lambda t: length(t) >= 2)")} AS identity,
  {listed("list_filter(regexp_split_to_array(regexp_replace(x, '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: length(t) > 2)")} AS plain_words,
  CAST(len(list_filter({squeezed}, lambda x: x NOT IN ('', '[TABLE]', '[/TABLE]'))) AS INT) AS n_lines FROM d
"""


@query(_terms_sql())
def text_terms(spark, sf_dir):
    """The term lists of every text, as digests."""
    text = F.col("text")
    listed = lambda x: F.md5(F.array_join(F.array_sort(F.array_distinct(x)), " ").cast("binary"))
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", listed(tx.distinctive(text)).alias("sought"), listed(tx.gate_terms(text)).alias("gate_terms"), listed(tx.identity_tokens(text)).alias("identity"), listed(tx.norm_words(text)).alias("plain_words"), F.size(tx.lines(text)).alias("n_lines")
    )


# --- Evidence. ----------------------------------------------------------------------------------------------------------


def stored_chunks(spark, sf_dir) -> DataFrame:
    """Chunks as the engine keeps them: written once with their types and units."""
    return staged(typed(chunks(spark, sf_dir)).drop("_s"), "chunks")


def analysed(spark, sf_dir) -> DataFrame:
    return staged(analyze.analyze(questions(spark, sf_dir)), "asked")


BLOCK = 10
CTE_CASES = "CAST(qid * 1000000 + chunk_index // 10 AS BIGINT)"


def gate_cases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every question against every ten chunks in a row of its filing: analysed questions and their passages."""
    chunk = typed(chunks(spark, sf_dir)).drop("_s").withColumns({"block": F.expr(f"chunk_index div {BLOCK}"), "final_rank": F.col("chunk_index") % BLOCK + 1, "concept_matched": F.lit(False)})
    asked = analyze.analyze(questions(spark, sf_dir))
    case = (F.col("qid") * 1_000_000 + F.col("block")).alias("qid")
    blocks = asked.join(chunk.select("doc_name", "block").distinct(), "doc_name")
    passages = chunk.join(asked.select("qid", "doc_name"), "doc_name").select(case, *[c for c in chunk.columns if c != "block"])
    return blocks.select(case, *[c for c in asked.columns if c != "qid"]), passages


def _cases_sql() -> str:
    """CTEs of gate_cases: asked (one row a question), passages."""
    known = {name: words for name, _, words in lx.CONCEPTS}
    terms = " || ".join(f"CASE WHEN {sql_any('q', k)} THEN {sql_list(k)} ELSE [] END" for k in known.values())
    needs = "CASE " + " ".join(f"WHEN {sql_any('q', aliases)} THEN {sql_list([w for n in ids for w in known[n]])}" for _, aliases, ids, _ in lx.RATIOS) + " ELSE [] END"
    found = lambda x: f"list_filter(list_transform(regexp_extract_all(lower({x}), '{lx.TOKEN}'), lambda u: trim(u, '$.,%')), lambda u: length(u) >= 3 AND NOT list_contains({sql_list(lx.GATE_STOP)}, u) AND NOT regexp_matches(u, '^[0-9]+$'))"
    split = lambda x: f"list_filter(string_split({x}, ','), lambda e: e <> '')"
    once = lambda x: f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"
    columns = "section, subsection, statement_title, table_title, table_context, statement_type, chunk_type, units, text"
    return f"""
ty AS ({_type_sql()}), ex AS ({ORACLE_SQL['query_expand']}), cm AS ({ORACLE_SQL['concept_match']}), ci AS ({ORACLE_SQL['comparison_intent']}), qs AS ({fx.QUESTIONS}),
l AS (SELECT qid, doc_name, lower(question) AS q FROM qs), y AS (SELECT *, {once("regexp_extract_all(q, '\\b(?:fy)?(20[0-9]{2})\\b', 1)")} AS stated FROM l),
w AS (SELECT y.* EXCLUDE (stated), list_distinct({terms} || {needs}) AS terms,
  stated || CASE WHEN {sql_any('q', lx.PRIOR_YEAR)} THEN list_filter(list_transform(stated, lambda x: CAST(CAST(x AS INT) - 1 AS VARCHAR)), lambda x: NOT list_contains(stated, x)) ELSE [] END AS ys FROM y),
asked AS (SELECT w.*, ty.* EXCLUDE (qid, is_comparison), {split('ex.target_statements')} AS targets, ex.context_limit, {split('cm.concepts')} AS ids, cm.metric, ci.gate AS compares,
  list_filter(list_distinct({found('q')}), lambda g: NOT list_contains(flatten(list_transform(list_filter(terms, lambda t: contains(q, t)), lambda t: {found('t')})), g)) AS wanted
  FROM w JOIN ty USING (qid) JOIN ex USING (qid) JOIN cm USING (qid) JOIN ci USING (qid)),
ch AS ({fx.CHUNKS}), st AS ({ORACLE_SQL['structure_scores']}),
passages AS (SELECT {CTE_CASES} AS cid, asked.*, ch.* EXCLUDE (doc_name), st.statement_type, st.units, chunk_index % 10 + 1 AS final_rank, lower(concat_ws(' ', {', '.join(f"coalesce({c}, '')" for c in columns.split(', '))})) AS search
  FROM ch JOIN st USING (doc_name, chunk_index) JOIN asked USING (doc_name))"""


def _gate_sql() -> str:
    kw = "[" + ", ".join(f"{{'id': '{n}', 'k': {sql_list(k)}}}" for n, _, k in lx.CONCEPTS) + "]"

    def said(rule: str, missing: str | None = None) -> str:
        before, _, after = f"Rule Failed [{rule}]: {lx.GATE_REASONS[rule]}".partition("{}")
        return quoted(before) if missing is None else f"{quoted(before)} || {missing} || {quoted(after)}"

    return f"""
WITH {_cases_sql()}, kw AS (SELECT {kw} AS kw),
first AS (SELECT *, regexp_replace(text, {quoted(lx.PLACE_NUMBER.removeprefix('(?i)'))}, '', 'gi') AS clean FROM passages, kw WHERE final_rank <= context_limit),
f AS (SELECT cid, any_value(qid) AS qid, bool_or(len(list_filter(terms, lambda t: contains(lower(text), t) OR contains(lower(table_title), t))) > 0) AS concept,
  flatten(list(list_transform(list_filter(kw, lambda c: list_contains(ids, c.id) AND len(list_filter(c.k, lambda k: contains(search, k))) > 0), lambda c: c.id))) AS inputs,
  bool_or(statement_type = explicit_statement OR contains(upper(section), explicit_statement)) AS statement, list(statement_type) AS statements, flatten(list(list_filter(wanted, lambda t: contains(search, t)))) AS met,
  bool_or({sql_any('search', lx.PURPOSE_EVIDENCE)}) AS purpose, bool_or(len(list_filter(ys, lambda y: contains(search, y))) > 0) AS period,
  bool_or(len(list_filter(regexp_extract_all(clean, {quoted(lx.NUMBER_IN_TEXT)}), lambda n: NOT list_contains(ys, n))) > 0 OR contains(clean, '$') OR contains(clean, '(')) AS value FROM first GROUP BY cid),
g AS (SELECT f.*, asked.* EXCLUDE (qid), list_filter(ids, lambda c: NOT list_contains(inputs, c)) AS no_inputs, list_filter(targets, lambda s: NOT list_contains(statements, s)) AS no_statements, len(terms) > 0 OR len(ids) > 0 AS named FROM f JOIN asked USING (qid)),
r AS (SELECT *, CASE WHEN named AND NOT concept THEN {said('Concept Rule', "CASE WHEN len(ids) > 0 THEN array_to_string(ids, ', ') ELSE 'requested concept' END")}
  WHEN named AND requires_calculation AND len(ids) > 1 AND len(no_inputs) > 0 THEN {said('Calculation Inputs', "array_to_string(no_inputs, ', ')")}
  WHEN explicit_statement <> 'ANY' AND NOT statement THEN {said('Statement Rule', 'explicit_statement')}
  WHEN requires_calculation AND len(no_statements) > 0 THEN {said('Calculation Statements', "array_to_string(no_statements, ', ')")}
  WHEN compares AND len(wanted) > 0 AND len(list_distinct(met)) < CASE WHEN len(wanted) <= 2 THEN 1 ELSE 2 END THEN {said('Comparison Rule')}
  WHEN query_type = 'DOCUMENT_PURPOSE' AND NOT purpose THEN {said('Document Purpose Rule')}
  WHEN len(ys) > 0 AND NOT period THEN {said('Period Rule', "array_to_string(ys, ', ')")}
  WHEN query_type IN ('NUMERIC_LOOKUP', 'CALCULATION') AND NOT value THEN {said('Value Rule')} END AS failed FROM g)
SELECT cid AS qid, CASE WHEN failed IS NULL THEN 'SUFFICIENT_EVIDENCE' ELSE 'WEAK_EVIDENCE' END AS gate_status, split_part(split_part(failed, '[', 2), ']', 1) AS rule,
  coalesce(failed, CASE WHEN query_type = 'DOCUMENT_PURPOSE' THEN {quoted(lx.PURPOSE_PASSED)} WHEN compares THEN {quoted(lx.COMPARISON_PASSED)} ELSE {quoted(lx.ALL_PASSED)} END) AS said FROM r
"""


@query(_gate_sql())
def gate_chunks(spark, sf_dir):
    """The verdict on every ten chunks in a row of each question's filing."""
    got = gate.gate(*gate_cases(spark, sf_dir))
    rule = F.when(F.col("gate_status") == "WEAK_EVIDENCE", F.regexp_extract("gate_reason", r"\[(.*?)\]", 1))
    return got.select("qid", "gate_status", rule.alias("rule"), F.col("gate_reason").alias("said"))


def _notes_sql() -> str:
    squeezed = "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x NOT IN ('', '[TABLE]', '[/TABLE]'))"
    once = lambda x: f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"
    number = quoted(lx.NOTE_NUMBER)
    return f"""
WITH {_cases_sql()}, a AS (SELECT *, {squeezed} AS ls FROM passages), b AS (SELECT *, unnest(range(1, len(ls) + 1)) AS place FROM a), c AS (SELECT *, ls[place] AS line, lower(ls[place]) AS low FROM b),
s AS (SELECT *, CASE WHEN len(list_filter(ys, lambda y: contains(low, y))) > 0 THEN 4 ELSE 0 END + CASE WHEN len(list_filter(terms, lambda t: contains(low, t))) > 0 THEN 5 ELSE 0 END
  + CASE WHEN len(ids) > 0 AND contains(low, lower(metric)) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(line, {number}) THEN 2 ELSE 0 END + CASE WHEN {sql_any('low', lx.EVIDENCE_WORDS)} THEN 1 ELSE 0 END AS score FROM c),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid, final_rank ORDER BY score DESC, place) AS k FROM s WHERE score > 0) WHERE k <= 3),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid, page_num, line ORDER BY final_rank, k) AS d FROM k) WHERE d = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY final_rank, k) AS note_no FROM d)
SELECT cid AS qid, CAST(note_no AS INT) AS note_no, page_num, upper(chunk_type) AS evidence_type, line[1:500] AS line, CAST(score AS INT) AS score,
  array_to_string({once("regexp_extract_all(line, '(?:^|[^0-9])(20[0-9]{2})(?:[^0-9]|$)', 1)")}, ', ') AS years, array_to_string({once(f"regexp_extract_all(line, {number})")}, ', ') AS values FROM n WHERE note_no <= 12
"""


@query(_notes_sql())
def note_lines(spark, sf_dir):
    """The evidence notes of every ten chunks in a row of each question's filing."""
    asked, passages = gate_cases(spark, sf_dir)
    return gate.evidence_notes(passages.join(asked.select("qid", "target_years", "terms", "concepts", "metric"), "qid"))


def _passages(spark, sf_dir) -> DataFrame:
    return pipeline.evidence(analysed(spark, sf_dir), stored_chunks(spark, sf_dir))


@query()
def rerank_scores(spark, sf_dir):
    """Ranked passages of every question, end to end."""
    return _passages(spark, sf_dir).select("qid", "doc_name", "chunk_index", "final_rank", "rrf", "rerank_score", "content_evidence_score", "metadata_boost", "concept_matched", "backfilled")


@query()
def gate_rules(spark, sf_dir):
    """H1-H11 over the passages of every question."""
    asked = analysed(spark, sf_dir)
    return gate.gate(asked, staged(pipeline.evidence(asked, stored_chunks(spark, sf_dir)), "passages"))


@query()
def evidence_lines(spark, sf_dir):
    """H12-H13."""
    p = _passages(spark, sf_dir)
    return gate.evidence_notes(p.where(F.col("final_rank") <= F.col("context_limit")))


@query(f"""
WITH {CTE_CHUNKS}, n AS (SELECT doc_name, chunk_index, section, page_num, text, lag(section) OVER w AS s0, lag(page_num) OVER w AS p0, lag(text) OVER w AS t0, lead(section) OVER w AS s1, lead(page_num) OVER w AS p1, lead(text) OVER w AS t1
  FROM chunks WINDOW w AS (PARTITION BY doc_name ORDER BY chunk_index)),
m AS (SELECT doc_name, chunk_index, text, CASE WHEN s0 = section OR p0 = page_num THEN t0 END AS a, CASE WHEN s1 = section OR p1 = page_num THEN t1 END AS b FROM n)
SELECT doc_name, chunk_index, md5(concat_ws(chr(10) || chr(10), a, CASE WHEN text IS DISTINCT FROM a THEN text END, CASE WHEN b IS DISTINCT FROM text AND b IS DISTINCT FROM a THEN b END)) AS digest FROM m
""")
def neighbor_expand(spark, sf_dir):
    """G8."""
    return fuse.neighbours(chunks(spark, sf_dir)).select("doc_name", "chunk_index", F.md5(F.col("merged_text").cast("binary")).alias("digest"))


META = "SELECT DISTINCT doc_name, substr(doc_name, 1, strpos(doc_name, '_') - 1) AS company, '10-K' AS filing_type, substr(doc_name, strpos(doc_name, '_') + 1, 4) AS fiscal_year, lower(doc_name) || '.htm' AS source_filename FROM chunks"


def meta(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).select("doc_name").distinct()
    part = F.split("doc_name", "_")
    return c.select("doc_name", part[0].alias("company"), F.lit("10-K").alias("filing_type"), part[1].alias("fiscal_year"), F.concat(F.lower("doc_name"), F.lit(".htm")).alias("source_filename"))


@query(f"""
WITH {CTE_CHUNKS}, {CTE_QUESTIONS}, meta AS ({META}),
q AS (SELECT qid, lower(question) AS q, list_distinct(list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda t: length(t) >= 2) || list_transform(regexp_extract_all(lower(question), '(?:^|[^0-9])20[0-9]{{2}}'), lambda x: x[-4:])) AS toks,
  list_distinct(list_transform(regexp_extract_all(lower(question), '(?:^|[^0-9])20[0-9]{{2}}'), lambda x: x[-4:])) AS ys FROM questions),
s AS (SELECT qid, doc_name, CAST(CASE WHEN contains(q, lower(doc_name)) THEN 18 ELSE 0 END + 3 * len(list_filter([lower(company)], lambda t: list_contains(toks, t)))
  + len(list_filter(string_split(lower(doc_name), '_'), lambda t: list_contains(toks, t))) + 1.5 * len(list_filter([fiscal_year], lambda t: list_contains(ys, t)))
  + CASE WHEN contains(q, '10-k') THEN 1 ELSE 0 END + CASE WHEN contains(q, '10k') THEN 1 ELSE 0 END AS DOUBLE) AS doc_match_score FROM q, meta)
SELECT qid, doc_name, doc_match_score FROM (SELECT *, max(doc_match_score) OVER (PARTITION BY qid) AS best FROM s) WHERE best < 3 OR doc_match_score = best
""")
def doc_routing(spark, sf_dir):
    """G1-G2."""
    return fuse.route(fuse.match_scores(questions(spark, sf_dir), meta(spark, sf_dir)))


# --- Answers and grades. --------------------------------------------------------------------------------------------------


@query()
def parse_answers(spark, sf_dir):
    """J1-J2."""
    r = fx.made(spark, sf_dir, fx.REPLIES, "part")
    top = r.select("qid", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("final_rank")).withColumns({"doc_name": F.concat(F.lit("D"), "final_rank"), "page_num": (F.col("qid") % 7 + F.col("final_rank")).cast("int"), "text": F.concat(F.lit("text "), "final_rank")})
    out = answer.parse_answers(r, top)
    return out.select("qid", "found", "answer", "page_num", "evidence_text", F.size("sources").alias("n_sources"), F.size("metrics").alias("n_metrics"), F.get("metrics", F.lit(0))["label"].alias("label"), F.get("metrics", F.lit(0))["period"].alias("period"))


ORACLE_SQL["parse_answers"] = f"""
WITH r AS ({fx.REPLIES}), p AS (SELECT r.*, p_partkey % 6 AS k, p_name, p_brand, p_type, p_size FROM r JOIN part ON qid = p_partkey)
SELECT qid, k NOT IN (1, 4) AS found, CASE k WHEN 0 THEN p_name WHEN 2 THEN concat(p_type, chr(10), 'CALCULATION: 1 + 1') WHEN 3 THEN concat(p_brand, ' without a source') WHEN 5 THEN concat('multi', chr(10), chr(10), 'line ', p_type) END AS answer,
  CAST(CASE k WHEN 0 THEN p_size WHEN 2 THEN qid % 7 + 2 WHEN 3 THEN qid % 7 + 1 WHEN 5 THEN 12 END AS INT) AS page_num, CASE k WHEN 0 THEN p_type WHEN 2 THEN p_name WHEN 3 THEN 'text 1' WHEN 5 THEN p_name END AS evidence_text,
  CAST(CASE k WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS INT) AS n_sources, CAST(CASE k WHEN 0 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 5 THEN 0 END AS INT) AS n_metrics,
  CASE WHEN k = 0 THEN 'Price' END AS label, CASE WHEN k = 0 THEN 'FY2020' END AS period FROM p
"""


@query(f"""
WITH a AS ({fx.ANSWERS}), n AS (SELECT *, {{0}} AS pn, {{1}} AS gn FROM a)
SELECT qid, CASE WHEN len(gn) = 0 THEN NULL ELSE len(list_filter(gn, lambda g: len(list_filter(pn, lambda p: abs(p - g) <= greatest(1e-9, abs(g) * 0.01))) > 0)) > 0 END AS same FROM n
""".replace("{0}", "list_transform(regexp_extract_all(predicted || ' ', '(-?\\$?\\d[\\d,]*\\.?\\d*%?)(?:[^\\w]|$)', 1), lambda x: CAST(rtrim(replace(replace(x, ',', ''), '$', ''), '%') AS DOUBLE))").replace("{1}", "list_transform(regexp_extract_all(gold || ' ', '(-?\\$?\\d[\\d,]*\\.?\\d*%?)(?:[^\\w]|$)', 1), lambda x: CAST(rtrim(replace(replace(x, ',', ''), '$', ''), '%') AS DOUBLE))"))
def numeric_equivalent(spark, sf_dir):
    """K2."""
    return fx.made(spark, sf_dir, fx.ANSWERS, "part").select("qid", grade.numeric_equivalent(F.col("predicted"), F.col("gold")).alias("same"))


def _graded(spark, sf_dir) -> DataFrame:
    a = fx.made(spark, sf_dir, fx.ANSWERS, "part")
    return grade.rubric(a.withColumns({"correct": grade.answers_match(F.col("predicted"), F.col("gold")), "pages": F.array("page")}))


#: the grader's numbers without the lookahead that DuckDB lacks: the sign behind a number is taken too
SQL_NUMBER = "(-?\\$?\\d[\\d,]*\\.?\\d*%?)(?:[^\\w]|$)"


def _grades_sql() -> str:
    plain = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\w\\s.%$-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    raw = lambda x: f"regexp_extract_all({x} || ' ', '{SQL_NUMBER}', 1)"
    nums = lambda x: f"list_filter(list_distinct(list_transform({raw(x)}, lambda n: replace(replace(n, ',', ''), '$', ''))), lambda n: n NOT IN ('', '-', '.'))"
    values = lambda x: f"list_filter(list_transform({x}, lambda n: TRY_CAST(rtrim(n, '%') AS DOUBLE)), lambda v: v IS NOT NULL)"
    verdict = lambda x: f"CASE WHEN regexp_matches(trim(lower({x})), '^yes\\b') THEN 'yes' WHEN regexp_matches(trim(lower({x})), '^no\\b') THEN 'no' END"
    long_words = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) > 3))"
    return f"""
WITH a AS (SELECT qid, coalesce(predicted, '') AS predicted, coalesce(gold, '') AS gold FROM ({fx.ANSWERS})),
n AS (SELECT *, {plain('predicted')} AS p, {plain('gold')} AS g, {nums('predicted')} AS pn, {nums('gold')} AS gn, {verdict('predicted')} AS py, {verdict('gold')} AS gy,
  {raw('predicted')} AS found, regexp_split_to_array(predicted || ' ', '{SQL_NUMBER}') AS between FROM a),
v AS (SELECT *, {values('pn')} AS pv, {values('gn')} AS gv, {long_words('p')} AS pw, {long_words('g')} AS gw,
  list_transform(range(1, len(found) + 1), lambda i: {{'x': TRY_CAST(rtrim(replace(replace(found[i], ',', ''), '$', ''), '%') AS DOUBLE), 'at': list_sum(list_transform(between[1:i], lambda b: length(b))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f) + 1)), 0)}}) AS placed FROM n),
s AS (SELECT *, len(list_intersect(gw, pw)) AS shared, len(list_intersect(gw, pw)) / greatest(len(gw), 1) AS part, len(gn) > 0 AND len(pn) > 0 AS numbered FROM v)
SELECT qid, CASE WHEN predicted = '' OR gold = '' THEN FALSE WHEN p = g OR contains(p, g) OR contains(g, p) THEN TRUE WHEN coalesce(gy <> py, FALSE) THEN FALSE WHEN len(list_intersect(pn, gn)) > 0 THEN TRUE
  WHEN numbered AND len(list_filter(gv, lambda y: len(list_filter(pv, lambda x: abs(x - y) <= greatest(0.01, abs(y) * 0.01))) > 0)) > 0 THEN TRUE
  WHEN numbered AND len(list_filter(gv, lambda y: len(list_filter(placed, lambda b: len(list_filter(placed, lambda c: c['at'] > b['at'] AND c['at'] - b['at'] <= 40 AND abs(abs(b['x'] - c['x']) - abs(y)) <= greatest(0.15, abs(y) * 0.15))) > 0)) > 0)) > 0 THEN TRUE
  WHEN len(gw) = 0 OR len(gn) > 0 THEN FALSE WHEN part >= 0.6 THEN TRUE WHEN coalesce(gy = py, FALSE) AND part >= 0.3 AND shared >= 2 THEN TRUE
  WHEN gy IS NULL AND py IS NULL AND part >= 0.4 AND shared >= 2 THEN TRUE ELSE FALSE END AS correct,
  length(regexp_replace(regexp_replace(gold || ' ', '{SQL_NUMBER}', '', 'g'), '[^\\w]', '', 'g')) <= 6 AS numeric_gold FROM s
"""


@query(_grades_sql())
def answer_grades(spark, sf_dir):
    """The whole matcher, with differences of near numbers."""
    a = fx.made(spark, sf_dir, fx.ANSWERS, "part")
    return a.select("qid", grade.answers_match(F.col("predicted"), F.col("gold")).alias("correct"), grade.purely_numeric(F.col("gold")).alias("numeric_gold"))


@query(f"""
WITH a AS ({fx.ANSWERS}), g AS (SELECT doc_name, CASE WHEN NOT found THEN '0_not_found' WHEN NOT (predicted = gold) THEN '-1' WHEN page <> gold_page THEN '0_wrong_page' ELSE '+1' END AS reason FROM
  (SELECT doc_name, found, gold_page, page, lower(predicted) AS predicted, CASE WHEN qid % 2 = 0 THEN lower(predicted) ELSE 'other' END AS gold FROM a)),
p AS (SELECT *, CASE reason WHEN '+1' THEN 1 WHEN '-1' THEN -1 ELSE 0 END AS points FROM g)
SELECT doc_name, reason, count(*) AS n, sum(points) AS points, round(avg(points), 6) AS mean_points FROM p GROUP BY ROLLUP (doc_name, reason)
""")
def rubric_rollup(spark, sf_dir):
    """K6-K7, summed by filing and reason."""
    a = fx.made(spark, sf_dir, fx.ANSWERS, "part").withColumns({"correct": F.col("qid") % 2 == 0, "pages": F.array("page")})
    return grade.summary(grade.rubric(a), ["doc_name"]).withColumn("points", F.col("points").cast("long"))


@query("""
WITH t AS (SELECT conv_id AS qid, turn AS chunk_index, length(text) AS n FROM conversations), a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, chunk_index) AS r FROM t)
SELECT qid, chunk_index, 'rrf' AS stage FROM a WHERE r > 6 UNION ALL SELECT qid, chunk_index, 'context' AS stage FROM a WHERE r <= 6 AND r > 3
""")
def stage_drop(spark, sf_dir):
    """What each stage of a cascade lost."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("chunk_index"), F.length("text").alias("score"))
    order = [F.desc("score"), F.asc("chunk_index")]
    return grade.stage_drops([("all", t), ("rrf", index.ranked(t, 6, order, ["qid"])), ("context", index.ranked(t, 3, order, ["qid"]))], ["qid", "chunk_index"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def rerun_subset(spark, sf_dir):
    """The documents that an earlier run did not score (semi join)."""
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi")


@query("SELECT source AS doc_name, count(*) AS n_missing, min(doc_id) AS first_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def gap_report(spark, sf_dir):
    """What is there but not indexed (anti join)."""
    gone = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return gone.groupBy(F.col("source").alias("doc_name")).agg(F.count("*").alias("n_missing"), F.min("doc_id").alias("first_missing"))


@query(f"WITH {CTE_CHUNKS} SELECT doc_name, count(*) AS chunk_count, min(page_num) AS first_page, max(page_num) AS last_page, count(*) FILTER (WHERE chunk_type = 'table') AS n_tables FROM chunks GROUP BY 1")
def list_filings(spark, sf_dir):
    """M1."""
    return chunks(spark, sf_dir).groupBy("doc_name").agg(F.count("*").alias("chunk_count"), F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"), F.count_if(F.col("chunk_type") == "table").alias("n_tables"))


@query(f"WITH {CTE_CHUNKS} SELECT doc_name, page_num, string_agg(text[1:200], chr(10) ORDER BY chunk_index) AS preview FROM chunks GROUP BY 1, 2")
def page_projection(spark, sf_dir):
    """M2, M4: every page's chunks in order, as previews."""
    c = chunks(spark, sf_dir)
    return c.groupBy("doc_name", "page_num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", F.substring("text", 1, 200).alias("t")))), lambda x: x["t"]), "\n").alias("preview"))


@query(f"""
WITH b AS (SELECT o_custkey % 40 AS qid, o_orderkey AS final_rank, o_orderkey % 2 = 0 AS c, o_orderkey % 3 = 0 AS p, o_orderkey % 5 <> 0 AS n, round(o_totalprice / 5000, 4) AS e, round(o_totalprice, 2) AS r FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, p DESC, n DESC, e DESC, r DESC, final_rank) AS k FROM b)
SELECT qid, final_rank, CASE WHEN c AND p AND n THEN 0.98 WHEN c OR e > 40 THEN 0.95 ELSE 0.9 END AS confidence,
  round(0.5 * CASE WHEN c AND p AND n THEN 0.99 WHEN c OR e > 40 THEN 0.95 ELSE 0.88 END + 0.3 * CASE WHEN final_rank % 4 = 0 THEN 0.98 ELSE 0.8 END + 0.2, 2) AS overall FROM k WHERE k = 1
""".replace("THEN 0.98 WHEN c OR e > 40 THEN 0.95 ELSE 0.9 END AS confidence", "THEN CAST(0.98 AS DOUBLE) WHEN c OR e > 40 THEN 0.95 ELSE 0.9 END AS confidence").replace("round(0.5 * CASE", "round(CAST(0.5 AS DOUBLE) * CASE"))
def best_passage(spark, sf_dir):
    """J3-J4."""
    o = read(spark, sf_dir, "orders")
    b = o.select(
        (F.col("o_custkey") % 40).alias("qid"), F.col("o_orderkey").alias("final_rank"), (F.col("o_orderkey") % 2 == 0).alias("concept_matched"), (F.col("o_orderkey") % 3 == 0).alias("has_period_match"), (F.col("o_orderkey") % 5 != 0).alias("has_numeric_value"),
        F.round(F.col("o_totalprice") / 5000, 4).alias("content_evidence_score"), F.round("o_totalprice", 2).alias("rerank_score"), F.lit("table").alias("chunk_type"), F.lit("").alias("statement_type"), F.lit(3).alias("page_num"),
        F.lit(3).alias("source_page"), F.when(F.col("o_orderkey") % 4 == 0, "Item 8").alias("location"),
    )
    return answer.score_breakdown(answer.confidence(answer.best_passages(b))).select("qid", "final_rank", "confidence", "overall")


@query()
def enrich_sources(spark, sf_dir):
    """A citation of every ranked passage's beginning, matched back to the ranked passages of its question."""
    columns = ["qid", "final_rank", "doc_name", "page_num", "text", "chunk_type", "section", "subsection", "statement_title", "table_title"]
    passages = staged(_passages(spark, sf_dir).select(*columns), "passages")
    cited = passages.select("qid", F.col("final_rank").alias("source_no"), F.lit(None).cast("string").alias("doc_name"), "page_num", F.substring("text", 1, 60).alias("evidence_text"))
    return answer.enrich_sources(cited, passages)


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS n_keys, max(length(props)) AS longest FROM events GROUP BY 1")
def props_json(spark, sf_dir):
    """Trace records' JSON, read with a schema."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_keys"), F.max(F.length("props")).cast("long").alias("longest"))


@query()
def ask_questions(spark, sf_dir):
    """The whole path from questions to gated passages."""
    return pipeline.ask(questions(spark, sf_dir), stored_chunks(spark, sf_dir)).select("qid", "doc_name", "gate_status", "gate_reason", F.size("passages").alias("n_passages"))
