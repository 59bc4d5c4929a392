"""Operator 7, benchmark decontamination by a distributed positional inverted index (native).

The index holds postings (term, doc_id, pos) of training tokens. It is sharded by document, as the scan
deals documents, so a term that stands in every document is spread over all shards instead of
being one task's list; building it shuffles nothing. Only terms of the test items are stored (or
all, if no terms are given), plus one end mark per document, the empty term at the position after the last
word, which carries the document's length.

A phrase query takes, for every window of an item, its two rarest terms by their counts in the corpus.
Each of their postings, less the term's offset in the item, is the place where the item
would begin; places that two lists share (or one, for windows of one word) survive the intersection.
The survivors are confirmed word by word against the document, which gives the exact windows.

The item terms are joined by Spark's own choice: they are written first, so that their size is known, and
broadcast only below spark.sql.autoBroadcastJoinThreshold.

Cases: a null or wordless text has no words and is hit by nothing; a null or wordless item has no windows; a null
doc_id or item_id takes part in nothing; rows that repeat a doc_id share their hits, and repeated items count
once; empty tables give empty or unhit results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII other than letters and digits separates words.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
END = ""


def words(text: Column) -> Column:
    """The words of a text: runs of a-z, 0-9 and whatever lies beyond ASCII, A-Z lower-cased."""
    plain = F.trim(F.translate(text, UPPER + BREAKS, LOWER + " " * len(BREAKS)))
    return F.when(F.length(plain) > 0, F.split(plain, " +")).otherwise(F.array().cast("array<string>"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (term, doc_id, pos) of docs, of the given terms or of all."""
    tokens = docs.select(docs[id_col].cast("long").alias("doc_id"), F.posexplode(F.concat(words(docs[text_col].cast("string")), F.array(F.lit(END)))).alias("pos", "term"))
    if terms is not None:
        kept = stored(terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct(), "terms")
        tokens = tokens.join(kept, "term", "left_semi")
    return stored(tokens.select("term", "doc_id", "pos"), "postings")


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words, len and a key of its own (item_key) of each distinct item with words; one item_id may have several texts."""
    w = items.select(items[id_col].alias("item_id"), words(items[text_col].cast("string")).alias("item_words")).where("item_id is not null and size(item_words) > 0")
    return stored(w.distinct().withColumns({"len": F.size("item_words"), "item_key": F.monotonically_increasing_id()}), "items")


def term_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("freq"))


def anchors(items: DataFrame, freq: DataFrame, window: int, rarest: int = 2) -> DataFrame:
    """item_id, ip, term, need: the positions of the rarest terms of each window of each item."""
    places = items.select("item_id", "len", F.least(F.lit(window), "len").alias("w"), F.posexplode("item_words").alias("ip", "term"))
    known = places.join(freq, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    # the windows that a position lies in
    counted = known.withColumn("s", F.explode(F.expr("sequence(greatest(0, ip - w + 1), least(ip, len - w))")))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("item_id", "s").orderBy("freq", "ip")))
    return stored(ranked.where(F.col("k") <= rarest).select("item_id", "ip", "term", F.least(F.lit(rarest), "w").alias("need")).distinct(), "anchors")


def phrase_matches(docs: DataFrame, postings: DataFrame, items: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, hits (word positions of the document inside exact occurrences of the item's windows)."""
    ids = items.select("item_key", F.col("item_id").alias("said_id"))
    items = items.select(F.col("item_key").alias("item_id"), "item_words", "len")
    picked = anchors(items, term_counts(postings), window)
    lists = postings.join(picked, "term").select("item_id", "doc_id", (F.col("pos") - F.col("ip")).alias("begin"), "ip", "need")
    met = lists.groupBy("item_id", "doc_id", "begin").agg(F.count_distinct("ip").alias("n"), F.max("need").alias("need")).where("n >= need").select("item_id", "doc_id", "begin")
    met = stored(met, "met").join(items, "item_id")
    named = stored(met.select("doc_id").distinct(), "named")
    found = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).join(named, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("doc_words"))
    agreed = met.join(found, "doc_id").select(
        "doc_id", "item_id", "begin", "len", F.least(F.lit(window), "len").alias("w"),
        F.expr("array_join(transform(item_words, (x, i) -> if(begin + i >= 0 and begin + i < size(doc_words) and get(doc_words, begin + i) = x, '1', '0')), '')").alias("bits"),
    )
    windows = agreed.withColumn("starts", F.expr("filter(sequence(0, len - w), s -> substring(bits, s + 1, w) = repeat('1', w))")).where("size(starts) > 0")
    return windows.join(ids, windows.item_id == ids.item_key).select("doc_id", F.col("said_id").alias("item_id"), F.expr("transform(filter(sequence(0, len - 1), i -> exists(starts, s -> s <= i and i < s + w)), i -> begin + i)").alias("hits"))


def proximity_matches(postings: DataFrame, items: DataFrame, *, span: int, rarest: int = 3) -> DataFrame:
    """doc_id, item_id, pos: places of an item's rarest term with its `rarest` rarest distinct terms within `span` words.

    The terms near an occurrence are looked up by (item, document, block of span words), so no
    list is held against another as a whole.
    """
    freq = term_counts(postings)
    each = items.select("item_id", F.explode(F.array_distinct("item_words")).alias("term")).join(freq, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    w = Window.partitionBy("item_id")
    top = each.withColumn("k", F.row_number().over(w.orderBy("freq", "term"))).where(F.col("k") <= rarest)
    top = stored(top.withColumn("need", F.count("*").over(w)).select("item_id", "term", "k", "need"), "rarest")
    lists = postings.join(top, "term").select("item_id", "doc_id", "pos", "k", "need", F.expr(f"pos div {span}").alias("block"))
    first = lists.where("k = 1").select("item_id", "doc_id", F.col("pos").alias("at"), "need", F.explode(F.expr("array(block - 1, block, block + 1)")).alias("block"))
    near = first.join(lists.select("item_id", "doc_id", "block", "pos", "k"), ["item_id", "doc_id", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= span)
    return near.groupBy("item_id", "doc_id", "at").agg(F.count_distinct("k").alias("n"), F.max("need").alias("need")).where("n = need").select("doc_id", "item_id", F.col("at").alias("pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = item_terms(benchmark)
    postings = build_index(docs, items.select(F.explode("item_words").alias("term")))
    hits = stored(phrase_matches(docs, postings, items, window=window), "hits")
    # places and items are each made distinct as rows, so that no document's hits are held as a list
    n_hits = hits.select("doc_id", F.explode("hits").alias("at")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    hit_by = hits.groupBy("doc_id").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    per_doc = n_hits.join(hit_by, "doc_id")
    lengths = postings.where(F.col("term") == END).select("doc_id", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return lengths.join(per_doc, "doc_id", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.sort_array("items"), ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, dw.n, s FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
