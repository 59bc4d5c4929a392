"""Where filings, questions and indexes are read from and written to."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("chunks", "postings", "corpus_stats", "term_stats", "vectors", "filing_meta")


def _stem(col: str):
    return F.regexp_replace(F.col(col), r"(?i)\.html?$", "")


def _decoded():
    """bytes to text; what is no UTF-8 is left out."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    return decoded


def read_filings(spark: SparkSession, folder: str, *, stream: bool = False) -> DataFrame:
    """doc_name, source_filename, html of the .htm and .html files in a folder; undecodable bytes are dropped."""
    reader = spark.readStream if stream else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = reader.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[hH][tT][mM]*").load(folder)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("source_filename"), "content").where(F.col("source_filename").rlike(r"(?i)\.html?$"))
    return named.select(_stem("source_filename").alias("doc_name"), "source_filename", _decoded()("content").alias("html"))


def list_files(spark: SparkSession, folder: str, glob: str = "*.htm*") -> DataFrame:
    """doc_name and length of files without reading them (content is pruned)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.html?$", "").alias("doc_name"), "length")


def read_questions(spark: SparkSession, path: str, *, doc_name: str | None = None, newest_first: bool = False, limit: int | None = None) -> DataFrame:
    """Questions of a JSON-lines file with their line numbers; the order is turned before the limit."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n")).alias("line_no", "value")).where("trim(value) <> ''")
    schema = (
        "financebench_id string, doc_name string, question string, answer string, company string, doc_period string, doc_type string, "
        "evidence array<struct<evidence_text: string, evidence_text_full_page: string, evidence_page_num: int>>"
    )
    out = lines.select((F.col("line_no") + 1).alias("line_no"), F.from_json("value", schema).alias("q")).select("line_no", "q.*")
    if doc_name is not None:
        out = out.where(F.col("doc_name") == doc_name)
    if limit is not None:
        out = out.orderBy(F.desc("line_no") if newest_first else F.asc("line_no")).limit(limit)
    return out


def save(df: DataFrame, root: str, name: str) -> None:
    """Replace the filings of df in a table; other filings stay (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_name").parquet(f"{root}/{name}")


def remove(spark: SparkSession, root: str, name: str, doc_names: DataFrame) -> None:
    """Drop the folders of filings (doc_name) from a table; names come to the driver one partition at a time."""
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in doc_names.select("doc_name").distinct().toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/doc_name={escape(row[0])}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, root: str, name: str, doc_name: str | None = None) -> DataFrame:
    """A saved table, of one filing if it is named (only its folder is listed)."""
    out = spark.read.parquet(f"{root}/{name}")
    return out if doc_name is None else out.where(F.col("doc_name") == doc_name)


def load_vectors(spark: SparkSession, root: str, model: str) -> DataFrame:
    """The vectors of one embedding model; vectors of another model for the same filings are an error."""
    vectors = load(spark, root, "vectors")
    models = [r[0] for r in vectors.select("embedding_model").distinct().limit(2).collect()]
    if models and models != [model]:
        raise ValueError(f"Embedding model mismatch: stored {models}, asked for {model}")
    return vectors


def indexed(spark: SparkSession, root: str) -> DataFrame:
    """Filings that have chunks, in order."""
    return load(spark, root, "chunks").select("doc_name").distinct().orderBy("doc_name")


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Filings of one table that another lacks."""
    return wanted.select("doc_name").distinct().join(have.select("doc_name"), "doc_name", "left_anti")


COLUMNS = ("doc_name", "chunk_index", "page_num", "section", "statement_type", "chunk_type", "text")


def upsert_jdbc(chunks: DataFrame, url: str, table: str, properties: dict, vectors: DataFrame | None = None) -> None:
    """Replace the filings of chunks in a database table; other filings stay.

    The rows go to a staging table first; then the filings' old rows are deleted and the new ones inserted in one
    transaction, so that readers see whole filings. With vectors, filings whose vectors and chunks differ in number are left as they are.
    """
    if vectors is not None:
        have = vectors.groupBy("doc_name").agg(F.count("*").alias("n"))
        whole = chunks.groupBy("doc_name").agg(F.count("*").alias("n")).join(have, ["doc_name", "n"], "left_semi")
        chunks = chunks.join(whole.select("doc_name"), "doc_name", "left_semi")
    jvm, stage, names = chunks.sparkSession._jvm, f"{table}_{uuid.uuid4().hex[:12]}", ", ".join(COLUMNS)
    rows, key_type = chunks.select(*COLUMNS), ("createTableColumnTypes", "doc_name VARCHAR(1000)")  # a text type without a bound is no key
    rows.write.mode("overwrite").option(*key_type).jdbc(url, stage, properties=properties)
    rows.limit(0).write.mode("append").option(*key_type).jdbc(url, table, properties=properties)  # makes the table where there is none
    said = jvm.java.util.Properties()
    for k, v in properties.items():
        said.setProperty(k, v)
    if "driver" in properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, said)
    # Spark quotes the columns that it makes
    quote = connection.getMetaData().getIdentifierQuoteString().strip()
    names = ", ".join(quote + c + quote for c in COLUMNS)
    key = quote + "doc_name" + quote
    try:
        connection.setAutoCommit(False)
        act = connection.createStatement()
        act.executeUpdate(f"DELETE FROM {table} WHERE {key} IN (SELECT {key} FROM {stage})")
        act.executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.createStatement().executeUpdate(f"DROP TABLE {stage}")
        connection.commit()
        connection.close()


def write_results(graded: DataFrame, folder: str) -> None:
    graded.write.mode("overwrite").json(f"{folder}/results")
    graded.groupBy("reason").agg(F.count("*").alias("n"), F.sum("points").alias("points")).write.mode("overwrite").json(f"{folder}/summary")


def append_trace(rows: DataFrame, folder: str) -> None:
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").json(folder)
