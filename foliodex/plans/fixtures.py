"""How the engine's tables are made of the driver's: one SQL text for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: documents as chunks: a source is a filing, a document a chunk of it
DOCS = """
SELECT source AS doc_name, doc_id AS chunk_index, CAST(doc_id % 97 AS INT) AS page_num, lang AS section, text,
  CASE WHEN n_chars % 3 = 0 THEN 'table' ELSE 'text' END AS chunk_type FROM documents WHERE text IS NOT NULL
"""

#: orders as chunks of annual reports: 40 filings, one chunk an order
CHUNKS = """
SELECT concat('ACME', CAST(o_custkey % 40 AS STRING), '_', CAST(2015 + o_custkey % 8 AS STRING), '_10K') AS doc_name,
  CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS INT) AS chunk_index,
  CAST(1 + o_orderkey % 90 AS INT) AS page_num,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Item 8 - Financial Statements' WHEN o_orderkey % 3 = 1 THEN 'Item 7 - Management Discussion' ELSE 'Item 1A - Risk Factors' END AS section,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Note 4 Inventory' WHEN o_orderkey % 5 = 1 THEN 'Results of operations' ELSE '' END AS subsection,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Consolidated Balance Sheets' WHEN o_orderkey % 4 = 1 THEN 'Consolidated Statements of Cash Flows' ELSE '' END AS statement_title,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('At December 31, ', CAST(2014 + o_orderkey % 9 AS STRING), ' ($ in millions)') ELSE '' END AS table_title,
  '' AS table_context,
  CASE WHEN o_orderkey % 2 = 0 THEN 'table' ELSE 'text' END AS chunk_type,
  CASE o_orderkey % 8
    WHEN 0 THEN concat('Total current assets | ', CAST(o_orderkey % 977 AS STRING), chr(10), 'Total assets | 4,', CAST(100 + o_orderkey % 800 AS STRING), chr(10), 'Total current liabilities | ', CAST(o_orderkey % 613 AS STRING))
    WHEN 1 THEN concat('Net cash provided by operating activities was ', CAST(o_orderkey % 771 AS STRING), '. Cash flows from investing activities include capital expenditures.', chr(10), 'Free cash flow rose in ', CAST(2014 + o_orderkey % 9 AS STRING), '.')
    WHEN 2 THEN concat('Net sales were $', CAST(o_orderkey % 995 AS STRING), ' and cost of sales ', CAST(o_orderkey % 419 AS STRING), ' in fiscal ', CAST(2014 + o_orderkey % 9 AS STRING), '.', chr(10), 'Gross profit margin improved; operating income too.')
    WHEN 3 THEN concat('Form type: 10-K. Filed as of date: ', CAST(2014 + o_orderkey % 9 AS STRING), '0215. Item information: ', o_orderpriority, '. Exhibit 99.')
    WHEN 4 THEN concat('Inventories | ', CAST(o_orderkey % 333 AS STRING), chr(10), 'Finished goods | 12%', chr(10), 'Raw materials and supplies | (3)')
    WHEN 5 THEN concat('Segment results: the consumer segment grew ', CAST(o_orderkey % 17 AS STRING), '.', CAST(o_orderkey % 10 AS STRING), '% versus prior years, with special items.')
    WHEN 6 THEN concat('Retained earnings and common stock changed; stockholders'' equity stood at ', CAST(o_orderkey % 888 AS STRING), ' thousands of dollars.')
    ELSE concat('Our business is subject to seasonal fluctuations and ', o_orderpriority, ' demand. No figures are given here.') END AS text
FROM orders
"""

#: nations as questions
QUESTIONS = """
SELECT CAST(n_nationkey AS BIGINT) AS qid, concat('ACME', CAST(n_nationkey AS STRING), '_', CAST(2015 + n_nationkey % 8 AS STRING), '_10K') AS doc_name,
  CASE n_nationkey % 13
    WHEN 0 THEN concat('What was the total net sales of ACME', CAST(n_nationkey AS STRING), ' in FY', CAST(2015 + n_nationkey % 8 AS STRING), '?')
    WHEN 1 THEN concat('Calculate the inventory turnover ratio for ', CAST(2014 + n_nationkey % 8 AS STRING), '.')
    WHEN 2 THEN concat('Which segment had the highest growth in ', CAST(2016 + n_nationkey % 5 AS STRING), ' versus prior year?')
    WHEN 3 THEN 'What is the key agenda of this 10-K filing?'
    WHEN 4 THEN concat('Explain what drove the operating margin change at ', n_name, '''s parent in Q3.')
    WHEN 5 THEN 'Is the business cyclical? Describe the trend over time.'
    WHEN 6 THEN concat('From the balance sheet, how much were total current assets and inventories in millions in ', CAST(2017 + n_nationkey % 3 AS STRING), '?')
    WHEN 7 THEN 'Does the company have a healthy quick ratio?'
    WHEN 8 THEN concat('What are the cash flows from operating activities in the statement of cash flows of 10k ', CAST(2018 + n_nationkey % 3 AS STRING), '?')
    WHEN 9 THEN 'Are gross margins historically consistent (percent)?'
    WHEN 10 THEN concat('Define free cash flow for ', n_name, ' between 2016 and 2018.')
    WHEN 11 THEN 'Who audits the books'
    ELSE concat('Compare the second quarter debt to equity of ', n_name, ' with last year, FY2019.') END AS question
FROM nation
"""

#: gold answers and predictions made of parts
ANSWERS = """
SELECT CAST(p_partkey AS BIGINT) AS qid, p_brand AS doc_name,
  CASE p_partkey % 9
    WHEN 0 THEN concat('$', CAST(p_partkey * 7 AS STRING), '.00') WHEN 1 THEN concat('Yes, margins rose by ', CAST(p_size AS STRING), '%')
    WHEN 2 THEN 'The company is a leader in packaging production worldwide' WHEN 3 THEN 'No, the quick ratio is below one' WHEN 4 THEN concat(CAST(p_size AS STRING), ' million')
    WHEN 5 THEN 'declined by 0.8%' WHEN 6 THEN concat(p_name, ' segment') WHEN 7 THEN '1,577' ELSE '' END AS gold,
  CASE p_partkey % 11
    WHEN 0 THEN concat('It was $', CAST(p_partkey * 7 AS STRING)) WHEN 1 THEN concat('Yes: margins rose ', CAST(p_size + p_partkey % 2 AS STRING), '%')
    WHEN 2 THEN 'It is one of the packaging industry leaders, a company active worldwide' WHEN 3 THEN 'Yes, the quick ratio is above one' WHEN 4 THEN concat('3M reported ', CAST(p_size AS STRING))
    WHEN 5 THEN 'It went from 19.4% to 18.5%' WHEN 6 THEN concat('The ', p_name, ' segment') WHEN 7 THEN 'USD 1577 million' WHEN 8 THEN 'NOT FOUND' WHEN 9 THEN 'No, it is below one' ELSE concat('about ', CAST(p_retailprice AS STRING)) END AS predicted,
  p_partkey % 10 <> 8 AS found, CAST(p_size AS INT) AS gold_page, CAST(p_size + p_partkey % 3 AS INT) AS page
FROM part
"""

#: model replies made of parts
REPLIES = """
SELECT CAST(p_partkey AS BIGINT) AS qid, CASE p_partkey % 6
  WHEN 0 THEN concat('ANSWER: ', p_name, chr(10), 'SOURCE: [', p_brand, '] Page ', CAST(p_size AS STRING), ' - "', p_type, '"', chr(10), 'METRICS:', chr(10), '- label: Price | value: ', CAST(p_size AS STRING), ' | period: FY2020', chr(10), 'label: empty | value:')
  WHEN 1 THEN concat('ANSWER: NOT_FOUND', chr(10), chr(10), 'ANALYSIS: nothing on ', p_name)
  WHEN 2 THEN concat('ANSWER: ', p_type, chr(10), 'CALCULATION: 1 + 1', chr(10), 'SOURCE: Passage 2 - "', p_name, '"')
  WHEN 3 THEN concat('ANSWER: ', p_brand, ' without a source')
  WHEN 4 THEN concat('I cannot say anything about ', p_name)
  ELSE concat('answer: multi', chr(10), chr(10), 'line ', p_type, chr(10), 'Source: Report Page 12: ', p_name, chr(10), 'Source: Page 13 - "', p_type, '"') END AS reply
FROM part
"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def made(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    """A fixture's DataFrame; the table is bound to the query, not registered by name."""
    return spark.sql(sql.replace(f"FROM {source}", f"FROM {{{source}}}"), **views(spark, sf_dir, source))
