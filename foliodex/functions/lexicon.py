"""The vocabulary of the engine as data: concepts, ratios, synonyms, markers and stop words."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: they must be these for the engine's results to be right. ---------------------------------

#: (concept, statement it is read from, wordings)
CONCEPTS = (
    (
        "PROPERTY_PLANT_EQUIPMENT_NET",
        "BALANCE_SHEET",
        (
            "net ppne", "net pp&e", "property, plant and equipment, net", "property, plant and equipment — net", "property plant and equipment net",
            "ppne", "pp&e", "property, plant and equipment", "property plant and equipment", "property and equipment, net",
            "property and equipment — net", "property and equipment net", "property and equipment",
        ),
    ),
    (
        "CAPEX",
        "CASH_FLOW_STATEMENT",
        (
            "capital expenditures", "capital expenditure", "capex", "purchases of property, plant and equipment", "purchases of property",
            "additions to property, plant and equipment", "capital spending",
        ),
    ),
    ("NET_SALES_REVENUE", "INCOME_STATEMENT", ("total net sales", "net sales", "total revenue", "net revenue", "revenue", "sales")),
    ("OPERATING_INCOME", "INCOME_STATEMENT", ("operating income", "income from operations", "operating profit", "operating margin")),
    ("NET_INCOME", "INCOME_STATEMENT", ("net income", "net earnings", "net profit", "earnings per share", "eps")),
    ("GROSS_PROFIT", "INCOME_STATEMENT", ("gross profit", "gross margin")),
    ("COGS", "INCOME_STATEMENT", ("cost of sales", "cost of goods sold", "cost of revenue", "cogs")),
    ("SGA", "INCOME_STATEMENT", ("selling, general and administrative expenses", "selling general and administrative", "sg&a", "sga")),
    ("RESEARCH_DEVELOPMENT", "INCOME_STATEMENT", ("research, development and related expenses", "research and development", "r&d")),
    (
        "CASH_FLOW_OPERATING",
        "CASH_FLOW_STATEMENT",
        (
            "net cash provided by (used in) operating activities", "net cash provided by operating activities",
            "cash flows from operating activities", "operating cash flow",
        ),
    ),
    ("CASH_FLOW_INVESTING", "CASH_FLOW_STATEMENT", ("net cash provided by (used in) investing activities", "cash flows from investing activities")),
    ("CASH_FLOW_FINANCING", "CASH_FLOW_STATEMENT", ("net cash provided by (used in) financing activities", "cash flows from financing activities")),
    ("CASH_AND_EQUIVALENTS", "BALANCE_SHEET", ("cash and cash equivalents", "cash equivalents", "cash balance")),
    ("TOTAL_ASSETS", "BALANCE_SHEET", ("total assets",)),
    ("CURRENT_ASSETS", "BALANCE_SHEET", ("total current assets", "current assets")),
    ("CURRENT_LIABILITIES", "BALANCE_SHEET", ("total current liabilities", "current liabilities")),
    ("TOTAL_LIABILITIES", "BALANCE_SHEET", ("total liabilities",)),
    (
        "TOTAL_EQUITY",
        "EQUITY_STATEMENT",
        ("total 3m company shareholders equity", "total equity", "stockholders' equity", "shareholders' equity", "stockholders equity"),
    ),
    ("DEBT", "BALANCE_SHEET", ("long-term debt", "short-term borrowings and current portion of long-term debt", "total debt", "borrowings")),
    (
        "INVENTORY",
        "BALANCE_SHEET",
        ("total inventories", "inventories", "inventory", "finished goods", "work in process", "raw materials and supplies"),
    ),
    ("ACCOUNTS_RECEIVABLE", "BALANCE_SHEET", ("accounts receivable, net", "accounts receivable net", "accounts receivable")),
    ("ACCOUNTS_PAYABLE", "BALANCE_SHEET", ("accounts payable", "account payable", "trade accounts payable", "payables")),
    ("DEPRECIATION_AMORTIZATION", "INCOME_STATEMENT", ("depreciation and amortization", "d&a")),
    ("FREE_CASH_FLOW", "CASH_FLOW_STATEMENT", ("free cash flow", "fcf")),
    ("DIVIDENDS", "CASH_FLOW_STATEMENT", ("dividends paid to shareholders", "dividends paid", "cash dividends")),
    ("BUYBACKS", "CASH_FLOW_STATEMENT", ("purchases of treasury stock", "share repurchase", "buyback")),
    ("VALUE_AT_RISK", "FOOTNOTES", ("value at risk", "var", "historical var", "average var", "market risk var")),
    ("TAX_RATE", "INCOME_STATEMENT", ("effective tax rate", "income tax rate", "tax rate", "provision for income taxes")),
    (
        "WEIGHTED_AVERAGE_SHARES",
        "INCOME_STATEMENT",
        ("weighted average shares", "diluted shares", "basic shares", "share count", "diluted average shares"),
    ),
    ("EBITDA", "INCOME_STATEMENT", ("ebitda", "ebit", "operating profit before depreciation")),
    ("INTEREST_EXPENSE", "INCOME_STATEMENT", ("interest expense", "interest paid", "finance cost")),
    ("WORKING_CAPITAL", "BALANCE_SHEET", ("working capital", "current assets less current liabilities")),
    ("NET_ASSET_VALUE", "BALANCE_SHEET", ("net asset value", "nav")),
    ("GOODWILL", "BALANCE_SHEET", ("goodwill", "intangible assets", "goodwill impairment")),
    ("LEVERAGE", "BALANCE_SHEET", ("debt to equity", "leverage ratio", "debt-to-equity")),
    ("ROE", "INCOME_STATEMENT", ("return on equity", "roe", "return on assets", "roa")),
    (
        "ACQUISITIONS",
        "FOOTNOTES",
        ("acquisition", "acquisitions", "business combinations", "purchase price", "acquired", "acquire", "merger", "takeover", "major acquisitions"),
    ),
)

#: (ratio, names in questions, concepts it needs, how it is computed in own wording)
RATIOS = (
    (
        "QUICK_RATIO",
        ("quick ratio", "acid test ratio", "acid-test ratio"),
        ("CASH_AND_EQUIVALENTS", "ACCOUNTS_RECEIVABLE", "CURRENT_ASSETS", "INVENTORY", "CURRENT_LIABILITIES"),
        "Quick ratio: add cash, short-term investments and net receivables where each is stated, else take current assets less inventory; divide by current liabilities.",
    ),
    (
        "CURRENT_RATIO",
        ("current ratio", "working capital ratio"),
        ("CURRENT_ASSETS", "CURRENT_LIABILITIES"),
        "Current ratio: current assets divided by current liabilities.",
    ),
    (
        "INVENTORY_TURNOVER",
        ("inventory turnover",),
        ("INVENTORY", "COGS"),
        "Inventory turnover: cost of sales divided by the inventory at the end of the period (no average).",
    ),
    (
        "CAPITAL_INTENSITY",
        ("capital-intensive", "capital intensive", "capital intensity"),
        ("CAPEX", "NET_SALES_REVENUE", "PROPERTY_PLANT_EQUIPMENT_NET", "TOTAL_ASSETS", "NET_INCOME"),
        "Capital intensity: capital expenditure by revenue, net fixed assets by total assets, and net income by total assets.",
    ),
    ("DEBT_TO_EQUITY", ("debt to equity", "debt-to-equity"), ("DEBT", "TOTAL_EQUITY"), "Debt to equity: total debt divided by total equity."),
)

#: groups of wordings for the same thing
SYNONYMS = (
    ("capital expenditure", "capital expenditures", "capex", "purchases of property plant and equipment", "purchases of property"),
    ("revenue", "net sales", "total revenue", "net revenue", "total net sales"),
    ("cost of goods sold", "cost of sales", "cost of revenue", "cogs"),
    ("selling general and administrative", "sg&a", "sga expenses"),
    ("research and development", "r&d expense", "research development"),
    ("depreciation and amortization", "d&a"),
    ("net income", "net earnings", "net profit", "profit attributable"),
    ("operating income", "income from operations", "operating profit"),
    ("gross profit", "gross margin"),
    ("cash and cash equivalents", "cash equivalents"),
    ("stockholders equity", "shareholders equity", "shareholders' equity", "stockholders' equity"),
    ("long-term debt", "long term debt", "long-term borrowings"),
    ("dividends paid", "dividend payments", "cash dividends"),
    ("share repurchase", "stock repurchase", "buyback", "repurchase of common stock"),
    ("employees", "headcount", "number of employees"),
    ("free cash flow", "fcf"),
    ("total debt", "total borrowings"),
    ("interest expense", "interest paid"),
    ("income tax", "provision for income taxes", "income tax expense"),
)

PURPOSE_QUESTION = (
    "key agenda", "agenda", "purpose of", "main purpose", "filing about", "what did the filing report", "what was disclosed",
    "what did this filing report", "what event", "what events", "main subject", "key subject", "main topic", "what was the purpose",
    "what was the key", "what was the main",
)
PURPOSE_FILING = ("filing", "8k", "8-k", "10q", "10-q", "10k", "10-k", "form")
#: question types in order of priority, with their markers
TYPES = (
    ("EXPLANATION", ("why", "explain", "describe", "reason", "driver")),
    (
        "CALCULATION",
        (
            "calculate", "compute", "ratio", "percentage", "percent", "margin", "growth rate", "year-over-year change", "yoy change", "defined as",
            "days payable outstanding", " dpo", "round your answer",
        ),
    ),
    (
        "COMPARISON",
        (
            "compare", "versus", "vs", "difference", "change in", "year-over-year", "yoy", "growth", "highest", "lowest", "largest", "smallest",
            "greatest", "least", "rank ", "ranked", "which of", "which segment", "which category", "which region", "which product", "which debt",
            "which securities", "which notes", "which bonds",
        ),
    ),
    ("TREND", ("trend", "over time", "historical", "prior years")),
    ("NUMERIC_LOOKUP", ("how much", "amount", "value", "total", "figure", "cost", "dollar", "what was the", "what is the")),
    ("DEFINITION", ("what is", "define", "meaning")),
)
CALCULATION_COMPARES = ("year-over-year", "yoy", "change", "from ", " to ")
EXPLICIT_STATEMENTS = (
    ("CASH_FLOW_STATEMENT", ("cash flow statement", "statement of cash flows", "consolidated statement of cash flows")),
    ("INCOME_STATEMENT", ("income statement", "statement of income", "statement of operations", "consolidated statement of income")),
    ("INCOME_STATEMENT", ("p&l", "profit and loss")),
    ("BALANCE_SHEET", ("balance sheet", "statement of financial position", "consolidated balance sheet")),
    ("EQUITY_STATEMENT", ("statement of equity", "statement of stockholders equity", "retained earnings statement")),
    ("RISK_FACTORS", ("item 1a", "risk factors", "risk factor")),
    ("MD_AND_A", ("item 7", "md&a", "management discussion")),
    ("FOOTNOTES", ("footnotes", "footnote", "note 1", "note 2", "note 3")),
    ("BUSINESS", ("item 1", "business description")),
)
UNITS = (
    ("basis points", ("basis point", "bps")),
    ("percent", ("percent", "percentage", "%")),
    ("millions", ("million", "millions")),
    ("billions", ("billion", "billions")),
)
UP_WORDS = ("increase", "improve", "higher", "growth", "grew")
DOWN_WORDS = ("decrease", "decline", "lower", "reduced", "fell")
PRIOR_YEAR = ("yoy", "year-over-year", "prior year", "previous year", "last year", "preceding year", "compared to previous", "compared to last")
MENTIONS_BALANCE = ("balance sheet", "balance sheets")
MENTIONS_INCOME = ("p&l", "profit and loss", "income statement", "statement of income", "statement of operations")
MULTIPLE = (" and ", "using ", "between ", "from ", "to ", "multi-year")
NOT_COMPANIES = ("FY", "Q1", "Q2", "Q3", "Q4", "SEC", "GAAP", "USD", "US")
PURPOSE_EVIDENCE = (
    "item information", "form type", "document description", "filed as of date", "conformed submission type", "event", "exhibit",
    "financial statements and exhibits",
)
#: (added terms, kind of question or "*", any of these in it, and any of these if there are some)
EXPANSIONS = (
    (
        ("special items", "one-time charges", "significant items", "reconciliation"),
        "EXPLANATION",
        ("drove", "driver", "drivers", "caused", "contributed to"),
        (),
    ),
    (
        ("organic sales change", "by segment", "each segment"),
        "*",
        ("which segment", "which category", "which region", "which product", "which business", "which division"),
        (),
    ),
    (
        ("our business is subject to", "cyclical", "seasonal fluctuations", "risk factors"),
        "*",
        ("cyclical", "cyclicality", "seasonality", "seasonal"),
        (),
    ),
    (
        ("revenue growth", "growth strategy", "results of operations", "year over year"),
        "*",
        ("high growth", "high-growth", "growth company", "growth profile"),
        (),
    ),
    (("gross margin", "gross profit", "results of operations", "cost of"), "*", ("consistent",), ("margin", "margins")),
)
WHICH_GROUP = ("which segment", "which category", "which region", "which product", "which business", "which division")
COMPARISON_INTENT = (
    "highest", "lowest", "largest", "smallest", "greatest", "least", "rank", "which of", "which segment", "which category", "which region",
    "which product", "compare", "versus", " vs ", "more than", "less than",
)
COMPARISON_GATE = ("highest", "lowest", "largest", "smallest", "greatest", "least", "rank", "which of", "compare", " versus ", " vs ")
WHICH_ENTITY = r"\bwhich\s+(segment|product|business|division|region|unit|category|line|subsidiary|market)\b"
UNRELATED = (
    "derivative", "hedging", "fair value measurement", "income tax", "tax rate", "pension", "postretirement", "stock-based compensation",
    "operating lease", "commitments and contingencies",
)

STOP_WORDS = """
a an the of in on for to by with from at as is are was were be been being
this that these those it its it's if then than or and but not no so such
do does did doing have has had having will would shall should can could may
might must about into over under again further here there when where why how
all any both each few more most other some own same too very just also
you your yours he him his she her hers they them their we our us i me my
what which who whom
""".split()
#: words that say nothing about what is sought, beyond stop words
PLAIN_WORDS = """
q1 q2 q3 q4 fy fiscal year quarter quarters period periods ended ending
highest lowest largest smallest greatest least higher lower high low rank ranked
compare compared versus vs amount value total figure give response relying details
shown name company firm corporation corp inc plc llc ltd co jpm jpmorgan
key agenda purpose filing filed dated date form document report reports reported
sec 8k 8 10k 10q 10 1st 2nd 3rd
january february march april may june july august september october november december
""".split()
#: the gate's list: fewer stop words, and no "high low"
GATE_STOP_WORDS = """
a an the of in on for to by with from at as is are was were be been being
this that these those it its if then than or and but not no so such
do does did doing have has had will would can could may might must about into
what which who whom all any both each more most other some own same also
q1 q2 q3 q4 fy fiscal year quarter quarters period periods ended ending
highest lowest largest smallest greatest least higher lower rank ranked compare
compared versus vs amount value total figure give response relying details shown
name company firm corporation corp inc plc llc ltd co jpm jpmorgan
key agenda purpose filing filed dated date form document report reports reported
sec 8k 8 10k 10q 10 1st 2nd 3rd
january february march april may june july august september october november december
""".split()
COMPANY_ENDS = (
    "central index key:", "standard industrial classification:", "irs number:", "state of incorporation:", "fiscal year end:", "filing values:",
    "form type:", "sec act:", "sec file number:", "film number:", "business address:", "mail address:", "former company:", "</sec-header>",
    "<document>",
)

#: (statement, in headings, in bodies)
STATEMENTS = (
    (
        "BALANCE_SHEET",
        ("balance sheet", "financial position"),
        (
            "assets", "current assets", "total assets", "liabilities", "current liabilities", "total liabilities", "total equity",
            "property, plant and equipment",
        ),
    ),
    (
        "INCOME_STATEMENT",
        ("statement of income", "statements of income", "statement of operations", "statements of operations", "statement of earnings"),
        (
            "revenue", "net sales", "sales", "cost of sales", "gross profit", "operating income", "income before", "net income", "net earnings",
            "earnings per share", "eps",
        ),
    ),
    (
        "CASH_FLOW_STATEMENT",
        ("statement of cash flow", "statements of cash flow", "cash flows"),
        (
            "operating activities", "investing activities", "financing activities", "net cash provided", "net cash used",
            "cash flows from operating", "cash flows from investing", "cash flows from financing",
        ),
    ),
    (
        "EQUITY_STATEMENT",
        ("statement of equity", "statements of equity", "changes in equity", "stockholders' equity", "shareholders' equity"),
        (
            "retained earnings", "treasury stock", "common stock", "additional paid-in capital", "accumulated other comprehensive",
            "stockholders' equity", "shareholders' equity",
        ),
    ),
)
#: what a chunk without strong structure is, first match wins
CASCADE = (
    (
        "CASH_FLOW_STATEMENT",
        ("cash flows from investing", "cash flows from operating", "statements of cash flows", "statement of cash flows", "cash flows activities"),
    ),
    (
        "INCOME_STATEMENT",
        (
            "statements of income", "statement of income", "statements of operations", "statement of operations", "statements of earnings",
            "results of operations",
        ),
    ),
    ("BALANCE_SHEET", ("balance sheets", "balance sheet", "financial position")),
    ("EQUITY_STATEMENT", ("stockholders' equity", "shareholders' equity", "statements of equity")),
    ("RISK_FACTORS", ("item 1a", "risk factors")),
    ("OTHER", ("item 1 - financial statements", "item 1. financial statements")),
    ("BUSINESS", ("item 1", "business description", "business overview")),
    ("MD_AND_A", ("item 7", "management's discussion")),
    ("FOOTNOTES", ("note ", "notes to consolidated")),
)
TABLE_UNITS = (
    ("millions", ("in millions", "millions of")),
    ("thousands", ("in thousands", "thousands of")),
    ("billions", ("in billions", "billions of")),
    ("percent", ("percent", "%")),
)
SUBSECTIONS = (
    "note ", "results of operations", "performance by", "executive summary", "overview", "liquidity", "capital resources", "risk factors",
    "segment information", "critical accounting", "consolidated statements", "balance sheets", "statements of income", "statements of cash flows",
)
STATEMENT_HEADING = (
    r"\b(consolidated\s+(?:balance sheets?|statements? of (?:operations|income|earnings|comprehensive income|cash flows?|financial position|stockholders'? equity|shareholders'? equity|changes in equity))|"
    r"balance sheets?|statements? of (?:operations|income|earnings|cash flows?|financial position|stockholders'? equity|shareholders'? equity|changes in equity)|income statements?|cash flow statements?)\b"
)
PERIOD_TITLE = r"\b(at|as of|as at|for the|years? ended|quarters? ended|three months ended|six months ended|nine months ended|twelve months ended)\b"
ITEM_HEADING = r"^\s*(?:PART\s+[IVX]+\s*[-–—]?\s*)?ITEM\s+([0-9]{1,2}[A-Z]?)\s*[\.\:\-\–\—]?\s*(.*)$"
TOKEN = r"[a-z0-9$.,%]+"
NUMBER_IN_TEXT = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
NOTE_NUMBER = r"\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?"
GRADE_NUMBER = r"-?\$?\d[\d,]*\.?\d*%?(?!\w)"
EVIDENCE_WORDS = ("total", "net", "cash", "revenue", "acquisition", "acquired")

PAGE_NUMBER = r"\d{1,3}"
F_NUMBER = r"F-\s?\d{1,3}"
CONTENTS_NAMES = ("table of contents", "contents", "index", "[table]")
PLAIN_CHARACTERS = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\xa0": " ", "\u200b": None, "\ufeff": None}
#: words that filings split, as patterns, and what they are
SPLIT_WORDS = ((r"Shee\s+t", "Sheet"), (r"Flow\s+s", "Flows"), (r"Statement\s+s", "Statements"), (r"Operation\s+s", "Operations"), (r"Activit\s+y", "Activity"))

#: the parts of a reply
REPLY_ANSWER = r"(?is)ANSWER:\s*(.+?)(?:\n(?:SOURCE|METRICS):|\z)"
REPLY_METRICS = r"(?is)METRICS:\s*(.*?)(?:\n\s*(?:SOURCE:|ANSWER:|CALCULATION:|ANALYSIS:)|\z)"
REPLY_PAGE_SOURCE = r"(?i)SOURCE:\s*(?:([^\n]*?)\s+)?Page\s*(\d+)\s*[-–—:]\s*[\"“”'’]?(.+?)[\"“”'’]?(?:\n|$)"
REPLY_PASSAGE_SOURCE = r"(?i)SOURCE:\s*Passage\s*(\d+)\s*[-–—:]\s*[\"“”'’]?(.+?)[\"“”'’]?(?:\n|$)"
GENERIC_LABELS = ("", "general", "unknown", "n/a", "none")

#: numbers that name a place and are no figures
PLACE_NUMBER = r"(?i)\b(?:note|item|page|part|section)\s+\d+\b"
NO_CANDIDATES = "No candidate chunks were retrieved."
#: what the gate says of a rule that failed, {} being what is missing
GATE_REASONS = {
    "Concept Rule": "Top passages do not contain requested concept ({}) or accounting aliases.",
    "Calculation Inputs": "Missing required formula input evidence for {}.",
    "Statement Rule": "Top passages do not match explicitly requested statement type ({}).",
    "Calculation Statements": "Missing required statement evidence for {}.",
    "Comparison Rule": "Top passages do not contain the requested comparison/grouping dimension.",
    "Document Purpose Rule": "Top passages do not contain filing metadata or event/section evidence.",
    "Period Rule": "Top passages do not contain requested fiscal year ({}).",
    "Value Rule": "Top passages do not contain numerical values/digits required to answer the query.",
}
PURPOSE_PASSED = "Document-purpose evidence requirements passed."
COMPARISON_PASSED = "Comparison evidence requirements passed."
ALL_PASSED = "All applicable rule-based evidence requirements passed."

# --- End of the fixed values. ---------------------------------------------------------------------------------


QUERY_STOP = sorted(set(STOP_WORDS))
RELEVANCE_STOP = sorted(set(STOP_WORDS) | set(PLAIN_WORDS))
GATE_STOP = sorted(set(GATE_STOP_WORDS))


def strings(values) -> Column:
    """An array literal, made in one step (and folded to a constant) however long it is."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def concept_literal(only: list[str] | None = None) -> Column:
    """array<struct<id, statement, keywords>>: all concepts in the lexicon's order, or those named in theirs."""
    known = {a: {"id": a, "statement": b, "keywords": k} for a, b, k in CONCEPTS}
    rows = list(known.values()) if only is None else [known[x] for x in only]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<id: string, statement: string, keywords: array<string>>>")
