"""Text functions as Columns: tokens, terms, normalised strings, numbers, years, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

TABLE_MARKS = ("[TABLE]", "[/TABLE]")


def any_in(text: Column, words) -> Column:
    """Whether any of the words (a list, or an array column) is a substring of text."""
    if isinstance(words, Column):
        return F.exists(words, lambda w: text.contains(w))
    words = list(words)
    if len(words) > 8:
        return F.exists(lx.strings(words), lambda w: text.contains(w))
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def strip_chars(x: Column, chars: str) -> Column:
    return F.btrim(x, F.lit(chars))


def tokenize(text: Column) -> Column:
    """Tokens of a text for the index: runs of a-z, 0-9 and $ . , % with edge punctuation cut off plain words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({lx.TOKEN})"), 1)
    kept = F.filter(found, lambda t: strip_chars(t, ".,%$") != "")
    return F.transform(kept, lambda t: F.when(t.startswith("$") | t.contains("%"), t).otherwise(strip_chars(t, ".,")))


def synonyms(query: Column) -> Column:
    """The query and, behind it, the other wordings of every synonym group that it names."""
    low = F.lower(query)
    extra = F.concat(*[F.when(any_in(low, g), F.filter(lx.strings(g), lambda p: ~low.contains(p))).otherwise(F.array().cast("array<string>")) for g in lx.SYNONYMS])
    return F.when(F.size(extra) > 0, F.concat_ws(" ", query, F.array_join(extra, " "))).otherwise(query)


def query_tokens(expanded: Column) -> Column:
    """Tokens of an expanded query without stop words (all of them if nothing else is left); repeats stay."""
    tokens = tokenize(expanded)
    kept = F.filter(tokens, lambda t: ~F.array_contains(lx.strings(lx.QUERY_STOP), t))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def distinctive(text: Column, stop: list[str] | None = None) -> Column:
    """Terms of three letters or more that say what is sought, each once, in order."""
    bare = F.transform(tokenize(text), lambda t: strip_chars(t, "$.,%"))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & ~F.array_contains(lx.strings(stop or lx.RELEVANCE_STOP), t) & ~t.rlike("^[0-9]+$")))


def gate_terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({lx.TOKEN})"), 1)
    bare = F.transform(found, lambda t: strip_chars(t, "$.,%"))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & ~F.array_contains(lx.strings(lx.GATE_STOP), t) & ~t.rlike("^[0-9]+$")))


def identity_tokens(text: Column, least: int = 2) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![0-9])(20[0-9]{2})"), 1))


def company_name(text: Column) -> Column:
    """A company's name without the header text that may follow it."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    ends = "|".join(x.replace("/", r"\/") for x in lx.COMPANY_ENDS)
    return F.trim(F.regexp_replace(plain, f"(?i)(?<=.) (?:{ends}).*$", ""))


def normalize(text: Column) -> Column:
    """Plain quotes, dashes and blanks, split words mended, blank lines closed up (without NFKC, which SQL lacks)."""
    x = F.translate(F.coalesce(text, F.lit("")), "‘’“”–—− ​﻿", "''\"\"--- ")
    x = F.regexp_replace(x, "[ \t]+", " ")
    for broken, whole in (("Shee\\s+t", "Sheet"), ("Flow\\s+s", "Flows"), ("Statement\\s+s", "Statements"), ("Operation\\s+s", "Operations"), ("Activit\\s+y", "Activity")):
        x = F.regexp_replace(x, rf"(?i)\b{broken}\b", whole)
    x = F.regexp_replace(x, r"\n\s*\n+", "\n")
    return F.regexp_replace(F.regexp_replace(x, " *\n *", "\n"), r"^\s+|\s+$", "")


def normalize_answer(text: Column) -> Column:
    """Lower case, only word characters and . % $ - kept, blanks squeezed."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s.%$-]", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def numbers(text: Column) -> Column:
    """The distinct numbers of a text as written, less commas and dollar signs."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({lx.GRADE_NUMBER})"), 1)
    bare = F.transform(found, lambda n: F.regexp_replace(n, "[,$]", ""))
    return F.array_distinct(F.filter(bare, lambda n: ~n.isin("", "-", ".")))


def number_values(nums: Column) -> Column:
    return F.filter(F.transform(nums, lambda n: F.rtrim(n, F.lit("%")).try_cast("double")), lambda v: v.isNotNull())


def norm_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " "), " +"), lambda w: F.length(w) > 2)


def lines(text: Column) -> Column:
    """Lines with single blanks, without empty ones and table marks."""
    squeezed = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(squeezed, lambda x: (x != "") & ~x.isin(*TABLE_MARKS))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def windows(words: Column, cap: int = 1200, overlap: int = 100) -> Column:
    """Overlapping windows of at most cap words; the last one reaches the end."""
    step = cap - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size(words) - cap) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(words, i * step + 1, cap), " "))


def search_text(*, with_text: bool = True) -> Column:
    """The lower-cased headers (and text) of a chunk row."""
    fields = ["section", "subsection", "statement_title", "table_title", "table_context", "statement_type", "chunk_type", "units"]
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in [*fields, *(["text"] if with_text else [])]]))


def metadata_text() -> Column:
    first = F.slice(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r"), 1, 6)
    return F.when(F.col("text").contains("[TABLE]"), F.concat_ws(" ", search_text(with_text=False), F.lower(F.array_join(first, " ")))).otherwise(search_text(with_text=False))
