"""Operator 1, quality rules: repeated substrings by suffix array and common-prefix intervals.

Words of a document are the alphabet. Prefix doubling sorts the suffixes of all documents of
an Arrow slice at once (a word's symbol includes its document, so nothing is shared between
documents); the ranks of each doubling level then give the common prefix of neighbouring
suffixes without a sequential scan. Each suffix lies in its deepest common-prefix interval,
whose length is the longest repeat that begins there; the union of those spans is the union
of the spans of all maximal repeated substrings.

Limits: a document is rejected when repeats of `min_words` words or more cover more than
`max_covered` of its words, or when the longest repeat has more than `max_longest` of them.

Cases: a null text counts as the empty text; a document without words has no repeats and fails
the base rule (fewer than 50 words). Rows stand for themselves: repeated rows or ids give
repeated results, a null id stays null, an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, pieces_of

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_words long, covered_fraction double, longest_repeat long, kept boolean"
)


def suffix_levels(symbols: np.ndarray) -> list[np.ndarray]:
    """ranks[t][i]: the place of the 2**t symbols from i among all such runs; the last level is a permutation."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.ones(n, bool)
    first[1:] = symbols[order][1:] != symbols[order][:-1]
    begin = np.flatnonzero(first)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    rank[n] = -1
    levels, size = [rank.copy()], 1
    tied = np.flatnonzero(np.bincount(rank[:n], minlength=n)[rank[:n]] > 1)
    while len(tied):
        ahead = rank[np.minimum(tied + size, n)]
        key = rank[tied] * (n + 1) + ahead + 1
        by = np.argsort(key, kind="stable")
        key, old = key[by], rank[tied][by]
        place = np.arange(len(by))
        new_group = np.ones(len(by), bool)
        new_group[1:] = key[1:] != key[:-1]
        old_group = np.ones(len(by), bool)
        old_group[1:] = old[1:] != old[:-1]
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        old_at = np.maximum.accumulate(np.where(old_group, place, 0))
        rank = rank.copy()
        rank[tied[by]] = old + group_at - old_at
        levels.append(rank)
        size *= 2
        starts = np.flatnonzero(new_group)
        alone = np.repeat(np.diff(np.append(starts, len(by))) == 1, np.diff(np.append(starts, len(by))))
        tied = np.sort(tied[by][~alone])
    return levels


def longest_from(symbols: np.ndarray, min_words: int) -> np.ndarray:
    """For each position the length of its longest repeat, or 0 below min_words."""
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    levels = suffix_levels(symbols)
    need = int(np.log2(min_words))
    if need >= len(levels):
        return best
    order = np.empty(n, np.int64)
    order[levels[-1][:n]] = np.arange(n)
    a, b = order[:-1], order[1:]
    near = levels[need][a] == levels[need][b]
    a, b = a[near], b[near]
    prefix = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        i, j = np.minimum(a + prefix, n), np.minimum(b + prefix, n)
        same = (levels[t][i] == levels[t][j]) & (i < n) & (j < n)
        prefix[same] += 1 << t
    keep = prefix >= min_words
    np.maximum.at(best, a[keep], prefix[keep])
    np.maximum.at(best, b[keep], prefix[keep])
    return best


def _marked(total: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _measures(texts: list, min_words: int) -> dict[str, np.ndarray]:
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")}
    codes: dict[bytes, int] = {}
    parts = []
    for i, text in enumerate(texts):
        if not text:
            parts.append(np.empty(0, np.int64))
            continue
        raw = text.encode("utf-8")
        words = raw.split()
        parts.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - sum(map(raw.count, SPACE.encode()))
        out["n_symbols"][i] = sum(map(raw.count, SYMBOLS.encode()))
        if b"\n" in raw:
            seen: set[bytes] = set()
            for line in raw.split(b"\n"):
                if line.strip():
                    if line in seen:
                        out["n_dup_lines"][i] += 1
                    seen.add(line)
    total = int(out["n_words"].sum())
    if not total:
        return out
    doc = np.repeat(np.arange(n), out["n_words"])
    symbol = doc * (len(codes) + 1) + np.concatenate(parts)
    symbol = np.unique(symbol, return_inverse=True)[1]
    # three-word windows that occur twice or more in their document
    if total >= 3:
        base = int(symbol.max()) + 1
        pair = np.unique(symbol[:-1] * base + symbol[1:], return_inverse=True)[1]
        key = pair[:-1] * base + symbol[2:]
        key[doc[:-2] != doc[2:]] = -1 - np.flatnonzero(doc[:-2] != doc[2:])
        _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[where] > 1)
        np.add.at(out["n_repeat_words"], doc[_marked(total, again, np.full(len(again), 3))], 1)
    best = longest_from(symbol, min_words)
    at = np.flatnonzero(best)
    np.add.at(out["covered_words"], doc[_marked(total, at, best[at])], 1)
    np.maximum.at(out["longest_repeat"], doc[at], best[at])
    return out


def _verdicts(texts: list, min_words: int, max_covered: float, max_longest: float) -> dict[str, np.ndarray]:
    m = _measures(texts, min_words)
    words = np.maximum(m["n_words"], 1)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    fraction = m["covered_words"] / words
    kept = ~failed & (fraction <= max_covered) & (m["longest_repeat"] <= max_longest * words)
    return m | {"base_failed": failed, "covered_fraction": fraction, "kept": kept}


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, max_covered: float = 0.5, max_longest: float = 0.35) -> DataFrame:
    """One row of measures and verdicts per document; see the module's docstring."""
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, text_col, 1 << 20):
                v = _verdicts(batch.column(text_col).to_pylist(), min_words, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(v[k]) for k in names)], [id_col, *names])

    return arrow_map(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col)), run, SCHEMA.replace("doc_id", f"`{id_col}`", 1))


def keep_good(docs: DataFrame, *, text_col: str = "text", min_words: int = 8, max_covered: float = 0.5, max_longest: float = 0.35) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; nothing is shuffled."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, text_col, 1 << 20):
                yield batch.filter(pa.array(_verdicts(batch.column(text_col).to_pylist(), min_words, max_covered, max_longest)["kept"]))

    return arrow_map(docs, run, docs.schema)
