"""Operator 5, BPE encoding and decoding by a table of distinct words.

Texts are split into words by the tokenizer's own pattern. Each slice of rows keeps a table of
distinct words: a word is encoded once, its ids are joined to the table of pieces (one byte string an
id), and the words' positions are joined to the table to give the ids of a text, and its decoded text, in order. The
table lives in the Python worker and holds at most `max_words` words; it is then begun anew,
so memory is bounded whatever the vocabulary of the corpus. It is per worker, not global: a
shuffled join of every (document, position, word) would write several times the input, see the README.

Cases: a null text is encoded as the empty text (no ids; the decoded text is empty); the special token's
string inside a text is one id, as in the library; very long texts are handled whole; repeated rows
give repeated results; a null id stays null; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, pieces_of

#: Fixed value: how byte-level BPE splits text (published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, each with its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(id by piece, id by special token) of a byte-level BPE file of the tokenizers library, in which ids are merge ranks."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    symbols = _byte_symbols()
    return {bytes(symbols[c] for c in t): k for t, k in said["model"]["vocab"].items() if t not in special}, special


_encodings: dict[str, object] = {}


def encoding(path: str):
    """The merge engine of a vocabulary: tiktoken over the file's own pieces, which gives the ids that the tokenizers
    library gives (tests hold them against each other) at about a fifth of its CPU time for single words."""
    if path not in _encodings:
        import tiktoken

        vocab, special = read_vocabulary(path)
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=special)
    return _encodings[path]


class WordTable:
    """Distinct words with their ids, filled as words are met, and the pieces by id."""

    def __init__(self, path: str, max_words: int = 200_000):
        import regex

        self.max_words = max_words
        self.split = regex.compile(PATTERN).findall
        vocab, self.special = read_vocabulary(path)
        cut = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({cut})").split if cut else None
        self.pieces = {k: piece for piece, k in vocab.items()} | {k: t.encode() for t, k in self.special.items()}
        self.merge = encoding(path)._core_bpe.encode_single_piece
        self.begin()

    def begin(self) -> None:
        # by word: its ids as little-endian bytes, as decimal text, and its pieces
        self.ids: dict[str, bytes] = {}
        self.listed: dict[str, str] = {}
        self.spelled: dict[str, bytes] = {}
        for word, k in self.special.items():
            self._add(word, [k])

    def _add(self, word: str, ids: list[int]) -> None:
        self.ids[word] = array("i", ids).tobytes()
        self.listed[word] = ",".join(map(str, ids))
        self.spelled[word] = b"".join(map(self.pieces.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        if self.cut is None or not any(x in text for x in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.cut(text):
            out += [part] if part in self.special else self.split(part)
        return out

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them in the table."""
        split = [self.words(t) for t in texts]
        new = {w for words in split for w in words if w not in self.ids}
        if len(self.ids) + len(new) > self.max_words:
            self.begin()
            new = {w for words in split for w in words if w not in self.ids}
        for w in new:
            self._add(w, self.merge(w.encode("utf-8")))
        return split

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return [b"".join(map(self.ids.__getitem__, words)) for words in self.split_all(texts)]

    def decode(self, ids) -> str:
        """The text of any ids."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_tables: dict[tuple, WordTable] = {}


def word_table(path: str, max_words: int = 200_000) -> WordTable:
    """One table for each worker and vocabulary."""
    if (path, max_words) not in _tables:
        _tables[path, max_words] = WordTable(path, max_words)
    return _tables[path, max_words]


def encode_decode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids and decoded.

    vocabulary: the path of a byte-level BPE file of the tokenizers library, readable on each executor.
    """
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        words = word_table(vocabulary)
        for whole in batches:
            for batch in pieces_of(whole, text_col):
                counts, digests, back, all_ids, texts = [], [], [], [], []
                for split in words.split_all([t or "" for t in batch.column(text_col).to_pylist()]):
                    raw = b"".join(map(words.ids.__getitem__, split))
                    text = b"".join(map(words.spelled.__getitem__, split)).decode("utf-8", "replace")
                    counts.append(len(raw) // 4)
                    digests.append(hashlib.sha256(",".join(map(words.listed.__getitem__, split)).encode()).hexdigest())
                    back.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(raw, np.int32))
                        texts.append(text)
                columns = [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col)), run, schema)
