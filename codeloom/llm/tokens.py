"""Encoding of a corpus with a public tokenizer.

Method: a monoid tree. A text longer than a leaf is cut in halves; the halves are encoded one
by one, and neighbours are joined by encoding a window over the cut anew. The window grows to
both sides until it ends where the tokenizer must cut: between a character that is no white
space and one that is. No alternative of the tokenizer's pattern matches across such a place
or looks back over it, so the tokens outside the window are those of the whole text. Decoding
concatenates the tokens' bytes up the same tree.

Defined results: empty and null texts have no ids (an empty array), every document one row.
The vocabulary file is a parameter (session setting codeloom.tokenizer.file).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.text import map_rows
from codeloom.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 2048
WINDOW_CHARS = 64
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")  # white space to Python and to the tokenizer
_READY: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file, loaded once per process."""
    if path not in _READY:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
        _READY[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READY[path]


def encode(text: str | None, encoding, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> list[int]:
    """The ids of a text."""
    if not text:
        return []

    def node(start: int, end: int) -> list[int]:
        if end - start <= leaf:
            return encoding.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return joined(node(start, middle), node(middle, end), start, middle, end)

    def joined(left: list[int], right: list[int], start: int, middle: int, end: int) -> list[int]:
        low, high, reach = start, end, window
        while reach < middle - start:
            cuts = [m.start() for m in _CUT.finditer(text, max(start, middle - reach) + 1, middle)]
            if cuts and cuts[-1] > middle - reach + 1:
                low = cuts[-1]
                break
            reach *= 2
        reach = window
        while reach < end - middle:
            cut = _CUT.search(text, middle + 1, min(end, middle + reach))
            if cut:
                high = cut.start()
                break
            reach *= 2
        tail, head = encoding.encode_ordinary(text[low:middle]), encoding.encode_ordinary(text[middle:high])
        return left[: len(left) - len(tail)] + encoding.encode_ordinary(text[low:high]) + right[len(head) :]

    return node(0, len(text))


def decode(ids: list[int], encoding) -> str:
    """The text of ids; halves of characters join in the bytes."""

    def node(part: list[int]) -> bytes:
        if len(part) <= 1024:
            return encoding.decode_bytes(part)
        return node(part[: len(part) // 2]) + node(part[len(part) // 2 :])

    return node(ids).decode("utf-8", "replace")


def _path(spark: SparkSession) -> str:
    return spark.conf.get("codeloom.tokenizer.file", VOCABULARY)


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every document."""

    def run(doc_id, text) -> Iterator[tuple]:
        yield doc_id, encode(text, encoder(path))

    return map_rows(documents.select("doc_id", "text"), run, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text of every row of ids."""

    def run(doc_id, ids) -> Iterator[tuple]:
        yield doc_id, decode(ids or [], encoder(path))

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), _path(spark))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that come back from the ids."""
    return decode_documents(p6_ids(spark, sf_dir), _path(spark))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
ORACLE = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
