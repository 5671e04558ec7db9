"""Sizes in tokens of a public tokenizer, whose vocabulary file is read where it lies."""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


#: Texts longer than this are encoded in parts.
PART = 100_000
#: A space between two other characters begins a new piece of the tokenizer's pattern, whatever stands around it.
_SEAM = re.compile(r"(?<=\S) (?=\S)")


def vocabulary(path: str = TOKENIZER) -> tuple[str, dict[bytes, int]]:
    """(pattern, ranks), read by the driver and sent to the tasks, so executors need no file."""
    import public_tokenizers

    with open(path, "rb") as f:
        return public_tokenizers.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(pattern: str, ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(enc, text: str, part: int = PART) -> int:
    """Tokens of the text. Long texts are encoded in parts that meet at seams of the pattern, which gives the same tokens as
    the whole; a stretch without a seam stays in one part."""
    n = at = 0
    while len(text) - at > part:
        m = _SEAM.search(text, at + part)
        if m is None:
            break
        n, at = n + len(enc.encode_ordinary(text[at : m.start()])), m.start()
    return n + len(enc.encode_ordinary(text[at:]))


def sized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of (doc_id, source, text) rows; 0 tokens for null and empty texts."""
    pattern, ranks = vocabulary(path)

    def run(batches):
        enc = encoding(pattern, ranks)
        for pdf in batches:
            n = [count(enc, t) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": pd.Series(n, dtype="int64", index=pdf.index)})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, tokens long")
