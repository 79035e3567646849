"""Token counts under a public byte-level vocabulary."""

from __future__ import annotations

import base64
import functools
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary file lies; a parameter everywhere it is used.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longest run without white space handed to the tokenizer at once.  A longer run
#: is cut here, which bounds the tokenizer's time and leaves the count of any
#: ordinary text as it is.
LONGEST_RUN = 20_000


@functools.cache
def encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Ids of a text; whole texts, however long."""
    enc = encoder(path)
    if len(text) <= LONGEST_RUN or not re.search(rf"\S{{{LONGEST_RUN}}}", text):
        return enc.encode_ordinary(text)
    parts = re.findall(rf"\s*\S{{1,{LONGEST_RUN}}}|\s+$", text)
    return [t for part in parts for t in enc.encode_ordinary(part)]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for NULL and empty ones."""

    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t, path)) if t else 0).astype("int64")

    # marked so that a filter on the count does not tokenise a second time
    return F.pandas_udf(count, T.LongType()).asNondeterministic()(F.coalesce(text, F.lit("")))
