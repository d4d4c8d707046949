"""Token counts by a public tokenizer whose vocabulary file lies outside the repository."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how the vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the white space of the pattern's ``\s`` (Unicode's White_Space).
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Blank runs from this length on are counted on their own: the pattern's look-ahead would recurse once a character.
RUN = 500
_RUNS = re.compile(f"[{BLANKS}]{{{RUN},}}")


def encoding(path: str):
    """The tokenizer of a vocabulary file and the same one without splitting, loaded once a Python worker (functions are shipped anew with every task)."""
    import sys
    import types

    import tiktoken

    kept = sys.modules.setdefault("_cohortex_worker_cache", types.ModuleType("_cohortex_worker_cache")).__dict__
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tuple(tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("byte-bpe", PATTERN), ("one-piece", r"[\s\S]+")))
    return kept[path]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text, exactly as many as the tokenizer gives.

    A run of blanks before other text is, by the pattern, one piece without its
    last character, which opens the next piece; at the end of the text it is
    one piece.  Long runs are merged as that piece, apart from the text around
    them, so their length is no matter of the stack.
    """
    if not text:
        return 0
    enc, whole = encoding(path)
    n, at = 0, 0
    for m in _RUNS.finditer(text) if len(text) >= RUN else ():
        end = m.end() - (m.end() < len(text))
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(whole.encode_ordinary(text[m.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def token_sizes(docs: DataFrame, doc: str, text: str, keep: dict[str, "F.Column"], path: str = VOCABULARY) -> DataFrame:
    """``doc_id, *keep, tokens`` for every row; null texts have null tokens, empty ones 0.  Text stays in its task."""
    schema = {k: docs.select(c.alias(k)).schema[0].dataType.simpleString() for k, c in keep.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding(path)
        for batch in batches:
            n = pd.array([None if t is None else count_tokens(t, path) for t in batch["t"]], dtype="Int64")
            yield batch.drop(columns="t").assign(tokens=n)

    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), *[c.alias(k) for k, c in keep.items()], F.col(text).alias("t"))
    return slim.mapInPandas(count, ", ".join(["doc_id long", *[f"{k} {t}" for k, t in schema.items()], "tokens long"]))
