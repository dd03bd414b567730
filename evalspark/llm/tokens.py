"""Token ids of texts by a public byte-level BPE vocabulary.

The vocabulary cuts a text in front of single blanks, so a text's ids are those of its blank-separated
words in a row, and each task looks most words up in a bounded memory of words that it has seen. Texts with
runs of white space that such a cut would break, or with the vocabulary's special token, are encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.session import ship_package

# Words that a task remembers, and the longest of them: a bound on its memory, not on what it encodes.
REMEMBERED, LONGEST = 200_000, 64
_BROKEN_RUN = re.compile(r"\s \s|\s \Z")


def default_vocabulary() -> tuple[str, str]:
    """Paths of one vocabulary in the formats of two libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Words(dict):
    """Ids of a word with a blank in front, as little-endian 32-bit bytes."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) < REMEMBERED and len(word) <= LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.encode_word = own.encode_ordinary
        self.words = _Words(own.encode_ordinary)
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _BROKEN_RUN.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.array(self.encode_word(first), "<u4").tobytes()
        return b"".join([head, *map(self.words.__getitem__, rest)])


@lru_cache(2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    """One encoder per Python worker, which keeps its memory of words from task to task."""
    return Encoder(json_path, ranks_path)


def _counter(vocabulary: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*vocabulary).encode
        for batch in batches:
            texts = batch.column("text")
            n = [len(encode(texts[i].as_py())) // 4 for i in range(len(texts))]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(n, pa.int64())], [*names, "n_tokens"]
            )

    return run


def with_token_counts(
    documents: DataFrame, keep: tuple[str, ...] = (), vocabulary: tuple[str, str] | None = None
) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the encoded length of ``text``; a null text has none."""
    ship_package(documents.sparkSession)
    kinds = dict(documents.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_tokens bigint"])
    return documents.select(*keep, "text").mapInArrow(_counter(vocabulary or default_vocabulary()), schema)
