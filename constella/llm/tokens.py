"""Token counts of whole texts as the tokenizer library gives them, with huge documents encoded in overlapping chunks.

Overlap resynchronisation: a huge text is cut into chunks that overlap. Encoding a chunk gives, for each token, its offsets
and the pre-token it belongs to. The pre-tokenizer scans from left to right, and from any pre-token start on its result
depends on nothing before it. So, with the left chunk entered at a proven pre-token start of the whole text, each later
pre-token start in it is one of the whole text as long as what follows it up to ``margin`` characters lies in the chunk; and
where the right chunk also starts a pre-token at such a place, both agree from there on. The chunks are spliced at the first
such place of the overlap. Where there is none, as inside a very long run of letters, the left chunk is widened and encoded
again, in the extreme up to the end of the text.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

CHUNK, OVERLAP = 16_384, 512  # characters


def once(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in a Python worker process however many tasks it runs."""
    kept = sys.modules.setdefault("_constella_kept", types.ModuleType("_constella_kept"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]


def load(path: str) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return once(path, lambda: Tokenizer.from_file(path))


def _starts(encoding: Any) -> tuple[np.ndarray, np.ndarray]:
    """Character positions where a pre-token or special token starts, and the index of its first token."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    at = np.array([o[0] for o in encoding.offsets], dtype=np.int64)
    if not len(words):
        return at, words
    first = np.ones(len(words), dtype=bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    return at[first], np.flatnonzero(first)


def chunked_ids(tokenizer: Any, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of the whole text, from overlapping chunks."""
    margin = 2 + max([len(t.content) for t in tokenizer.get_added_tokens_decoder().values()], default=0)
    n, begin, ids = len(text), 0, []
    while True:
        reach, wide = min(n, begin + chunk + overlap), overlap
        while True:
            left = tokenizer.encode(text[begin:reach], add_special_tokens=False)
            if reach >= n:
                return ids + left.ids
            at, token = _starts(left)
            proven = (at > 0) & (at < reach - begin - margin)
            after = max(reach - wide, begin + 1)
            right, _ = _starts(tokenizer.encode(text[after:min(n, reach + margin)], add_special_tokens=False))
            common = np.flatnonzero(proven & np.isin(at + begin, right[1:] + after))
            if len(common):
                splice = common[0]
                ids += left.ids[: token[splice]]
                begin += int(at[splice])
                break
            wide *= 2
            reach = min(n, reach + wide)


def _counter(path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for whole in batches:
            for b in slices(whole):
                texts = [t or "" for t in b.column("text").to_pylist()]
                huge = [len(t) > 2 * CHUNK for t in texts]
                short = iter(tokenizer.encode_batch_fast([t for t, h in zip(texts, huge, strict=True) if not h], add_special_tokens=False))
                n = np.array([len(chunked_ids(tokenizer, t)) if h else len(next(short).ids) for t, h in zip(texts, huge, strict=True)], dtype=np.int64)
                size = np.array([len(t.encode()) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_tokens, over_limit``; no shuffle.

    Null or empty text: 0 bytes, 0 tokens. Null and repeated ids stay as they are, a row each. Extra columns are ignored.
    Strings of special tokens inside a text count as the library counts them by default.
    """
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return given.mapInArrow(_counter(tokenizer_path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
