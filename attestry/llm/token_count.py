"""Token counts by overlap resynchronisation (see ``_bpe`` for the splicing).

Texts of more than ``CHUNK`` characters go to the library in overlapping
chunks with offsets, spliced at proven common boundaries, so a worker holds the
encoding of two chunks of a huge text, not of all of it; shorter ones are
encoded at once, by their cached pieces.

Defined cases: null text counts as empty, with 0 bytes and 0 tokens; a text
without any place to splice is one chunk; repeated rows are each counted; an
empty table gives none; more columns are kept, but for the names added here,
which replace columns of the same name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestry.llm import _bpe, _text

#: Characters from which on a text is taken in chunks.
CHUNK = 1 << 14

FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit); tokenizer: a file that every executor can open."""

    def make(batch: pa.RecordBatch) -> list:
        enc = _bpe.encoder(tokenizer, chunk=CHUNK)
        n_bytes, n_tokens = [], []
        for row, end, _buf, offs in _text.text_slices(batch.column("text")):
            texts = [t or "" for t in batch.column("text")[row:end].to_pylist()]
            n_bytes += (offs[1:] - offs[:-1]).tolist()
            n_tokens += [len(x) // enc.dtype.itemsize for x in enc.batch(texts)]
        return [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])]

    return _text.append_arrow(docs, FIELDS, make)
