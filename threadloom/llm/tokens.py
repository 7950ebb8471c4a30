"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts come as Arrow buffers and are encoded in slices balanced by bytes; a text
longer than a slice is cut where a token must end, so no worker holds more than
a slice's temporaries. No shuffle: one map over the table.

Null or empty text: 0 bytes, 0 tokens. Null or repeated ids and repeated rows
stay as they are, one row out for each row in; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm import _bpe
from threadloom.llm._arrow import bounded_batches, text_buffers


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _bpe.load(tokenizer_path)
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            counts, _ = encoder.encode(raw, offs, want_ids=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offs)), pa.array(counts), pa.array(counts > limit)],
                names=[batch.schema.field(0).name, "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    return bounded_batches(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
