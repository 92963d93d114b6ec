"""What the two classifiers share: features of whole texts, and a bounded set of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilerec.llm import tokens

#: Letters and digits of ASCII and every byte beyond it belong to words; the rest parts them.
_LETTER = np.ones(256, dtype=bool)
_LETTER[:128] = False
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _LETTER[_low:_high] = True


def plain_words(data: np.ndarray, offsets: np.ndarray, powers: tokens.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the words without punctuation."""
    spaced = np.where(_LETTER[data], data, np.uint8(32))
    return tokens.words(spaced, offsets, powers)


def distinct_words(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each different word of each text, in order."""
    order = np.lexsort((word, text))
    word, text = word[order], text[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    return word[new], text[new]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """Documents with a label (0 or 1), ``rows`` at most: those with the smallest hash of their id.

    ``usable`` is a condition on the id. Null ids and labels are left out; of several labels of one
    document the largest counts, and of several documents with one id each is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(doc_id, label).where(usable)
    chosen = known.groupBy(doc_id).agg(F.max(label).alias("_label")).orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    # At most ``rows`` ids: a bounded broadcast instead of a shuffle of all texts.
    return docs.join(F.broadcast(chosen), doc_id)


def pack_lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """A list column of ``n`` rows from values sorted by row number."""
    ends = np.cumsum(np.bincount(rows, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Groups of whole texts of all batches: (rows, bytes, offsets)."""
    for batch in batches:
        for first, n, data, offsets in tokens.groups(batch.column(batch.schema.get_field_index(column))):
            yield batch.slice(first, n), data, offsets
