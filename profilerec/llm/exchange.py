"""Totals of many keys across units of work, by requests and answers instead of a row per key.

A unit sends its distinct keys, sorted and compressed, to the tasks that own their hash range; each
answer lists the totals in the order of the request. Equal keys of a unit are combined first, so a
key costs one entry per unit, however frequent it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from profilerec.llm.lm import bucket_of, restore, squeeze

REQUEST = "bucket int, unit bigint, tag int, keys binary, weights binary"
ANSWER = "unit bigint, tag int, bucket int, totals binary, firsts binary"


def requests(unit: int, tag: int, keys: np.ndarray, weights: np.ndarray, buckets: int, width: int = 64) -> list[tuple]:
    """Rows of a request for the totals of ``keys`` of ``width`` bits, to which the unit adds ``weights``."""
    unique, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, weights, len(unique)).astype(np.uint32)
    cut = np.searchsorted(bucket_of(unique, width, buckets), np.arange(buckets + 1))
    return [
        (b, unit, tag, squeeze(np.diff(unique[cut[b] : cut[b + 1]], prepend=np.uint64(0))), squeeze(total[cut[b] : cut[b + 1]]))
        for b in range(buckets) if cut[b + 1] > cut[b]
    ]


def request_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "unit", "tag", "keys", "weights"])


def _answer(part: pd.DataFrame) -> pd.DataFrame:
    out = []
    for tag, group in part.groupby("tag"):
        keys = [np.cumsum(restore(x, np.uint64), dtype=np.uint64) for x in group["keys"]]
        weights = np.concatenate([restore(x, np.uint32) for x in group["weights"]]).astype(np.int64)
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights, len(unique)).astype(np.uint64)
        first = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(first, place, np.repeat(group["unit"].to_numpy(np.int64), [len(k) for k in keys]))
        at = 0
        for unit, own in zip(group["unit"], keys):
            mine = place[at : at + len(own)]
            out.append((unit, tag, group["bucket"].iloc[0], squeeze(total[mine]), squeeze(first[mine].astype(np.uint64))))
            at += len(own)
    return pd.DataFrame(out, columns=["unit", "tag", "bucket", "totals", "firsts"])


def answer(asked: DataFrame) -> DataFrame:
    """Answers to request rows; the first unit that named a key comes with each total."""
    return asked.groupBy("bucket").applyInPandas(_answer, ANSWER)


def read_answer(answers: pd.DataFrame, tag: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, first unit) of each of ``keys``, which the unit had asked for."""
    mine = answers[answers["tag"] == tag].sort_values("bucket")
    total = np.concatenate([*[restore(x, np.uint64) for x in mine["totals"]], np.zeros(0, np.uint64)])
    first = np.concatenate([*[restore(x, np.uint64) for x in mine["firsts"]], np.zeros(0, np.uint64)])
    place = np.unique(keys, return_inverse=True)[1]
    return total[place].astype(np.int64), first[place].astype(np.int64)


def task_unit(number: int) -> int:
    """A unit id of its own for this task."""
    return (TaskContext.get().partitionId() << 32) + number

