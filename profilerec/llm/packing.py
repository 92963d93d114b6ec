"""Mixture-controlled packing: deficit round-robin over source queues into sequences of fixed length.

Each round gives every queue its quantum of tokens, a fraction of a window. A queue's deficit is
the fraction of a token that it could not send yet, so after ``r`` rounds it has sent the whole
part of ``r`` quanta. That closed form places any token without replaying earlier rounds: tasks
work alone, and deficits carry over windows and partitions exactly.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilerec.llm import tokens
from profilerec.session import StepTables

#: Quanta are multiples of one token over this power of two.
FINE = 12
#: Rounds times queues that are reckoned at once.
CELLS = 1 << 20


@dataclass(frozen=True)
class PackingOptions:
    """``window`` sequences make a window. Every source has a queue of its own, unless ``queues`` bounds
    how many have: then those with most bytes have one, and the rest share one.

    ``targets`` maps a source to its share of each window, relative to the others where all have an
    entry. Else the entries are shares of the whole window, less than 1 together, and the other
    sources divide what remains by their tokens. When a queue is empty, the others go on with their
    quanta.
    """

    length: int = 1024
    window: int = 16
    queues: int | None = None
    end_id: int = 0
    targets: tuple[tuple[str, float], ...] | None = None


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from a text to its ids, for a ``tokenizers`` file, without special tokens.

    A byte-level BPE file whose ids follow its merges is run by ``tiktoken``, which gives the same
    ids several times faster; any other file by ``tokenizers``.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        and before.get("use_regex", True) and not spec.get("normalizer") and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix") and not model.get("dropout")
    )
    if plain:
        # The byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest follows from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged))):
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            run = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            return lambda text: np.asarray(run.encode_to_numpy(text, disallowed_special=()), np.uint32)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: np.asarray(own.encode(text, add_special_tokens=False).ids, np.uint32)


def _queue_names(docs: DataFrame, source: str, options: PackingOptions) -> list[str]:
    """Sources with a queue of their own, targets first."""
    named = [s for s, _ in options.targets or ()]
    size = F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))) if options.queues is not None else F.count("*")
    sizes = docs.groupBy(_source(source).alias("s")).agg(size.alias("size"))
    if options.queues is None:
        return list(dict.fromkeys([*named, *sorted(r["s"] for r in sizes.collect())]))
    top = sizes.orderBy(F.desc("size"), "s").limit(options.queues).collect()
    return list(dict.fromkeys([*named, *sorted(r["s"] for r in top)]))[: max(options.queues, len(named))]


def _source(source: str):
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def _shares(names: list[str], totals: np.ndarray, targets: dict[str, float]) -> np.ndarray:
    """Share of each queue, the last one without a name."""
    given = np.array([targets.get(name, 0.0) for name in names] + [0.0])
    other = np.where([name not in targets for name in names] + [True], totals, 0).astype(float)
    if other.sum() > 0:
        if given.sum() >= 1:
            raise ValueError("targets take whole windows, but other sources have tokens too")
        given = given + (1 - given.sum()) * other / other.sum()
    return given / max(given.sum(), 1e-300)


def _encode(batches, path: str, end_id: int, number):
    """Per document its ids, and where they begin among its queue's tokens of this task."""
    encode, part, queue_of = encoder(path), TaskContext.get().partitionId(), number.value
    sent = np.zeros(len(queue_of) + 1, np.int64)
    for batch in batches:
        for first, n, _, _ in tokens.groups(batch.column(2)):
            rows = batch.slice(first, n)
            queue = np.array([queue_of.get(x, len(queue_of)) for x in rows.column(1).to_pylist()], np.int32)
            coded, starts = [], np.zeros(n, np.int64)
            for i, text in enumerate(rows.column(2).to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)) if text else np.array([end_id], np.uint32)
                starts[i] = sent[queue[i]]
                sent[queue[i]] += len(ids)
                coded.append(ids)
            narrow = np.uint16 if max(int(c.max()) for c in coded) < 1 << 16 else np.uint32
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(np.full(n, part, np.int64)), pa.array(queue), pa.array([len(c) for c in coded], pa.int64()),
                pa.array(starts), pa.array(np.full(n, np.dtype(narrow).itemsize, np.int32)),
                pa.array([c.astype(narrow).tobytes() for c in coded], pa.binary()),
            ], ["doc_id", "part", "queue", "n", "at", "width", "ids"])


def sent(rounds: np.ndarray, quanta: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Tokens that each queue has sent after so many rounds: a row per entry of ``rounds``."""
    # A queue needs so many rounds; the bound keeps the product within 64 bits.
    needed = -(-(totals << FINE) // quanta)
    return np.minimum(totals[None, :], (np.minimum(rounds[:, None], needed[None, :]) * quanta[None, :]) >> FINE)


def place(queue: np.ndarray, start: np.ndarray, n: np.ndarray, quanta: np.ndarray, totals: np.ndarray, length: int):
    """Pieces of runs of tokens: (row, start in the row, piece length, place in the stream).

    A run is ``n`` tokens of a queue from its token ``start`` on. It is cut where a round or a
    sequence ends.
    """
    step = quanta[queue]
    first = -(-((start + 1) << FINE) // step) - 1
    last = -(-((start + n) << FINE) // step) - 1
    # A queue with less than a token a round sends in some rounds only: those of its tokens.
    slow = step < 1 << FINE
    count = np.where(slow, n, last - first + 1)
    row = np.repeat(np.arange(len(queue)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    r = np.where(slow[row], -(-((start[row] + k + 1) << FINE) // step[row]) - 1, first[row] + k)
    q = queue[row]
    low, high, stream = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    many = max(1, CELLS // len(totals))
    for i in range(0, len(row), many):
        part = slice(i, i + many)
        before, after = sent(r[part], quanta, totals), sent(r[part] + 1, quanta, totals)
        pick, own = np.arange(len(before)), q[part]
        low[part] = np.maximum(before[pick, own], start[row[part]])
        high[part] = np.minimum(after[pick, own], (start + n)[row[part]])
        # In a round the queues send in order: those before this one are one round further.
        ahead = np.cumsum(after - before, axis=1)[pick, own] - (after - before)[pick, own]
        stream[part] = before.sum(axis=1) + ahead + low[part] - before[pick, own]
    size = high - low
    keep = size > 0
    row, low, size, stream = row[keep], low[keep], size[keep], stream[keep]
    cuts = (stream + size - 1) // length - stream // length + 1
    again = np.repeat(np.arange(len(row)), cuts)
    k = np.arange(len(again)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = np.maximum(stream[again], (stream[again] // length + k) * length)
    end = np.minimum((stream + size)[again], (stream[again] // length + k + 1) * length)
    return row[again], low[again] - start[row[again]] + begin - stream[again], end - begin, begin


def pack(docs: DataFrame, tokenizer: str, options: PackingOptions | None = None, source: str = "source", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, gapless in sequences of ``length`` ids; only the last one is not full.

    Returns doc_id, start (ids of its document before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset and, unless ``with_ids`` is False, ids (little-endian 32-bit). Each document
    ends with ``end_id``; a null or empty text is that id alone. Null sources are one source. Equal
    ids or texts are packed once per row. An empty table gives no pieces. Other columns are ignored.
    """
    options = options or PackingOptions()
    spark = docs.sparkSession
    steps = StepTables(spark, "packing")
    names = _queue_names(docs, source, options)
    rows = docs.select("doc_id", _source(source).alias("queue"), "text")
    number = spark.sparkContext.broadcast({name: i for i, name in enumerate(names)})
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("part bigint, queue int, n bigint, at bigint, width int, ids binary").fields])
    count, end_id = len(names), options.end_id
    coded = steps.write(rows.mapInArrow(lambda b: _encode(b, tokenizer, end_id, number), schema), "ids")
    sums = steps.write(coded.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    totals = np.zeros(count + 1, np.int64)
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():
        totals[r["queue"]] = r["n"]
    share = _shares(names, totals, dict(options.targets or ()))
    quanta = np.maximum(np.round(options.length * options.window * share * (1 << FINE)).astype(np.int64), 1)
    begin = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", "queue", F.coalesce(begin, F.lit(0)).alias("before"))
    placed = coded.join(offsets, ["part", "queue"]).select("doc_id", "queue", "n", (F.col("before") + F.col("at")).alias("at"), "width", "ids")
    length = options.length

    def pieces(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                b = batch.slice(lo, 500)
                q, n, at, width = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3, 4))
                row, start, size, stream = place(q, at, n, quanta, totals, length)
                ids = [np.frombuffer(x, np.uint16 if w == 2 else np.uint32).astype("<u4") for x, w in zip(b.column(5).to_pylist(), width)]
                cut = [ids[i][s : s + k].tobytes() for i, s, k in zip(row, start, size)]
                columns = [
                    b.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                    pa.array(n[row]), pa.array(stream // length), pa.array(stream % length),
                ]
                out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns, out = [*columns, pa.array(cut, pa.binary())], [*out, "ids"]
                yield pa.RecordBatch.from_arrays(columns, out)

    ddl = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    return placed.mapInArrow(pieces, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(ddl).fields]))
