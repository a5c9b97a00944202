"""Cost-balanced packing of tokenised documents into sequences.

A document's ids are cut into pieces where they are made: whole pieces of `capacity`, then the rest. Only
lengths and checksums are shuffled, never ids. Pieces are dealt into groups of bounded size by a hash that
also has the place in the partition, so that repeated ids can't fill one group. In a group a document's cost
is estimated as linear * n + quadratic * n^2 (attention within the document); descending pieces go to the
lowest-cost sequence that still has room. The group opens the least number of sequences that holds its
tokens, and another one where none has room.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER):
    """text -> ids as uint32. Ordinary text goes through the same vocabulary's byte-pair ranks, which is the
    faster implementation of the same function; text with a special token's string goes to the tokenizer itself."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(i) for a, i in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def cut_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and salt for each piece. Null text counts as empty (one id)."""

    def run(batches):
        encode, part, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            which, start, length, crc, total, salt = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    which.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    salt.append((part << 33) + row)
                    row += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, salt))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. Ties: the piece that comes first, the sequence of the lowest number."""
    order = np.argsort(-lengths, kind="stable")
    count = max(1, -(-int(lengths.sum()) // capacity))
    room, cost = np.full(count, capacity, np.int64), np.zeros(count)
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        n = int(lengths[i])
        fits = np.flatnonzero(room >= n)
        if len(fits):
            s = int(fits[np.argmin(cost[fits])])
        else:
            s = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        seq[i], offset[i] = s, capacity - room[s]
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
    return seq, offset


def pack(docs: DataFrame, capacity: int = 2048, group: int = 8192, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each row of docs lies in exactly one piece; a null or empty text is its end id alone. Repeated
    rows and null doc_ids are packed like others. Other columns are ignored. An empty table gives no rows.
    """
    pieces = cut(cut_pieces(docs, capacity, tokenizer), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def run(key, rows):
        rows = rows.sort_by("salt")
        seq, offset = assign(rows.column("length").to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array((key[0].as_py() << 24) + seq)).append_column("offset", pa.array(offset))
        return rows.drop_columns(["g", "salt"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("salt"), F.lit(groups))).groupBy("g")
    return grouped.applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
