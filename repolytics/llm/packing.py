"""Vector best-fit packing of token sequences.

Documents are encoded, closed by an end id and, where longer than a sequence, cut into
full pieces after a shorter first one.  Each piece is a vector of demands (tokens, one
document, attention cost = length squared), each sequence a vector of capacities.  In
decreasing order of length a piece goes to the open sequence that can hold it in every
dimension and that it leaves with the smallest weighted norm of residuals, or, by
choice, the largest weighted dot product of demand and residual.

Pieces are dealt at random to groups of bounded size and each group is packed by
itself; a group wastes at most its last few sequences, so the result is within a
fraction of a per cent of one packing of the whole.  Full pieces need no packing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repolytics.llm.common import checkpointed
from repolytics.llm.tokens import END_ID, TOKENIZER, encoder


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds.

    tokens: ids; documents: pieces; attention: the sum of squared piece lengths (at most
    tokens squared whatever the pieces, so the default binds nothing further).
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


def piece_lengths(total: int, most: int) -> list[int]:
    """total ids in pieces of at most most; only the first may be shorter."""
    first = total % most
    return [first] * (first > 0) + [most] * (total // most)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(most: int, name: str, path: str | None):
    def run(batches):
        encode = encoder(name, path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids, start = encode.ids(text) + end, 0
                    for piece, length in enumerate(piece_lengths(len(ids) // 4, most)):
                        rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start += length
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, packed in decreasing order of length.

    Equal lengths that fill an empty sequence alike still go one by one; sequences too
    full for the shortest piece are closed and no longer looked at.
    """
    order = np.argsort(-lengths, kind="stable")
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    scale = np.array(weights) / caps**2
    least = int(lengths.min()) if len(lengths) else 0
    size = 1024
    left, ids = np.zeros((3, size)), np.zeros(size, np.int64)
    n_open = n_bins = 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in order:
        length = int(lengths[k])
        need = np.array([length, 1.0, float(length) * length])
        if length > caps[0] or need[2] > caps[2] or caps[1] < 1:
            raise ValueError("a piece is larger than a sequence")
        at = -1
        if n_open:
            rest = left[:, :n_open] - need[:, None]
            fits = (rest[0] >= 0) & (rest[1] >= 0) & (rest[2] >= 0)
            if fits.any():
                if rule == "norm":
                    at = int(np.argmin(np.where(fits, scale @ (rest * rest), np.inf)))
                else:
                    at = int(np.argmax(np.where(fits, (scale * need) @ left[:, :n_open], -np.inf)))
        if at < 0:
            if n_open == size:
                size *= 2
                left, ids = np.concatenate([left, np.zeros_like(left)], axis=1), np.concatenate([ids, np.zeros_like(ids)])
            at, n_open = n_open, n_open + 1
            left[:, at], ids[at], n_bins = caps, n_bins, n_bins + 1
        bins[k], offsets[k] = ids[at], capacity.tokens - int(left[0, at])
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1:
            n_open -= 1
            left[:, at], ids[at] = left[:, n_open], ids[n_open]
    return bins, offsets


_PACKED = _PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", tokenizer: str = TOKENIZER, path: str | None = None, group_pieces: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are the end id alone; repeated rows are packed as often as they
    occur; rows without a doc_id are packed like any other and keep the null; pieces of
    equal length are packed in the order of doc_id and piece; an empty table gives an empty
    result; further columns of docs are not looked at.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    most = min(capacity.tokens, int(capacity.attention**0.5))
    texts = docs.select("doc_id", "text")
    pieces = checkpointed(texts.mapInArrow(_cut(most, tokenizer, path), _PIECES))
    full = F.col("length") == capacity.tokens
    part = pieces.filter(~full)
    groups = max(1, -(-part.count() // group_pieces))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(groups))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "length"], ignore_index=True)
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity, rule)
        frame["sequence_id"] = frame["pack_group"] * (1 << 32) + bins
        frame["offset"] = offsets
        return frame.drop(columns="pack_group")

    packed = part.withColumn("pack_group", deal).groupBy("pack_group").applyInPandas(fit, _PACKED)
    whole = pieces.filter(full).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)
