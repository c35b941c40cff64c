"""Vector bin packing of examples into training sequences.

A sequence holds at most `Limits.tokens` tokens, `segments` pieces and `loss` loss-bearing
tokens. Documents are tokenised where they are read; a longer document is cut into full
sequences and a remainder. What is then packed is one small row a piece: rows are dealt
into groups of bounded size by a hash, and each group is packed by the dot-product
heuristic: the open sequence takes, of the pieces that fit, the one whose (tokens,
segments, loss) vector has the largest dot product with the room left, both scaled by the
limits and weighted by what the group needs in all. Pieces of equal needs are
interchangeable, so each step looks at the distinct needs only.

Loss-bearing are all ids of a document but its first, which nothing predicts, and in a
conversation those of the turns of some roles: there the loss limit binds apart from the
tokens, and a sequence mixes examples of much and of little loss.

Defined results: a null text is empty, its only id the closing one; repeated rows are
packed one by one; a text of any length is cut, never shortened; `loss` below the tokens
of a sequence caps how long a cut piece may be, so that every piece fits alone; an empty
table gives an empty result; other columns are dropped unless `payload` names them.
"""

from __future__ import annotations

import base64
import json
import math
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprov.llm.common import by_group, map_columns

END = 0


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None = None, pattern: str | None = None):  # noqa: ANN201
    """The byte-level BPE vocabulary as ranks, with the added tokens of its JSON form: same ids, about five times as fast."""
    import tiktoken

    special = {}
    if ranks_path is None:
        import public_tokenizers

        with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(ranks_path), pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str | None, ranks_path: str | None = None, pattern: str | None = None) -> np.ndarray:
    """Ids of a text, special tokens read as ordinary text, and the closing id."""
    ids = encoder(ranks_path, pattern).encode_ordinary(text) if text else []
    return np.array([*ids, END], dtype="<u4")


def contract_ids(text: str | None, ranks_path: str | None = None, pattern: str | None = None) -> np.ndarray:
    """Ids of a text as `tokenizers` gives them by default, added tokens in it read as such, and the closing id."""
    ids = encoder(ranks_path, pattern).encode(text, allowed_special="all") if text else []
    return np.array([*ids, END], dtype="<u4")


def pieces(docs: DataFrame, limits: Limits = Limits(), with_ids: bool = True, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, start, length, loss, ids_crc32, doc_tokens[, ids]) for each piece of each text."""
    most = min(limits.tokens, limits.loss)
    columns = (key, "start", "length", "loss", "ids_crc32", "doc_tokens", *["ids"] * with_ids)

    def cut(keys: list, texts: list) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {c: [] for c in columns}
        for k, t in zip(keys, texts, strict=True):
            ids = contract_ids(t, ranks_path, pattern)
            for at in range(0, len(ids), most):
                part = ids[at : at + most]
                row = (k, at, len(part), len(part) - (at == 0), zlib.crc32(part.tobytes()), len(ids), *[part.astype(np.int32)] * with_ids)
                for c, v in zip(columns, row, strict=True):
                    out[c].append(v)
            if len(out[key]) >= 4096:
                yield out
                out = {c: [] for c in columns}
        yield out

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs, [key, text], cut, f"`{key}` {kind}, start long, length long, loss long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def conversation_pieces(turns: DataFrame, limits: Limits = Limits(), bearing: tuple[str, ...] = ("assistant",), key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, start, length, loss, ids_crc32, doc_tokens, ids, bears) for each piece of each conversation: its turns in
    order, each ended by the closing id; `bears` says of each id whether it bears loss. A conversation beyond a limit
    is cut where it reaches it; `doc_tokens` counts up to the end of the piece, as a conversation is read as a
    stream. Equal places are taken by role and text; a turn without a key is a conversation of its own."""
    columns = (key, "start", "length", "loss", "ids_crc32", "doc_tokens", "ids", "bears")

    def cut(tables: Iterator[pa.Table]) -> Iterator[dict[str, list]]:
        name, start = None, 0
        ids, bears = np.zeros(0, "<u4"), np.zeros(0, bool)

        def piece(n: int) -> dict[str, list]:
            part, own = ids[:n], bears[:n]
            row = (name, start, n, int(own.sum()), zlib.crc32(part.tobytes()), start + n, part.astype(np.int32), own)
            return {c: [v] for c, v in zip(columns, row, strict=True)}

        for t in tables:
            name = t[key][0].as_py()
            for who, said in zip(t[role].to_pylist(), t[text].to_pylist(), strict=True):
                new = contract_ids(said, ranks_path, pattern)
                ids, bears = np.concatenate([ids, new]), np.concatenate([bears, np.full(len(new), who in bearing)])
                while len(ids) > limits.tokens or bears.sum() > limits.loss:
                    n = min(limits.tokens, int(np.searchsorted(np.cumsum(bears), limits.loss, side="right")))
                    yield piece(n)
                    start, ids, bears = start + n, ids[n:], bears[n:]
        if len(ids):
            yield piece(len(ids))

    kind = turns.schema[key].dataType.simpleString()
    own = turns.select(key, order, F.col(role).cast("string").alias(role), F.col(text).cast("string").alias(text))
    return by_group(own, [key], [order, role, text], cut, f"`{key}` {kind}, start long, length long, loss long, ids_crc32 long, doc_tokens long, ids array<int>, bears array<boolean>")


def assign(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place in it) of each piece. A piece that fits no open sequence opens one,
    the largest first."""
    full = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
    queues: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(len(tokens) - 1, -1, -1):
        queues[int(tokens[i]), int(loss[i])].append(i)
    kinds = np.array(sorted(queues, reverse=True), dtype=np.int64).reshape(-1, 2)
    need = np.column_stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]]) / full
    count = np.array([len(queues[int(a), int(b)]) for a, b in kinds])
    weight = (need * count[:, None]).sum(0)
    weight /= max(weight.sum(), 1e-9)
    sequence, place = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    no = 0
    live = np.arange(len(kinds))
    while len(live):
        room, segments = np.ones(3), 0
        pick = live[0]  # the largest left
        while pick is not None:
            i = queues[int(kinds[pick, 0]), int(kinds[pick, 1])].pop()
            sequence[i], place[i] = no, segments
            segments += 1
            room = room - need[pick]
            count[pick] -= 1
            if not count[pick]:
                live = live[live != pick]
            # Sorted by tokens: what fits by tokens is a tail.
            first = np.searchsorted(-need[live, 0], -(room[0] + 1e-9))
            tail = live[first:]
            fits = tail[(need[tail] <= room + 1e-9).all(1)]
            pick = fits[(need[fits] @ (weight * room)).argmax()] if len(fits) else None
        no += 1
    return sequence, place


def group_count(docs: DataFrame, limits: Limits = Limits(), group_rows: int = 4096, text: str = "text") -> int:
    """Groups enough that none is expected to get more than `group_rows` pieces: a text has
    no more ids than bytes, and one more."""
    most = min(limits.tokens, limits.loss)
    found = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("bytes")).first()
    return max(1, math.ceil((found.n + (found.bytes or 0) / most) / group_rows))


def _packed(group: pa.Table, limits: Limits) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A group's pieces in the order of its sequences, with each one's sequence and offset."""
    group = group.sort_by([("order_no", "ascending"), ("start", "ascending"), ("length", "ascending")])
    sequence, place = assign(group["length"].to_numpy(), group["loss"].to_numpy(), limits)
    order = np.lexsort((place, sequence))
    group, sequence, place = group.take(pa.array(order)), sequence[order], place[order]
    length = group["length"].to_numpy()
    before = np.cumsum(length) - length
    first = np.flatnonzero(place == 0)
    offset = before - np.repeat(before[first], np.diff([*first, len(order)]))
    return group, sequence + group["group_no"][0].as_py() * (1 << 32), offset


def _dealt(rows: DataFrame, groups: int, key: str, keep: list[str]) -> DataFrame:
    # Start and checksum keep the pieces of repeated keys apart.
    spread = F.xxhash64(key, "start", "ids_crc32")
    return rows.select(F.pmod(spread, F.lit(groups)).cast("long").alias("group_no"), F.xxhash64(spread).alias("order_no"), *dict.fromkeys(["loss", *keep])).groupBy("group_no")


def pack(rows: DataFrame, groups: int, limits: Limits = Limits(), key: str = "doc_id", payload: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset to pieces; `payload` names further columns to carry."""
    keep = [key, "start", "length", *payload]

    def run(group: pa.Table) -> pa.Table:
        group, sequence, offset = _packed(group, limits)
        return group.select(keep).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return _dealt(rows, groups, key, keep).applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, n_tokens, n_segments, ids, keys, lengths): the packed ids themselves,
    and whose pieces they are, in order."""
    rows = pieces(docs, limits, True, key, text)

    def run(group: pa.Table) -> pa.Table:
        group, sequence, offset = _packed(group, limits)
        first = np.append(np.flatnonzero(offset == 0), len(sequence))
        ids = group["ids"].combine_chunks()
        cuts = ids.offsets.to_numpy()
        length = group["length"].to_numpy()
        columns = [
            pa.array(sequence[first[:-1]], pa.int64()),
            pa.array(np.add.reduceat(length, first[:-1]), pa.int64()),
            pa.array(np.diff(first), pa.int64()),
            pa.ListArray.from_arrays(pa.array(cuts[first], pa.int32()), ids.values),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), group[key].combine_chunks()),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), group["length"].combine_chunks()),
        ]
        return pa.Table.from_arrays(columns, names=["sequence_id", "n_tokens", "n_segments", "ids", "keys", "lengths"])

    kind = docs.schema[key].dataType.simpleString()
    dealt = _dealt(rows, group_count(docs, limits, text=text), key, [key, "start", "length", "ids"])
    return dealt.applyInArrow(run, f"sequence_id long, n_tokens long, n_segments long, ids array<int>, keys array<{kind}>, lengths array<long>")
