"""Best-fit packing of documents into sequences by sums of squares.

A sequence holds at most `capacity` tokens. What an open sequence has left is its gap; with
N(g) open sequences of gap g, each document goes where the sum of N(g)² over all gaps
becomes smallest, a new sequence being one of the choices, and equal choices going to the
smallest gap. That keeps open sequences of many different gaps ready, so that whatever
comes finds a gap that it fills. Documents come longest first, and no sequence is opened for
one that fits an open one while the open gaps have room for all that is still to come: on
the given documents the number of sequences is then the least possible or within a few of it.

Documents are tokenised where they are read; only one small row a piece is dealt out, by
its place among all pieces, into groups of at most about `GROUP` pieces that are packed
apart. A group wastes less than a sequence more than all pieces together would.

Only documents longer than a sequence are cut, into full pieces and a last one.

Tokenising: words of a text are told apart by white space at most, so each run of other
characters has ids of its own, whatever stands beside it. Runs are looked up in a bounded
table, and new ones that are a plain Latin word between plain punctuation marks are put
together from the ids of these; all others go through the tokenizer as they are.

Defined results: a null text is empty, its only id the closing one; repeated rows, and rows
whose key is null, are packed one by one; a text of any length is cut, never shortened; an
empty table gives an empty result; other columns are dropped unless `payload` names them.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprov.llm.common import map_columns, staged

CAPACITY, GROUP = 2048, 8192
#: The id that closes each document.
CLOSING = np.zeros(1, "<u4").tobytes()
#: Runs and words whose ids are remembered, and the longest run that is.
REMEMBERED, LONGEST = 300_000, 64
#: A run whose parts are words of their own: no digit, no apostrophe, no mark of a special token, no letter that changes its neighbours.
PLAIN = re.compile(r"([!-&(-/:;=-@\[-`{}~]*)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:;=-@\[-`{}~]*)")


class Remembered(dict):
    """Ids by run, worked out where a run is new; of long runs they are not kept."""

    def __init__(self, of: Callable[[bytes], bytes]):
        super().__init__()
        self.of = of

    def __missing__(self, run: bytes) -> bytes:
        ids = self.of(run)
        if len(run) <= LONGEST:
            self[run] = ids
        return ids


class Ids:
    """Ids of texts by a word-level BPE vocabulary, as `tokenizers` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            own = json.load(f)
        # The same vocabulary for what is a lower-case word already.
        self.word = Tokenizer.from_str(json.dumps(own | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}))
        self.runs = Remembered(self._run)
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words[word] = array("I", self.word.encode(word, add_special_tokens=False).ids).tobytes()
        return ids

    def _run(self, run: bytes) -> bytes:
        text = run.decode()
        m = PLAIN.fullmatch(text)
        if m is None:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        words, (before, word, behind) = self.words, m.groups()
        word = word.lower()
        ids = words.get(word) or self._word(word)
        if before:
            ids = (words.get(before) or self._word(before)) + ids
        return ids + (words.get(behind) or self._word(behind)) if behind else ids

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of a text and the closing id."""
        runs = self.runs
        ids = b"".join(map(runs.__getitem__, (text or "").encode().split()))
        if len(runs) > REMEMBERED:
            runs.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        return np.frombuffer(ids + CLOSING, "<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> Ids:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Ids(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = True, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) for each piece of each text."""
    columns = (key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)

    def cut(keys: list, texts: list) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {c: [] for c in columns}
        of = tokenizer(vocabulary)
        for k, t in zip(keys, texts, strict=True):
            ids = of(t)
            for no, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                row = (k, no, at, len(part), zlib.crc32(part.tobytes()), *[part.astype(np.int32)] * with_ids)
                for c, v in zip(columns, row, strict=True):
                    out[c].append(v)
            if len(out[key]) >= 4096:
                yield out
                out = {c: [] for c in columns}
        yield out

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs, [key, text], cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset in it) of each piece, none of which is longer than `capacity`."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, room, left = 0, 0, int(lengths.sum())
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # Half the change of the sum of squares where gap s, s + 1, ... takes the piece; a full sequence counts no more.
        own = count[s:]
        change = np.where(own > 0, count[: capacity + 1 - s] - own + 1.0, np.inf)
        change[0] = 0.5 - own[0] if own[0] else np.inf
        at = int(change.argmin())
        fresh = count[capacity - s] + 0.5 if s < capacity else 0.0
        if change[at] == np.inf or (fresh < change[at] and left > room):
            no, gap = used, capacity
            used += 1
            room += capacity
        else:
            gap = at + s
            no = open_[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = no, capacity - gap
        if gap > s:
            open_[gap - s].append(no)
            count[gap - s] += 1
        room -= s
        left -= s
    return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", payload: tuple[str, ...] = (), group_rows: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces; `payload` names further columns to carry."""
    keep = [key, "piece", "start", "length", *payload]
    rows = staged(rows.select(*keep))
    groups = max(1, math.ceil(rows.count() / group_rows))
    # By place among the staged rows: rows that are equal in all columns are dealt to different groups, too.
    dealt = rows.withColumn("place_no", F.monotonically_increasing_id()).withColumn("group_no", F.pmod(F.xxhash64("place_no"), F.lit(groups)).cast("long"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place_no")
        sequence, offset = assign(group["length"].to_numpy(), capacity)
        sequence = sequence + group["group_no"][0].as_py() * (1 << 32)
        return group.select(keep).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return dealt.groupBy("group_no").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = True, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], sequence_id, offset): the pieces of all texts, packed."""
    return pack(pieces(docs, capacity, with_ids, key, text, vocabulary), capacity, key, ("ids_crc32", *["ids"] * with_ids))
