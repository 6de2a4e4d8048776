"""Packing token streams into sequences of a fixed length by best-fit decreasing.

Documents are tokenised and packed where they are read: a task turns its documents into pieces (full
windows of an overlong document, and one rest per document) and places the rests of about
``group_tokens`` tokens at a time, longest first, each into the open sequence with the least room that
still holds it. A segment tree over the remaining capacity finds that sequence in log2(length) steps.
A group's memory is bounded by ``group_tokens`` and the longest document; nothing is shuffled.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from contactloom.llm.common import batches_by_size, short_batches

#: sequence numbers that one task can use
TASK_SPAN = 1 << 40


class OpenSequences:
    """Open sequences by remaining capacity: a segment tree whose leaves count those with that much room."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.waiting: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, sequence: int, room: int) -> None:
        if room:
            self.waiting[room].append(sequence)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``need`` and that room; None if there is none."""
        node, count = need + self.size, self.count
        if not count[node]:
            # climb until a right sibling holds something, then descend to its leftmost leaf
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.waiting[room].pop(), room


def best_fit_decreasing(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """(sequence, offset) of every piece; pieces of equal length keep their order."""
    tree, placed, sequences = OpenSequences(length), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = (sequences, length)
            sequences += 1
        sequence, room = found
        placed[i] = (sequence, length - room)
        tree.put(sequence, room - lengths[i])
    return placed


#: texts with a longer run without white space go to the library that merges in less than quadratic time
LONG_RUN = 1000


def encoder(vocabulary: str, ranks: tuple[str, str] | None):
    """A function from a list of texts to their ids, those that ``tokenizers`` gives for ``vocabulary``.

    ``ranks`` (a file with the same vocabulary as ranks, and its split pattern) lets a faster library encode
    texts of Latin-1 characters, whose classes no version of either library disputes; the others, and those that spell out
    an added token of the vocabulary (it becomes that token's id), are left to ``tokenizers``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded: list = []

    def slow(texts: list[str]) -> list[list[int]]:
        if not texts:
            return []
        if not loaded:  # a task that meets no such text does without
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(vocabulary))
        return [e.ids for e in loaded[0].encode_batch_fast(texts, add_special_tokens=False)]

    if ranks is None:
        return slow
    import tiktoken

    path, pattern = ranks
    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens") or []]
    quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def simple(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        if any(token in text for token in added):
            return False
        return max(map(len, text.split()), default=0) <= LONG_RUN

    def both(texts: list[str]) -> list[list[int]]:
        out: list = [quick.encode_ordinary(t) if simple(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, slow([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    return both


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0, group_tokens: int = 1 << 21, id_column: str = "doc_id", text_column: str = "text", ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers, ``start`` how many ids of
    its document come before it, ``doc_tokens`` the document's ids with the closing ``end_id``. Pieces of a
    sequence follow each other without gaps from offset 0. A null or empty text is the closing id alone; a
    null id stays null; repeated rows are separate documents; other columns are ignored.
    ``vocabulary`` is a file of the ``tokenizers`` library that every executor can read; for ``ranks`` see
    ``encoder``.
    """
    short_batches(docs.sparkSession)
    if not 1 <= length < 1 << 20:
        raise ValueError("length must lie between 1 and 2**20")

    def run(frames):
        encode = encoder(vocabulary, ranks)
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) * TASK_SPAN
        end = np.array([end_id], dtype="<u4")
        rests: list[tuple] = []
        full: list[tuple] = []
        waiting = 0

        def placed():
            nonlocal next_id, rests, full, waiting
            out = [(*piece, next_id + i, 0) for i, piece in enumerate(full)]
            next_id += len(full)
            places = best_fit_decreasing([len(r[2]) // 4 for r in rests], length)
            out += [(*piece, next_id + s, o) for piece, (s, o) in zip(rests, places, strict=True)]
            next_id += max((s + 1 for s, _ in places), default=0)
            rests, full, waiting = [], [], 0
            columns = list(zip(*out, strict=True))
            return pd.DataFrame(
                {
                    "doc_id": pd.array(columns[0], dtype="Int64"),
                    "start": columns[1],
                    "length": [len(x) // 4 for x in columns[2]],
                    "ids": columns[2],
                    "doc_tokens": columns[3],
                    "sequence_id": columns[4],
                    "offset": columns[5],
                }
            )

        for frame in batches_by_size(frames, text_column, 1 << 20):
            texts = ["" if x is None or x != x else x for x in frame[text_column]]
            for doc, encoded in zip(frame[id_column], encode(texts), strict=True):
                ids = np.concatenate([np.array(encoded, dtype="<u4"), end])
                doc = None if doc is None or doc != doc else int(doc)
                for start in range(0, len(ids), length):
                    piece = (doc, start, ids[start : start + length].tobytes(), len(ids))
                    (full if len(piece[2]) == 4 * length else rests).append(piece)
                waiting += len(ids)
                if waiting >= group_tokens:
                    yield placed()
        if rests or full:
            yield placed()

    return docs.select(id_column, text_column).mapInPandas(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
