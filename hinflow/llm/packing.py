"""Packing token sequences by vector bin packing (operator 7).

Each task tokenises its documents and packs them block by block. A sequence has
three limits at once: tokens, segments, and loss-bearing tokens. The
dot-product heuristic fills the open sequence: of the pieces that fit, it takes
the one whose demand vector has the largest dot product with what is left, each
dimension as a share of its limit. When nothing fits, the piece with the
largest product is cut to what is left. Documents longer than a sequence first
give full sequences. A block's last sequence stays open for the next block.

A sequence is closed before it is full when its segments or its loss-bearing
tokens run out, or when a task ends. With SEGMENTS = LIMIT / 2 and plain text
the first cannot leave padding but in one sequence a block: pieces of two
tokens or more fill LIMIT tokens in SEGMENTS segments, and one-token pieces
alone end at a power of two. Instruction data may have more padding: where
prompts are short and ``max_loss`` is low, loss-bearing tokens run out first.

There is no shuffle: a task streams over its part of the table and holds one
block (BLOCK documents or BLOCK_BYTES of ids) at a time. Sequence numbers carry
the task's number in their high bits; a task that runs again gives the same.

Tokens come from a tokenizers file; see Encoder.

Defined results: a null or empty text is the end token alone; repeated rows are
packed each for itself; an empty table gives an empty table; further columns
are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
SEGMENTS = LIMIT // 2
END = 1
BLOCK, BLOCK_BYTES = 1024, 32 << 20
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Texts to ids, as little-endian 32-bit words, by a tokenizers file.

    A byte-level BPE whose merges come in the order of their ids gives the same
    ids by rank. That is checked when the file is loaded, and such a file is
    encoded by rank, several times faster; any other file by its own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.encode = self._by_rank(json.loads(self.tokenizer.to_str()))

    def _by_rank(self, spec: dict) -> Callable[[str], list[int]] | None:
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or spec["normalizer"] or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("dropout"):
            return None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        if made != sorted(made) or -1 in made:
            return None
        import public_tokenizers
        import tiktoken

        # The usual one-character stand-ins for bytes: printable ones for themselves, the others from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in self.special}
        encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return encoding.encode_ordinary

    def one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.encode or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.encode(text)).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, which serves task after task."""
    return Encoder(path)


class Packer:
    """Places (key, ids, prompt) one block at a time; ``rows`` has (key, start, length, crc, total, sequence, offset)."""

    def __init__(self, limit: int, max_segments: int, max_loss: int, first: int):
        self.limits = np.array([limit, max_segments, max_loss], float)
        self.limit, self.fresh = limit, first
        self._open()
        self.rows: list[tuple] = []

    def _number(self) -> int:
        self.fresh += 1
        return self.fresh - 1

    def _open(self) -> None:
        self.left, self.at, self.sequence = self.limits.copy(), 0, self._number()

    def _row(self, key, ids: bytes, start: int, length: int, sequence: int, offset: int) -> None:
        self.rows.append((key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset))

    def _put(self, key, ids: bytes, prompt: int, start: int, length: int) -> None:
        self._row(key, ids, start, length, self.sequence, self.at)
        self.left -= (length, 1, bearing(prompt, start, length))
        self.at += length

    def block(self, items: list[tuple[object, bytes, int]]) -> None:
        starts = np.zeros(len(items), int)
        for i, (key, ids, prompt) in enumerate(items):
            while len(ids) // 4 - starts[i] >= self.limit and bearing(prompt, int(starts[i]), self.limit) <= self.limits[2]:
                self._row(key, ids, int(starts[i]), self.limit, self._number(), 0)
                starts[i] += self.limit
        need = np.array([(len(ids) // 4 - s, 1, bearing(prompt, s, len(ids) // 4 - s)) for (_, ids, prompt), s in zip(items, starts.tolist(), strict=True)], float).reshape(-1, 3)
        todo = need[:, 0] > 0
        while todo.any():
            if (self.left[:2] < 1).any() or self.left[2] <= 0:
                self._open()
                continue
            product = np.where(todo, (need / self.limits) @ (self.left / self.limits), -1.0)
            fitting = np.where((need <= self.left).all(axis=1), product, -1.0)
            i = int(fitting.argmax())
            key, ids, prompt = items[i]
            if fitting[i] >= 0:
                length = int(need[i, 0])
            else:
                i = int(product.argmax())
                key, ids, prompt = items[i]
                # What bears no loss fits anyway, then as many tokens as loss is left.
                free = max(prompt - int(starts[i]), 0)
                length = int(min(need[i, 0], self.left[0], free + self.left[2]))
            self._put(key, ids, prompt, int(starts[i]), length)
            starts[i] += length
            rest = len(ids) // 4 - int(starts[i])
            need[i] = rest, 1, bearing(prompt, int(starts[i]), rest)
            todo[i] = rest > 0


def bearing(prompt: int, start: int, length: int) -> int:
    """How many of ``length`` tokens from ``start`` bear loss: all behind the first ``prompt`` ones."""
    return max(start + length - max(start, prompt), 0)


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, limit: int = LIMIT,
    max_segments: int = SEGMENTS, max_loss: int = LIMIT, end: int = END,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a path that every executor can open. ``prompt_col`` holds
    the text that comes before the text and bears no loss; it is encoded by
    itself. Without a prompt all tokens bear loss but a document's first, which
    nothing precedes, so that with ``max_loss`` = ``limit`` only tokens and
    segments bind.
    """
    prompt = F.lit(None).cast("string") if prompt_col is None else F.col(prompt_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), prompt.alias("prompt"))
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(limit, max_segments, max_loss, TaskContext.get().partitionId() << 40)
        names = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

        def flush(held, kind):
            packer.block(held)
            done, packer.rows = packer.rows, []
            if done:
                columns = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        held: list[tuple[object, bytes, int]] = []
        size, kind = 0, pa.int64()
        for batch in batches:
            kind = batch.schema.field("id").type
            ids, texts, prompts = batch.column("id").to_pylist(), batch.column("text"), batch.column("prompt")
            for k in range(0, len(ids), 256):
                told = zip(ids[k : k + 256], encode(prompts[k : k + 256].to_pylist()), encode(texts[k : k + 256].to_pylist()), strict=True)
                for key, q, e in told:
                    held.append((key, q + e + stop, max(len(q) // 4, 1)))
                    size += len(q) + len(e)
                if len(held) >= BLOCK or size >= BLOCK_BYTES:
                    yield from flush(held, kind)
                    held, size = [], 0
        yield from flush(held, kind)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")
