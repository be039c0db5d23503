"""Edit-aware token counts.

A document is cut into pre-tokens, whose BPE lengths don't depend on each other; a segment tree over
them keeps the token sum of every subtree. An edit (start, end, replacement, in code points) re-reads
only the pre-tokens it touches plus boundary context, replaces those leaves and updates the sums on their
paths. The re-read goes left by CONTEXT pre-tokens and right until a new boundary falls on an old one with
the same text from there on for CONTEXT pre-tokens, so the count always equals that of the whole new text.

Leaves are blocks of BLOCK pre-tokens, so a splice rewrites one small block and its ancestors, not a
document. Documents are independent: one Arrow pass, no shuffle, memory bounded by the longest text.

Null text has 0 tokens and takes no edit; empty text has 0. Edits are applied in the order given, each
in the coordinates of the text it meets; bounds are clipped to the text. Repeated rows count alike. The vocabulary is a
parameter, read on the driver and broadcast. Columns beyond doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession


BLOCK, CONTEXT = 64, 2
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def vocabulary_bytes(path: str, spark: SparkSession | None = None) -> bytes:
    """A vocabulary file, read on the driver: a local one, or with ``spark`` one in any store that Spark reads."""
    if spark is None or os.path.isfile(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_cut = regex.compile(PATTERN)


class Counter(dict):
    """Token counts of pre-tokens, remembered; the memory is emptied when it holds ``limit`` of them."""

    def __init__(self, vocabulary: bytes | None = None, limit: int = 400_000):
        self.encoding = encoder(vocabulary or vocabulary_bytes(VOCABULARY))
        self.limit = limit

    def __missing__(self, part: str) -> int:
        n = len(self.encoding.encode_ordinary(part))
        if len(self) >= self.limit:
            self.clear()
        if len(part) <= 64:
            self[part] = n
        return n

    def counts(self, parts: list[str]) -> list[int]:
        return list(map(self.__getitem__, parts))


@dataclass
class Tree:
    """Blocks of pre-tokens under a segment tree of (tokens, characters)."""

    text: str
    counter: Counter
    blocks: list[list[str]] = field(default_factory=list)
    sums: np.ndarray = None  # [2, 2 * width], node i over 2i and 2i + 1
    width: int = 1
    reread: int = 0  # pre-tokens encoded again by edits

    def __post_init__(self):
        parts = _cut.findall(self.text)
        self.blocks = [parts[i : i + BLOCK] for i in range(0, len(parts), BLOCK)] or [[]]
        counts = np.array(self.counter.counts(parts) or [0], np.int64)
        sizes = np.array(list(map(len, parts)) or [0], np.int64)
        at = np.arange(0, len(counts), BLOCK)
        self._plant(np.add.reduceat(counts, at), np.add.reduceat(sizes, at))

    def _plant(self, tokens: np.ndarray, chars: np.ndarray) -> None:
        self.width = 1 << max(0, (len(tokens) - 1)).bit_length()
        self.sums = np.zeros((2, 2 * self.width), np.int64)
        self.sums[0, self.width : self.width + len(tokens)] = tokens
        self.sums[1, self.width : self.width + len(chars)] = chars
        w = self.width
        while w > 1:
            self.sums[:, w // 2 : w] = self.sums[:, w : 2 * w : 2] + self.sums[:, w + 1 : 2 * w : 2]
            w //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[0, 1])

    def _find(self, char: int) -> tuple[int, int]:
        """Block that holds the character, and the characters before that block."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.sums[1, 2 * node])
            if char < before + left:
                node = 2 * node
            else:
                before, node = before + left, 2 * node + 1
        block = min(node - self.width, len(self.blocks) - 1)
        return block, before if block == node - self.width else int(self.sums[1, 1]) - int(self.sums[1, self.width + block])

    def _set(self, block: int, tokens: int, chars: int) -> None:
        node = self.width + block
        change = np.array([tokens, chars]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        size = len(self.text)
        start = min(max(0, start), size)
        end = min(max(start, end), size)
        first, begin = self._find(max(0, start - 1))
        last, last_begin = self._find(min(max(0, size - 1), end))
        # From CONTEXT pre-tokens before the edit ...
        inside, at = 0, begin
        bounds = [begin]
        for p in self.blocks[first]:
            at += len(p)
            bounds.append(at)
        inside = max(0, int(np.searchsorted(bounds, start, "left")) - 1 - CONTEXT)
        if inside == 0 and first > 0:  # ... which may stand in the block before
            first -= 1
            begin -= int(self.sums[1, self.width + first])
            bounds = list(begin + np.cumsum([0, *map(len, self.blocks[first])]))
            inside = max(0, len(bounds) - 1 - CONTEXT)
        origin = bounds[inside]
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # ... to where an old boundary beyond the edit is met and held for CONTEXT pre-tokens.
        old, at = [], last_begin
        block = last
        ends: dict[int, tuple[int, int]] = {}
        fresh, met, pos = [], 0, origin
        stop = None

        def old_bounds():
            nonlocal block, at
            if block >= len(self.blocks):
                return False
            for i, p in enumerate(self.blocks[block]):
                at += len(p)
                if at >= end:
                    ends[at + shift] = (block, i + 1)
            block += 1
            return True

        old_bounds()
        for m in _cut.finditer(self.text, origin):
            fresh.append(m.group())
            pos = m.end()
            while pos > at + shift and old_bounds():
                pass
            met = met + 1 if pos in ends and pos >= start + len(new) else 0
            if met > CONTEXT:
                stop = ends[pos]
                break
        del old
        self.reread += len(fresh)
        head = self.blocks[first][:inside]
        tail_block, tail_at = stop if stop else (len(self.blocks) - 1, len(self.blocks[-1]))
        merged = head + fresh + self.blocks[tail_block][tail_at:]
        touched = tail_block - first + 1
        pieces = [merged[i : i + BLOCK * 2] for i in range(0, len(merged), BLOCK * 2)] or [[]]
        if len(pieces) <= touched:
            pieces += [[] for _ in range(touched - len(pieces))]
            for i, p in enumerate(pieces):
                self.blocks[first + i] = p
                self._set(first + i, sum(self.counter.counts(p)), sum(map(len, p)))
        else:  # more blocks than leaves: plant anew from block sums
            loads = self.sums[:, self.width : self.width + len(self.blocks)]
            extra = np.array([[sum(self.counter.counts(p)) for p in pieces], [sum(map(len, p)) for p in pieces]], np.int64)
            loads = np.concatenate([loads[:, :first], extra, loads[:, tail_block + 1 :]], 1)
            self.blocks[first : tail_block + 1] = pieces
            self._plant(loads[0], loads[1])


def standard_edits(text: str, item: int) -> list[tuple[int, int, str]]:
    """Three deterministic edits that a cleaning step might make: a replacement, a deletion, an insertion."""
    n = len(text)
    a = (item * 7919) % (n + 1)
    b = (item * 104729 + 17) % (n + 1)
    c = (item * 1299709 + 5) % (n + 1)
    return [(a, a + 12, "[removed]"), (b, b + 40, ""), (c, c, " and it's 3 more\n")]


def _run(vocabulary, edits, check: bool):
    def run(batches):
        counter = Counter(vocabulary.value)
        for batch in batches:
            out = []
            for item, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text is None:
                    out.append((0, 0, 0, 0))
                    continue
                tree = Tree(text, counter)
                before, leaves = tree.tokens, sum(map(len, tree.blocks))
                for e in edits(text, item or 0):
                    tree.edit(*e)
                if check and tree.tokens != sum(counter.counts(_cut.findall(tree.text))):
                    raise ValueError(f"count of {item} went astray")
                out.append((before, tree.tokens, leaves, tree.reread))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(list(c), pa.int64()) for c in cols]], ["doc_id", "tokens", "edited_tokens", "pre_tokens", "reread"])

    return run


def count_report(docs: DataFrame, vocabulary: str = VOCABULARY, edits=standard_edits, check: bool = False) -> DataFrame:
    """doc_id, tokens, edited_tokens (after the edits), pre_tokens, reread (pre-tokens encoded again) for every document."""
    rows = docs.selectExpr("cast(doc_id as long) AS doc_id", "text")
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary, spark))  # under a megabyte; executors need no file of their own
    return rows.mapInArrow(_run(shipped, edits, check), "doc_id long, tokens long, edited_tokens long, pre_tokens long, reread long")
