"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary file (a parameter) gives byte-pair ranks. A pre-token starts as one symbol per byte in a linked list;
a heap holds the adjacent pairs by rank, the lowest rank (leftmost on ties) is popped again and again, stale entries
are skipped, and the count is the initial symbols minus the merges. No identifiers are made.

Special strings inside a text count one token each, as the tokenizer's own default has it. Counts of pre-tokens
are kept in a bounded table per Python worker.

Defined cases: null text counts as empty, with zero bytes and tokens.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Pre-tokens whose counts a worker keeps before it starts its table anew.
KEPT = 500_000
#: Fixed value: the byte-level pre-tokenizer's published pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Counter:
    """Counts the tokens of texts under the vocabulary in a tokenizer's JSON file."""

    def __init__(self, spec: dict):
        numbers = {letter: b for b, letter in enumerate(_byte_letters())}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        for a, b in merges:
            for symbol in (a, b, a + b):
                numbers.setdefault(symbol, len(numbers))
        self.width = len(numbers)
        #: Rank of a pair of symbols, and the symbol that the merge of each rank makes.
        self.ranks = {numbers[a] * self.width + numbers[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [numbers[a + b] for a, b in merges]
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.pattern, self.double = regex.compile(PATTERN), re.compile(r"\s ")
        self.kept: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols that are left of one pre-token."""
        symbols = list(piece.encode())  # the first 256 symbols are the bytes
        n = left = len(symbols)
        rank_of, width, made = self.ranks.get, self.width, self.made
        # The rank of the pair that starts at each symbol now, -1 for none; heap entries of other ranks are stale.
        now = [rank_of(a * width + b, -1) for a, b in zip(symbols, symbols[1:])]
        now.append(-1)
        heap = [rank * n + i for i, rank in enumerate(now) if rank >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            if now[i] != rank:
                continue
            j = after[i]
            symbols[i] = symbol = made[rank]
            left -= 1
            now[i] = now[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = rank = rank_of(symbol * width + symbols[k], -1)
                if rank >= 0:
                    heapq.heappush(heap, rank * n + i)
            p = before[i]
            if p >= 0:
                now[p] = rank = rank_of(symbols[p] * width + symbol, -1)
                if rank >= 0:
                    heapq.heappush(heap, rank * n + p)
        return left

    def _keep(self, piece: str, n: int) -> int:
        if len(piece) <= 64:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[piece] = n
        return n

    def _words(self, text: str) -> int:
        """Tokens of a text's pre-tokens."""
        pieces, kept = self.pattern.findall(text), self.kept
        if len(pieces) == 1:
            return self.merged(text)
        return sum(n if (n := kept.get(piece)) is not None else self._keep(piece, self.merged(piece)) for piece in pieces)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if self.double.search(text):
            return self._words(text)
        # Else a single space always starts a pre-token.
        first, *rest = text.split(" ")
        kept, total = self.kept, 0
        for piece in [first, *[f" {x}" for x in rest]]:
            n = kept.get(piece)
            total += n if n is not None else self._keep(piece, self._words(piece))
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    with open(path, encoding="utf-8") as f:
        return Counter(json.load(f))


def token_counts(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. ``path``: the vocabulary, on every executor."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        counter = load(path)
        return pa.array([counter.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    text = df[text_col].cast("string")
    rows = small_batches(df).select(df[id_col], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
