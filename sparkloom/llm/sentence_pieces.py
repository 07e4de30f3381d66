"""SentencePiece encoding and decoding by a table of each prefix's last token.

A merge-type (BPE) vocabulary gives every prefix of a text one encoding, and with it one last token: what merging does inside a
prefix does not depend on what follows, as long as no merge crosses the prefix's end. Two neighbouring tokens stand in an encoding
if and only if merging their joined string leaves just these two (the pair is compatible): the first merge that crossed them in a
longer text would be made in the pair too. So the last token of the prefix that ends at i is the one automaton match ``t`` that ends
there for which (last token of the prefix before ``t``, ``t``) is compatible. The table needs one pass over the text; the ids are
read from its end backwards.

Pieces that merging never makes are left out of the automaton. A character that is no piece is a token of its own and becomes
the ids of its UTF-8 bytes. Tests of pairs are kept in a bounded table for each worker, and so are the ids of stretches between two
characters that no piece holds side by side (in practice, words with the spaces before them), as no token reaches over such a place.

Only models without normalisation rules, user-defined or unused pieces are taken (``ValueError`` else): for these, spaces
become U+2581, one more is put first, and nothing else changes. Decoding drops that one again; bytes that are no UTF-8 become
U+FFFD each, control ids nothing, and the unknown id " ⁇ ".

Defined cases: null text or ids count as empty; an empty text has no ids; no begin or end ids are added.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
#: A token from here on is a character that is no piece.
STRANGE = 1 << 24
#: Stretches and pairs that a worker keeps before it starts its table anew, and the longest stretch that is kept.
KEPT, KEPT_PAIRS, KEPT_LENGTH = 250_000, 1_000_000, 64
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """The pieces and scores of a model file, with encoding and decoding of single texts."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        rules, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != 2 or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("only merge-type models with byte fallback and without user-defined or unused pieces")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("only models without normalisation rules, with a space put first")
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        #: What each id gives when decoded; None for bytes.
        self.shown: list[str | None] = []
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
            self.shown.append({NORMAL: p.piece.replace(SPACE, " "), UNKNOWN: " ⁇ ", BYTE: None}.get(p.type, ""))
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.names, self.sizes = [p.piece for p in spec.pieces], [len(p.piece) for p in spec.pieces]
        self.bytes_of = [np.int32(i).tobytes() for i in range(len(self.names))]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.beside = {a + b for piece in self.ids for a, b in pairwise(piece)}
        self.cuts = all(pair[1] != SPACE or pair[0] == SPACE for pair in self.beside)
        self.compatible: dict[int, bool] = {}
        #: Ids of a stretch, as bytes, by its characters after the first space; the last KEPT ones, and KEPT before.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}  # of single characters

    def merge(self, text: str) -> list[str]:
        """The tokens of a short string by merging: the pair of highest score first, the leftmost of equal ones."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                s = score(a + b)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _name(self, token: int) -> str:
        return self.names[token] if token < STRANGE else chr(token - STRANGE)

    def fits(self, before: int, token: int) -> bool:
        """Whether the two may stand side by side in an encoding."""
        if len(self.compatible) >= KEPT_PAIRS:
            self.compatible.clear()
        pair = [self._name(before), self.names[token]]
        found = self.compatible[before << 32 | token] = self.merge("".join(pair)) == pair
        return found

    def tokens(self, text: str) -> list[int]:
        """The tokens of a text of any length, in order; a character that is no piece is STRANGE and its number."""
        #: The last token of the prefix before each place.
        last = [-1] * (len(text) + 1)
        done, sizes, known = 0, self.sizes, self.compatible.get  # places up to ``done`` have their token
        for end, token in self.automaton.iter(text):
            if end < done:
                continue
            while done < end:  # characters that are no piece
                last[done + 1] = STRANGE + ord(text[done])
                done += 1
            before = last[end + 1 - sizes[token]]
            if before >= 0:
                fit = known(before << 32 | token)
                if fit is None:
                    fit = self.fits(before, token)
                if not fit:
                    continue
            done = end + 1
            last[done] = token
        for at in range(done, len(text)):
            last[at + 1] = STRANGE + ord(text[at])
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token] if token < STRANGE else 1
        out.reverse()
        return out

    def _stretch(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None and 1 < len(key) <= KEPT_LENGTH and key[-2:] not in self.beside and key[-2] != " " != key[-1]:
            # The last character (a comma, as a rule) stands apart from what is before it. Longer stretches, which are not kept, are read in one pass.
            tail = self.tails.get(key[-1])
            if tail is None:
                tail = self.tails[key[-1]] = self._bytes(key[-1])
            return (self.kept.get(key[:-1]) or self._stretch(key[:-1])) + tail
        if found is None:
            found = self._bytes(SPACE + key.replace(" ", SPACE))
        if len(key) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept, self.older = {}, self.kept
            self.kept[key] = found
        return found

    def _bytes(self, text: str) -> bytes:
        return b"".join([self.bytes_of[t] if t < STRANGE else self._strange(t) for t in self.tokens(text)])

    def _strange(self, token: int) -> bytes:
        return b"".join(self.bytes_of[self.byte_ids[b]] for b in chr(token - STRANGE).encode())

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.cuts:
            return self._stretch(text)
        if "  " in text or text[0] == " " or text[-1] == " ":
            keys = [stretch[1:] for stretch in _STRETCH.findall(" " + text)]
        else:
            keys = text.split(" ")
        kept = self.kept.get
        return b"".join([kept(key) or self._stretch(key) for key in keys])

    def decode(self, ids: list[int]) -> str:
        shown = self.shown
        try:
            text = "".join([shown[i] for i in ids])
        except TypeError:
            text = self._with_bytes(ids)
        first = next((shown[i] for i in ids if shown[i] != ""), None)
        return text[1:] if first and first[0] == " " and first != " ⁇ " else text

    def _with_bytes(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                # One sign for each byte that is no part of a character.
                out.append(run.decode(errors="surrogateescape"))
                run.clear()
            if i is not None:
                out.append(self.shown[i])
        return _LONE.sub("\ufffd", "".join(out))


_STRETCH = re.compile(" *[^ ]+| +")
_LONE = re.compile("[\udc80-\udcff]")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def encoded(text: Column, path: str) -> Column:
    """Ids of a text column (array<int>, empty for null); ``path``: the model file, on every executor."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        pieces = load(path)
        found = [pieces.encode(text) if text else b"" for text in texts.to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found], dtype=np.int64)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))

    return ids(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """The text of an id column (empty for null)."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        pieces, flat = load(path), lists.flatten().to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
        return pa.array([pieces.decode(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.string())

    return text(ids)


def encode_and_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``ids`` and ``decoded``, the text that these ids give."""
    rows = small_batches(df).select(df[id_col], encoded(df[text_col], path).alias("ids"))
    return rows.withColumn("decoded", decoded(rows["ids"], path))
