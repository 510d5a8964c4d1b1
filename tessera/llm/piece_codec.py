"""SentencePiece encoding and decoding by a prefix table.

For a merge-type (BPE) model the encoding of a text is the only token sequence whose adjacent pairs all re-encode to
themselves. So every prefix has one last token: among the vocabulary pieces that end at its end (found by an Aho-Corasick
automaton), the one that is compatible with the last token of the prefix before it. The table of these last tokens is filled
from left to right; the ids are read off backwards. Cost is linear in the text, whatever its length.

Texts are cut where no piece can reach across (before a run of the space mark, around line ends, between a word of letters and
one of MARKS), so units repeat and bounded memos hold their ids and spellings. Cases: null and empty texts give no ids and an empty text; characters outside the vocabulary
become their UTF-8 byte pieces; repeated rows are encoded alike; an empty table gives an empty result; other columns of the input are kept as they are, but
columns named like an output, whatever their case, give way to it.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CACHES, bound_batches, without, worker

SPACE = "▁"
#: Marks before which a unit may end after a letter, where the vocabulary allows it.
MARKS = ".,;:!?%&)"
#: Units longer than this aren't memoised; units of each of a memo's two ages; verdicts on pairs that are kept.
MEMO_UNIT, MEMO_SIZE, PAIRS = 48, 200_000, 500_000


class Memo(dict):
    """What make() gives for a unit, kept in two ages: a full young age becomes the old one, and what was not asked for in between goes."""

    __slots__ = ("make", "old")

    def __init__(self, make: Callable[[str], Any]):
        self.make, self.old = make, {}

    def __missing__(self, unit: str) -> Any:
        made = self.old.get(unit)
        if made is None:
            made = self.make(unit)
        if len(unit) <= MEMO_UNIT:
            if len(self) >= MEMO_SIZE:
                self.old = dict(self)
                self.clear()
            self[unit] = made
        return made


class State(dict):
    """A state of the automaton: its moves by character, the state to fall back on, and the pieces that end here, longest first.

    Moves that fall back are added when they are first asked for, unless they lead to the root."""

    __slots__ = ("back", "ends")

    def __missing__(self, char: str) -> State:
        if self.back is None:
            return self
        to = self.back[char]
        if to.back is not None:
            self[char] = to
        return to


def automaton(pieces: Iterable[str]) -> State:
    """The Aho-Corasick automaton of the pieces; ends holds (length, piece, verdicts on the tokens before it)."""
    root = State()
    root.back, root.ends = None, ()
    for piece in pieces:
        state = root
        for char in piece:
            if char not in state:
                state[char] = made = State()
                made.back, made.ends = root, ()
            state = state[char]
        state.ends = ((len(piece), piece, {}),)
    level = list(root.values())
    while level:
        below = []
        for state in level:
            for char, to in list(state.items()):
                to.back = state.back[char]
                below.append(to)
            state.ends += state.back.ends
        level = below
    return root


class PieceCodec:
    """Encoder and decoder of one SentencePiece model of the merge type with identity normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with identity normalisation are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.surface = [b"" if p.type == kinds.CONTROL else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.surface[self.unknown] = (model.trainer_spec.unk_surface or " ⁇ ").encode()
        for i, b in self.byte_of.items():
            self.surface[i] = bytes([b])
        self.root = automaton(self.ids)
        long = [p for p in self.ids if len(p) > 1]
        apart = not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in long)
        marks = "".join(m for m in MARKS if not any(re.search(rf"[^\W\d_]{re.escape(m)}", p) for p in long))
        words = rf"{SPACE}*[^\W\d_]++(?=[{re.escape(marks)}])|" if marks else ""
        #: Units that no piece crosses; the whole text where the vocabulary does not allow that.
        self.units = re.compile(f"{words}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if apart else r"(?s).+").findall
        self.n_pairs = 0
        self.memo, self.spelled = Memo(self.unit_ids), Memo(self.spelling)
        self.written = {p: str(i) for p, i in self.ids.items()}
        self.shown = {p: self.surface[i] for p, i in self.ids.items()}

    def merged(self, text: str) -> list[str]:
        """Merges of a short string in the order of the model: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str, verdicts: dict[str, bool]) -> bool:
        """Whether the two tokens, side by side, stay as they are ("" for the start); verdicts are those known on the right one."""
        if self.n_pairs >= PAIRS:
            self._forget()
        self.n_pairs += 1
        verdicts[left] = fits = self.merged(left + right) == ([left, right] if left else [right])
        return fits

    def _forget(self) -> None:
        """Empties the verdicts on all pairs."""
        level = [self.root]
        self.n_pairs = 0
        seen = {id(self.root)}
        while level:
            state = level.pop()
            for _, _, verdicts in state.ends:
                verdicts.clear()
            for to in state.values():
                if id(to) not in seen:
                    seen.add(id(to))
                    level.append(to)

    def tokens(self, unit: str) -> list[str]:
        """The sequence read backwards off the table of the last tokens of prefixes; where no piece fits, a prefix ends with its last character.

        An entry is filled when it is asked for: by the table read backwards, or as the token before a match."""
        state, ends = self.root, [()]
        for char in unit:
            state = state[char]
            ends.append(state.ends)
        last: list[str | None] = [None] * len(ends)
        last[0] = ""
        if len(unit) > MEMO_UNIT:  # in order, so that no entry waits for a long chain of others
            for end in range(1, len(ends)):
                self._fill(end, unit, ends, last)
        out, n, fill = [], len(unit), self._fill
        while n:
            token = last[n] or fill(n, unit, ends, last)
            out.append(token)
            n -= len(token)
        out.reverse()
        return out

    def _fill(self, end: int, unit: str, ends: list[tuple], last: list[str | None]) -> str:
        """The last token of the prefix of this length: among the pieces that end there, the one compatible with the last token of the prefix before it."""
        for n, piece, verdicts in ends[end]:
            before = last[end - n]
            if before is None:
                before = self._fill(end - n, unit, ends, last)
            try:
                fits = verdicts[before]
            except KeyError:
                fits = self.compatible(before, piece, verdicts)
            if fits:
                last[end] = piece
                return piece
        last[end] = unit[end - 1]
        return last[end]

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        """The ids of a unit."""
        out: list[int] = []
        for token in self.tokens(unit):
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in token.encode())
            else:
                out.append(self.unknown)
        return tuple(out)

    def spelling(self, unit: str) -> tuple[str, bytes]:
        """A unit's ids, written with commas, and the surfaces of these ids."""
        tokens = self.tokens(unit)
        try:
            return ",".join(map(self.written.__getitem__, tokens)), b"".join(map(self.shown.__getitem__, tokens))
        except KeyError:
            ids = self.unit_ids(unit)
            return ",".join(map(str, ids)), self.surfaces(ids)

    def cut(self, text: str) -> list[str]:
        """The units of a text that isn't empty."""
        text = text.replace(" ", SPACE)
        return self.units(SPACE + text if self.dummy else text)

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, without begin or end ids."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.memo.__getitem__, self.cut(text))))

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """What encode() and then decode() of its ids give, put together from the spellings of the units: number of ids, ids with commas, decoded text."""
        if not text:
            return 0, "", ""
        ids, raw = zip(*map(self.spelled.__getitem__, self.cut(text)), strict=True)
        ids = ",".join(ids)
        try:
            decoded = self._opened(b"".join(raw).decode(), int(ids[: ids.find(",")] if "," in ids else ids))
        except UnicodeDecodeError:
            decoded = self.decode(map(int, ids.split(",")))
        return ids.count(",") + 1, ids, decoded

    def surfaces(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))

    def _opened(self, text: str, first: int) -> str:
        """Without the leading space mark, unless it is no part of a piece."""
        return text[1:] if self.dummy and text.startswith(" ") and first not in self.byte_of and first != self.unknown else text

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: surfaces joined, byte pieces as UTF-8 (each invalid byte becomes U+FFFD), the leading space mark dropped."""
        ids = list(ids)
        try:
            text = self.surfaces(ids).decode()
        except UnicodeDecodeError:
            text = self._decode_bytes(ids)
        return self._opened(text, next((i for i in ids if self.surface[i]), self.unknown))

    def _decode_bytes(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            at = 0
            while at < len(run):
                size = 1 if run[at] < 0x80 else 2 if run[at] >> 5 == 6 else 3 if run[at] >> 4 == 14 else 4 if run[at] >> 3 == 30 else 0
                try:
                    out.append(bytes(run[at : at + size]).decode() if size and at + size <= len(run) else "�")
                    at += size if out[-1] != "�" or size == 3 and run[at : at + 3] == b"\xef\xbf\xbd" else 1
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            run.clear()
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec for each model and Python worker; the collector of cycles need not look at its tables again and again."""
    made = PieceCodec(model_file)
    gc.freeze()
    return made


CACHES["codec"] = codec


def _with(df: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """The frame with further columns, made from batches by make(batch) -> arrays; columns of these names, whatever their case, give way."""
    kept = without(df, *(f.name for f in fields))
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = make(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, *(f.name for f in fields)])

    bound_batches(df.sparkSession)
    return df.mapInArrow(worker(run, "codec"), schema)


def encode(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids (array of int) of a text column."""
    return _with(df, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], lambda b: [pa.array([codec(model_file).encode(t) for t in b.column(text_col).to_pylist()], pa.list_(pa.int32()))])


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of an ids column; null ids give an empty text."""
    return _with(df, [T.StructField(text_col, T.StringType())], lambda b: [pa.array([codec(model_file).decode(x or []) for x in b.column(ids_col).to_pylist()], pa.string())])


def round_trip_digests(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: what encode() and then decode() give, digested batch by batch so that ids never leave the worker."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(model_file)
        rows = []
        for text in batch.column(text_col):
            n, ids, decoded = own.round_trip(text.as_py())
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        counts, of_ids, of_texts = list(zip(*rows, strict=True)) or [()] * 3
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]

    return _with(df, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], make)
