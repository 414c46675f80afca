"""Operator 6: SentencePiece encoding and decoding over a merge-type prefix table.

Merge-based vocabularies have this property: a sequence of tokens is the encoding of its text exactly if each
neighbouring pair is the encoding of the pair's own text. So every prefix of a text has one encoding, and the encoding
of the whole text ends, at each of its own cuts, with the last token of the prefix's encoding. The encoder therefore
keeps for each prefix only that last token: an Aho-Corasick automaton names the tokens that end at a position, longest
first, and the one that is compatible with the last token of the prefix before it is kept. Ids are recovered backwards.

No piece holds a space mark behind another character, so a text falls into independent runs "spaces + word"; runs are
memoised per worker, in a table with a fixed number of entries. Characters that occur in no piece become byte pieces.

Other models are refused: of another type than BPE, or with a piece that holds a newline among other characters or a
space mark behind another character.

Nulls and empty texts give no ids and an empty decoded text; repeated rows give repeated rows, equal texts equal ids;
null ids are kept; columns other than the id and the text are not read, whatever their names. Empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, positional, slabs, texts_of

SPACE = "▁"
#: Entries of the memo tables of one worker; they are emptied when full.
MEMO_RUNS, MEMO_PAIRS = 250_000, 400_000


#: Fields of a model file: of the model, its training parameters; of these, the type of the model, and that of BPE.
TRAINER, MODEL_TYPE, BPE = 2, 3, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in wire format: integers, and bytes of all other kinds."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at : at + size]
            at += size


def model_type(model: bytes) -> int:
    """The type that a model file names; 1 if it names none."""
    trainer = b"".join(v for k, v in _fields(model) if k == TRAINER and isinstance(v, bytes))
    return max((v for k, v in _fields(trainer) if k == MODEL_TYPE and isinstance(v, int)), default=1)


class PrefixTable:
    """Encoder and decoder for the pieces of one merge-type model."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        if model_type(model) != BPE:
            raise ValueError("the prefix table needs a model of type BPE")
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)  # reads the vocabulary only
        self.score: list[float] = []
        self.text: list[str] = []
        self.raw: list[bytes] = []
        self.pieces: dict[str, int] = {}
        self.bytes_at: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            self.text.append(piece)
            self.score.append(lib.get_score(i))
            if lib.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i):
                self.raw.append(b"")
            elif lib.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.pieces[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        odd = [p for p in self.pieces if len(p) > 1 and "\n" in p or SPACE in p.lstrip(SPACE)]
        if odd:
            raise ValueError(f"texts can't be cut into runs, as these pieces cross runs: {odd[:5]}")
        self.known = set("".join(self.pieces))
        self.size = len(self.text)
        for c in sorted(self.known - self.pieces.keys()):  # they occur inside pieces only: merged, or else given as bytes
            self.pieces[c] = len(self.text)
            self.text.append(c)
            self.score.append(float("-inf"))
        self.runs: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        for piece, i in self.pieces.items():
            ids, steps = self._history(piece)
            if ids == [i]:
                self.steps[i] = steps
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.sizes = [len(x) for x in self.text]
        self.lengths = np.array([len(r) for r in self.raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.raw), np.uint8)
        self.spaced = np.array([p.startswith(SPACE) for p in self.text[: self.size]])
        odd = "".join(sorted(re.escape(c) for c in self.known - {SPACE, " "}))
        self.cut = re.compile(" +[^ \n]*|[^ \n]+|\n")
        self.strange = re.compile(f"[^{odd}{SPACE}]")

    def _history(self, text: str) -> tuple[list[int], list[tuple[float, str, str]]]:
        """Definition of the encoding: join the best-scored neighbouring pair, the leftmost of equals, until none is left.

        Returns the ids, and before each join and at the end: the next join's score, the first and the last part.
        """
        parts, steps = list(text), []
        while True:
            best, at = float("-inf"), -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and self.score[i] > best:
                    best, at = self.score[i], k
            steps.append((best, parts[0], parts[-1]))
            if at < 0:
                return [self.pieces[p] for p in parts], steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a's and b's own joins, run together by score, never make a join across their border better."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        left, right, pieces, score = self.steps[a], self.steps[b], self.pieces, self.score
        i, j, m, n, found = 0, 0, len(left) - 1, len(right) - 1, True
        while True:
            (next_a, _, tail), (next_b, head, _) = left[i], right[j]
            across = pieces.get(tail + head)
            if across is not None and score[across] > next_a and score[across] >= next_b:
                found = False
                break
            if i == m and j == n:
                break
            if j == n or i < m and next_a >= next_b:
                i += 1
            else:
                j += 1
        self.pairs[a << 20 | b] = found
        return found

    def _table(self, text: str) -> list[int]:
        """text: characters that occur in pieces."""
        last, known, size = [-1] * (len(text) + 1), self.pairs.get, self.sizes
        for end, i in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                n = size[i]
                if end == n:
                    last[end] = i
                else:
                    ok = known(last[end - n] << 20 | i)
                    if ok or ok is None and self._compatible(last[end - n], i):
                        last[end] = i
        out, at = [], len(text)
        while at:
            i = last[at]
            out.append(i)
            at -= size[i]
        out.reverse()
        return out

    def _fallback(self, i: int) -> list[int]:
        return [i] if i < self.size else [self.bytes_at[b] for b in self.text[i].encode()]

    def _run(self, run: str) -> bytes:
        text, ids, at = run.replace(" ", SPACE), [], 0
        for m in self.strange.finditer(text):
            if at < m.start():
                ids += self._table(text[at : m.start()])
            ids += [self.bytes_at[b] for b in m[0].encode()]
            at = m.end()
        if at < len(text):
            ids += self._table(text[at:])
        if max(ids, default=0) >= self.size:
            ids = [x for i in ids for x in self._fallback(i)]
        out = struct.pack(f"<{len(ids)}i", *ids)
        if len(run) <= 64:
            if len(self.runs) >= MEMO_RUNS:
                self.runs.clear()
            self.runs[run] = out
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        get, run = self.runs.get, self._run
        return b"".join([get(x) or run(x) for x in self.cut.findall(" " + text.replace(SPACE, " "))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode_many(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the id sequences that end at ends in flat; bytes that are no UTF-8 become U+FFFD."""
        lengths, starts = self.lengths[flat], self.starts[flat]
        first = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
        first = first[self.spaced[flat[first]]]  # the space that encoding puts before a text
        lengths[first] -= 1
        starts[first] += 1
        after = np.cumsum(lengths)
        raw = self.blob[np.repeat(starts - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)].tobytes()
        cuts = np.concatenate([[0], after])[np.concatenate([[0], ends])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids) -> str:
        return self.decode_many(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


_tables: dict[str, PrefixTable] = {}


def table_for(model: bytes) -> PrefixTable:
    """One table for each worker and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _tables:
        _tables[key] = PrefixTable(model)
    return _tables[key]


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row of docs. model: the model file's bytes (about 0.5 MB)."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table_for(model)
        for batch in slabs(batches):
            parts = [t.encode_bytes(x) for x in texts_of(batch)]
            flat = np.frombuffer(b"".join(parts), "<i4")
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            decoded = t.decode_many(flat, ends[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids, pa.array(decoded, pa.string())], schema=out)

    at = positional(docs)
    return at.select(F.col(column(docs, id_col)).cast("long").alias("doc_id"), F.col(column(docs, text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256, decoded_sha256 of what encode_decode returns."""
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id and the digests of what encode_decode returns."""
    return encoded.select("doc_id", *digest_columns())
