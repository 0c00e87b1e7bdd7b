"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has an edge for every piece of the vocabulary, and for every
character that is none, an edge of its byte pieces. A BPE model admits a path only if
each two neighbouring pieces are what encoding their joined text gives, so the
Viterbi recursion is over admissible edges: one backpointer survives per position.
A later piece can only start within the last `longest` positions. When the
backpointer paths of all of these meet at one boundary, everything before it is
committed and forgotten, so a text without blanks needs no more memory than the
window. No piece has an inner blank or contains a barrier character such as a
newline; there all paths meet, so the stretches between are searched on their own
and, if short, remembered.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.llm.common import kept, map_arrow, text_of
from seqbraid.llm.prefix_bpe import Memo, PairDP

BLANK = "▁"
MEMO_CHARS = 64
MEMO_ENTRIES = 400_000
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


class PieceModel:
    """Encoder and decoder of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("the model must have no normalisation other than a dummy prefix")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.vocab = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.byte_ids = {
            int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE
        }
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        joined = [p for p in self.vocab if len(p) > 1]
        if any(c not in self.vocab for p in joined for c in p):
            raise ValueError("a character of a longer piece is no piece itself")
        if any(BLANK in p.lstrip(BLANK) for p in joined):
            raise ValueError("a piece has an inner blank")
        self.barrier_newline = not any("\n" in p for p in joined)
        self._stretch = re.compile(
            f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+" if self.barrier_newline else f"{BLANK}*[^{BLANK}]+|{BLANK}+"
        )
        self._dp = PairDP(self.vocab, self._stable)
        self.longest = self._dp.longest
        self._memo = Memo(MEMO_ENTRIES)
        self._whole: dict[str, bool] = {}  # whether a piece is what encoding its text gives
        self._text_of = [
            "" if k not in (_NORMAL, _BYTE) else p for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        self._low = min(self.byte_of)
        self._high = max(self.byte_of)

    def _stable(self, *pieces: str) -> bool:
        """Whether merging the characters of the pieces, best score first, gives these pieces."""
        parts = list("".join(pieces))
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts == list(pieces)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stream(self, symbols: Iterable[str]) -> Iterator[list[int]]:
        """Committed ids of a symbol stream, in order; keeps only the undecided window."""
        vocab, valid, longest = self.vocab, self._dp.valid, self.longest
        held = ""  # symbols from the last committed boundary on
        last: list[str | None] = [""]  # last piece of the path to every held position
        checked = 0
        for symbol in symbols:
            held += symbol
            i = len(held)
            if symbol not in vocab:
                last.append(None)  # byte pieces: every path passes here
                yield self._path(held, last, i)
                held, last, checked = "", [""], 0
                continue
            for start in range(i - 1, max(-1, i - longest - 1), -1):
                piece = held[start:i]
                if piece in vocab and (start == 0 or valid(last[start], piece)):
                    last.append(piece)
                    break
            else:
                raise ValueError("no admissible path")
            # While nothing is committed the first position has no left neighbour to check,
            # so after a commit the committed piece stays as the left context.
            if i - checked >= 2 * longest:
                checked = i
                meet = self._meeting(last, i)
                if meet > 1:
                    keep = meet - len(last[meet])
                    if keep > 0:
                        yield self._path(held, last, keep)
                        held, last = held[keep:], [""] + last[keep + 1 :]
                        checked -= keep
        if held:
            yield self._path(held, last, len(held))

    def _meeting(self, last: list[str | None], i: int) -> int:
        """The latest boundary on the paths of all positions where a later piece may start."""
        open_ends = set(range(max(0, i - self.longest + 1), i + 1))
        while len(open_ends) > 1:
            top = max(open_ends)
            open_ends.discard(top)
            open_ends.add(top - len(last[top]))
        return open_ends.pop()

    def _path(self, held: str, last: list[str | None], end: int) -> list[int]:
        ids: list[int] = []
        while end > 0:
            piece = last[end]
            if piece is None:
                data = held[end - 1].encode("utf-8", "surrogatepass")
                ids += [self.byte_ids[b] for b in reversed(data)]
                end -= 1
            else:
                ids.append(self.vocab[piece])
                end -= len(piece)
        ids.reverse()
        return ids

    def _short(self, stretch: str) -> list[int] | None:
        """The ids of a stretch too short for a commit; None if a character is no piece.

        The recursion of `stream`. The admissible edge into a boundary is unique, so a prefix
        that is what its own encoding gives needs no other edge looked at.
        """
        vocab, known, whole, longest = self.vocab, self._dp._known, self._whole, self.longest
        last = [""]
        add = last.append
        for i in range(1, len(stretch) + 1):
            if i <= longest:
                piece = stretch[:i]
                if piece in vocab:
                    good = whole.get(piece)
                    if good is None:
                        good = whole[piece] = self._stable(piece)
                    if good:
                        add(piece)
                        continue
            for start in range(i - 1, max(-1, i - longest - 1), -1):
                piece = stretch[start:i]
                if piece in vocab:
                    if start:
                        pair = (last[start], piece)
                        good = known.get(pair)
                        if good is None:
                            good = self._dp.valid(*pair)
                        if not good:
                            continue
                    add(piece)
                    break
            else:
                return None
        ids, end = [], len(stretch)
        while end:
            ids.append(vocab[last[end]])
            end -= len(last[end])
        ids.reverse()
        return ids

    def _search(self, stretch: str) -> bytes:
        if len(stretch) < 2 * self.longest:
            found = self._short(stretch)
            if found is not None:
                return array("i", found).tobytes()
        ids = array("i")
        for committed in self.stream(stretch):
            ids.extend(committed)
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as the model's own library gives them, without begin and end."""
        if not text:
            return np.zeros(0, np.int32)
        stretches = self._stretch.findall(BLANK + text.replace(" ", BLANK))
        memo = self._memo
        found = list(map(memo.young.get, stretches))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    stretch = stretches[i]
                    ids = memo.get(stretch)
                    if ids is None:
                        ids = self._search(stretch)
                        if len(stretch) <= MEMO_CHARS:
                            memo.put(stretch, ids)
                    found[i] = ids
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; inverse of `encode` but for a blank symbol in the text."""
        is_byte = (ids >= self._low) & (ids <= self._high)
        name = self._text_of
        if not is_byte.any():
            out = "".join([name[i] for i in ids.tolist()])
        else:
            edge = np.flatnonzero(np.diff(is_byte.astype(np.int8))) + 1
            parts = []
            for run, byte in zip(
                np.split(ids, edge), np.split(is_byte, edge), strict=True
            ):
                if byte[0]:
                    parts.append(bytes(self.byte_of[i] for i in run.tolist()).decode("utf-8", "replace"))
                else:
                    parts.append("".join([name[i] for i in run.tolist()]))
            out = "".join(parts)
        return out.replace(BLANK, " ").removeprefix(" ")


def piece_model(path: str) -> PieceModel:
    """The model of a file, kept with its memo by a Python worker."""
    return kept(PieceModel, path)


def encode_documents(docs: DataFrame, model: str, keep_text: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, round_trip (and text, decoded from the ids).

    `model` is the path of a SentencePiece BPE file that every worker has. round_trip
    says whether decoding the ids gives the text; it is false only for texts that hold
    the blank symbol itself. Null texts count as empty and have no ids. Repeated rows are
    encoded one by one, an empty table gives an empty result, other columns are not read.
    """

    def make():
        own = piece_model(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            ids = [own.encode(t) for t in texts]
            back = [own.decode(x) for x in ids]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            ]
            names = ["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"]
            if keep_text:
                columns.append(pa.array(back, pa.string()))
                names.append("text")
            return pa.record_batch(columns, names)

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean"
    texts = docs.select("doc_id", text_of().alias("text"))
    return map_arrow(texts, make, schema + (", text string" if keep_text else ""))


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null or empty ids give an empty text."""

    def make():
        own = piece_model(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            back = [own.decode(np.asarray(x, np.int32)) for x in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

        return each

    kind = encoded.schema["doc_id"].dataType.simpleString()
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return map_arrow(encoded.select("doc_id", ids.alias("ids")), make, f"doc_id {kind}, text string")
