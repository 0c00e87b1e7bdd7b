"""Exact token counts at every prefix, by dynamic programming over byte-pair encodings.

A byte-pair encoding is the only sequence of tokens in which every two neighbours are
what encoding their joined bytes gives. So the encoding of each prefix of a word has one
possible last token: the token t ending there for which the last token of the prefix
before t is a valid left neighbour. Then count(prefix) = count(prefix before t) + 1. A
table over the prefixes of a word follows from left to right, with validity of token
pairs remembered.

Across a text the pre-tokeniser cuts at every step from a non-space to white space,
whatever follows, so a text is a sequence of chunks (white space, then non-space) and
the count before every chunk is a running sum. A prefix that ends inside a chunk adds
the chunk's own prefix table. Truncation and budget questions are answered from these
tables without encoding again.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.llm.common import kept, map_arrow, text_of

LIMIT = 512
CACHE_ENTRIES = 1_000_000
# Unicode white space, as the pre-tokeniser's \s has it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_PLAIN_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_WHITE = re.compile("[\t\x0b\x0c\r\x85\xa0  -     　]")
_RUN = re.compile(f"[{_WHITE}]+")
# Fixed value: the pattern of the byte-level pre-tokeniser.
_PIECES = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    regex.VERSION0,
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for every byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Memo:
    """Remembered answers in two generations, at most 2 * `size`; what is in use survives."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PairDP:
    """Last token and count of every prefix of a symbol string.

    `vocab` maps symbol strings to ids; `valid(left, right)` says whether two token
    strings stay as they are when they are encoded together.
    """

    def __init__(self, vocab: dict[str, int], valid: Callable[[str, str], bool]):
        self.vocab = vocab
        self.longest = max(map(len, vocab))
        self._ask = valid
        self._known: dict[tuple[str, str], bool] = {}

    def valid(self, left: str, right: str) -> bool:
        answer = self._known.get((left, right))
        if answer is None:
            if len(self._known) >= CACHE_ENTRIES:
                self._known.clear()
            answer = self._known[left, right] = self._ask(left, right)
        return answer

    def table(self, symbols: str) -> tuple[list[str], list[int]]:
        """last[i] and count[i] for the prefix of i symbols, i from 0."""
        vocab, known, longest = self.vocab, self._known, self.longest
        last, count = [""], [0]
        for i in range(1, len(symbols) + 1):
            for start in range(i - 1, max(-1, i - longest - 1), -1):
                token = symbols[start:i]
                if token in vocab:
                    if start:
                        left = last[start]
                        good = known.get((left, token))
                        if good is None:
                            good = self.valid(left, token)
                        if not good:
                            continue
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends at {i} in {symbols[:i]!r}")
        return last, count


class PrefixCounter:
    """Token counts of texts and of all their prefixes for a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))

        def valid(left: str, right: str) -> bool:
            return bare.encode(left + right, add_special_tokens=False).tokens == [left, right]

        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self._special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        # A token that its own bytes are not encoded to never ends a prefix.
        self._dp = PairDP(model["vocab"], valid)
        self._alphabet = byte_alphabet()
        self._words = Memo(CACHE_ENTRIES // 4)
        self._chunks = Memo(CACHE_ENTRIES // 2)

    def symbols(self, text: str) -> str:
        alphabet = self._alphabet
        return "".join([alphabet[b] for b in text.encode("utf-8", "surrogatepass")])

    def _word(self, word: str) -> int:
        found = self._words.get(word)
        if found is None:
            found = self._dp.table(self.symbols(word))[1][-1]
            self._words.put(word, found)
        return found

    def _chunk(self, chunk: str) -> int:
        return sum(map(self._word, _PIECES.findall(chunk)))

    def segments(self, text: str) -> list[tuple[int, bool, list[str]]]:
        """Start, is_special and chunks of the parts between special tokens."""
        out, at = [], 0
        for match in self._special.finditer(text):
            if match.start() > at:
                out.append((at, False, self.chunks(text[at : match.start()])))
            out.append((match.start(), True, [match.group()]))
            at = match.end()
        if at < len(text):
            out.append((at, False, self.chunks(text[at:])))
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        return (_CHUNK if _OTHER_WHITE.search(text) else _PLAIN_CHUNK).findall(text)

    def chunk_counts(self, chunks: list[str]) -> list[int]:
        memo = self._chunks
        counts = list(map(memo.young.get, chunks))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    n = memo.get(chunks[i])
                    if n is None:
                        n = self._chunk(chunks[i])
                        memo.put(chunks[i], n)
                    counts[i] = n
        return counts

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """The count of a text, and the length of its longest prefix of at most `limit` tokens."""
        if self._special.search(text):
            total = self.count(text)
            return total, self.longest_within(text, limit) if total > limit else len(text)
        chunks = self.chunks(text)
        sums = list(accumulate(self.chunk_counts(chunks), initial=0))
        if sums[-1] <= limit:
            return sums[-1], len(text)
        return sums[-1], self._cut(chunks, sums, limit)

    def _cut(self, chunks: list[str], sums: list[int], limit: int) -> int:
        """Characters of the longest prefix of the chunks within the limit; sums[0] fits."""
        # Counts inside a chunk exceed the sum before it, so chunks after `stop` cannot fit.
        stop = bisect.bisect_right(sums, limit)
        base = sum(map(len, chunks[: stop - 1]))
        if stop > len(chunks):
            return base
        table = self.chunk_table(chunks[stop - 1])
        return base + max(j for j, n in enumerate(table) if sums[stop - 1] + n <= limit)

    def count(self, text: str) -> int:
        if self._special.search(text):
            return sum(
                1 if special else sum(self.chunk_counts(chunks))
                for _, special, chunks in self.segments(text)
            )
        return sum(self.chunk_counts(self.chunks(text)))

    def _char_counts(self, piece: str) -> list[int]:
        """The count of every prefix of one pre-token, by characters, from 0."""
        byte_counts = self._dp.table(self.symbols(piece))[1]
        ends = accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)
        return [byte_counts[e] for e in ends]

    def chunk_table(self, chunk: str) -> list[int]:
        """The count of every prefix of a chunk, by characters, from 0."""
        run = _RUN.match(chunk)
        space = run.end() if run else 0
        out = self._char_counts(chunk[:space])
        if space == len(chunk):
            return out
        done, at = 0, 0
        for piece in _PIECES.findall(chunk):
            if at + len(piece) > space:
                if piece in ("'re", "'ve", "'ll"):
                    # Cut short, a contraction is an apostrophe and a letter.
                    inner = [self._word("'"), self._word("'") + self._word(piece[1])]
                    inner.append(self._word(piece))
                else:
                    inner = self._char_counts(piece)[1:]
                skip = max(0, space - at)
                out += [done + n for n in inner[skip:]]
            done += self._word(piece)
            at += len(piece)
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """The exact token count of text[:i] for every i from 0 to len(text).

        A prefix that ends inside a special token counts that part as ordinary text.
        """
        out, done = [0], 0
        for at, special, chunks in self.segments(text):
            if special:
                for i in range(1, len(chunks[0])):
                    out.append(self.count(text[: at + i]))
                done += 1
                out.append(done)
                continue
            for chunk in chunks:
                out += [done + n for n in self.chunk_table(chunk)[1:]]
                done += self.chunk_counts([chunk])[0]
        return out

    def longest_within(self, text: str, limit: int) -> int:
        """The length in characters of the longest prefix of at most `limit` tokens.

        Special tokens inside the text are whole: the cut does not fall inside one.
        """
        best, done, at = 0, 0, 0
        for start, special, chunks in self.segments(text):
            at = start
            if special:
                done += 1
                at += len(chunks[0])
                best = at if done <= limit else best
                continue
            sums = list(accumulate(self.chunk_counts(chunks), initial=done))
            if sums[0] <= limit:
                best = max(best, at + self._cut(chunks, sums, limit))
            done = sums[-1]
        return best


def counter(path: str) -> PrefixCounter:
    """The counter of a tokenizer file, kept with its tables by a Python worker."""
    return kept(PrefixCounter, path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_chars of every document.

    `tokenizer` is the path of a byte-level BPE file that every worker has. cut_chars is
    the length of the longest prefix of at most `limit` tokens. Null texts count as empty:
    0 bytes, 0 tokens. Special strings inside a text are one token each. Repeated rows are
    counted one by one, an empty table gives an empty result, and other columns are not read.
    """

    def make():
        own = counter(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            measured = [own.measure(t, limit) for t in texts]
            counts, cuts = [m[0] for m in measured], [m[1] for m in measured]
            return pa.record_batch(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(counts, pa.int64()),
                    pa.array(cuts, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "cut_chars"],
            )

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of()
    counted = map_arrow(
        docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")),
        make,
        f"doc_id {kind}, n_bytes long, n_tokens long, cut_chars long",
    )
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars"
    )
