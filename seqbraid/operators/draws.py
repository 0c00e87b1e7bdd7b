"""The tries of matched negative pairs, evaluated where the nodes of a pool lie.

A matched pair takes hundreds of draws per link, and nearly all of them end at a look at
their node. As a join every draw would be a shuffled row. Here the links of a pool are dealt
into parts, each part meets the nodes of its pool once, and only pairs that pass leave the task.
The draws are those of `functions.hashing.draw`, many MD5 sums at a time.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.functions.hashing import DRAW_DIGITS
from seqbraid.session import import_in_workers, materialise_counted

# Links of a part, at least; larger pools have parts of a quarter of their nodes, so that
# nodes are repeated in proportion to the links.
PART_LINKS = 32_768
MOST_TASKS = 4_096
# Sums that are worked on at a time, few enough for a processor's cache.
_AT_ONCE = 16_384
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_BLOCK = 55  # bytes of a text that is one block of MD5


def _digest(words: list[np.ndarray]) -> np.ndarray:
    """The first 15 hexadecimal digits of the MD5 sums of blocks given as 16 arrays of words."""
    a, b, c, d = (np.full((1,) * words[0].ndim, x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed = mixed + a + (words[at] + _SINES[i])
        turn = _SHIFTS[i // 16][i % 4]
        a, d, c = d, c, b
        b = b + ((mixed << np.uint32(turn)) | (mixed >> np.uint32(32 - turn)))
    high = (a + _START[0]).byteswap().astype(np.uint64)
    low = (b + _START[1]).byteswap().astype(np.uint64)
    return (((high << np.uint64(32)) | low) >> np.uint64(64 - 4 * DRAW_DIGITS)).astype(np.int64)


def _texts(values: np.ndarray) -> np.ndarray:
    """Decimal texts, as long as the longest."""
    texts = values.astype("S")
    return texts.astype(f"S{np.char.str_len(texts).max()}")


def _varying(words: np.ndarray) -> list[np.ndarray]:
    """The words of blocks one by one; one that all blocks share is kept once."""
    return [w[:1] if (w == w[0]).all() else w for w in np.ascontiguousarray(words.view("<u4").T)]


class _Links:
    """The blocks of links whose ids have equally many digits, made once for all their draws."""

    def __init__(self, head: bytes, ids: np.ndarray):
        self.head, self.texts = head, _texts(ids)
        self.at = len(head) + self.texts.dtype.itemsize + 1
        if self.at < _BLOCK:
            blocks = np.zeros((len(ids), 64), np.uint8)
            blocks[:, : len(head)] = np.frombuffer(head, np.uint8)
            blocks[:, len(head) : self.at - 1] = self.texts.view(np.uint8).reshape(len(ids), -1)
            blocks[:, self.at - 1] = ord("|")
            self.words = _varying(blocks)


class _Draws:
    """Draws of links for numbers that have equally many digits."""

    def __init__(self, links: _Links, numbers: np.ndarray):
        self.links, self.numbers = links, numbers
        tail = _texts(numbers)
        size = links.at + tail.dtype.itemsize
        self.one_block = size <= _BLOCK
        if not self.one_block:
            return
        ends = np.zeros((len(numbers), 64), np.uint8)
        ends[:, links.at : size] = tail.view(np.uint8).reshape(len(numbers), -1)
        ends[:, size] = 0x80
        ends[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
        self.ends = _varying(ends)

    def _plain(self, link: int, number: int) -> int:
        text = b"|".join((self.links.head + self.links.texts[link], str(int(self.numbers[number])).encode()))
        return int(md5(text).hexdigest()[:DRAW_DIGITS], 16)

    def grid(self) -> np.ndarray:
        """A row for every number, a column for every link."""
        shape = (len(self.numbers), len(self.links.texts))
        if not self.one_block:
            return np.array([self._plain(j, i) for i in range(shape[0]) for j in range(shape[1])], np.int64).reshape(shape)
        words = [x[None, :] + y[:, None] for x, y in zip(self.links.words, self.ends, strict=True)]
        return np.broadcast_to(_digest(words), shape)

    def some(self, number: np.ndarray, link: np.ndarray) -> np.ndarray:
        """The draws at some places of the grid."""
        if not self.one_block:
            return np.array([self._plain(j, i) for i, j in zip(number, link, strict=True)], np.int64)
        words = [
            (x[link] if len(x) > 1 else x) + (y[number] if len(y) > 1 else y)
            for x, y in zip(self.links.words, self.ends, strict=True)
        ]
        return np.broadcast_to(_digest(words), link.shape)


def _of_equal_length(values: np.ndarray) -> list[np.ndarray]:
    """Places of the values with 1, 2, 3 ... digits; a sign is a digit."""
    digits = np.char.str_len(values.astype("S"))
    return [np.flatnonzero(digits == n) for n in np.unique(digits)]


def _passed(
    head: bytes, links: dict[str, np.ndarray], nodes: dict[str, np.ndarray], tries: range, by_degree: bool
) -> list[tuple[np.ndarray, ...]]:
    """(link, try, first rank, second rank) of the pairs that meet the rule but may be positives."""
    n, so, degree = len(nodes["SO"]), nodes["SO"], nodes["degree"]
    found = []
    numbers = np.arange(tries.start, tries.stop, dtype=np.int64)
    for same in _of_equal_length(links["link_id"]):
        for first in range(0, len(same), _AT_ONCE):
            own = same[first : first + _AT_ONCE]
            ids, a, b = links["link_id"][own], links["deg_u_pos"][own], links["deg_v_pos"][own]
            rows = max(1, _AT_ONCE // len(own))
            blocks, d_pos, most = _Links(head, ids), links["d_pos"][own], links["tolerance"][own]
            # The two draws of a try are an even number and the odd one after it: equally long.
            for equal in _of_equal_length(numbers * 2):
                for low in range(0, len(equal), rows):
                    turn = numbers[equal[low : low + rows]]
                    u = _Draws(blocks, turn * 2).grid() % n
                    if by_degree:
                        at = degree[u]
                        place, link = np.nonzero((at == a) | (at == b))
                    else:
                        place, link = (x.ravel() for x in np.indices(u.shape))
                    if not len(place):
                        continue
                    u = u[place, link]
                    v = _Draws(blocks, turn * 2 + 1).some(place, link) % n
                    far = np.abs(np.abs(so[u] - so[v]) - d_pos[link])
                    ok = (u != v) & (far <= most[link])
                    if by_degree:
                        x, y = degree[u], degree[v]
                        ok &= ((x == a[link]) & (y == b[link])) | ((x == b[link]) & (y == a[link]))
                    found.append((ids[link[ok]], turn[place[ok]], u[ok], v[ok]))
    return found


def matched_pairs(
    waiting: DataFrame,
    ranked: DataFrame,
    pool: list[str],
    tolerance: Column,
    by_degree: bool,
    seed: int,
    tries: range,
) -> DataFrame:
    """(slice_id, link_id, try, u, v) of all given tries that meet the rule, positives among them.

    `waiting` has the pool, link_id, d_pos, deg_u_pos, deg_v_pos and `parts`, the number of
    parts its pool's links are dealt into; `ranked` has the pool, rank (dense, from 0), oid, SO
    and degree.
    """
    spark = waiting.sparkSession
    import_in_workers(spark)
    key = [*pool, "_part"]
    links = waiting.select(
        *pool,
        F.pmod(F.xxhash64("link_id"), F.col("parts")).alias("_part"),
        "link_id",
        "d_pos",
        tolerance.cast("long").alias("tolerance"),
        "deg_u_pos",
        "deg_v_pos",
    )
    met, seen = materialise_counted(links.select(*key).distinct())
    # Adaptive execution merges partitions by their bytes; what counts here are the draws, so that
    # parts get partitions of their own as far as their hashes allow.
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(shuffled, min(MOST_TASKS, 2 * seen["rows"]))
    beside = [F.col(c).alias(f"_of_{c}") for c in key]
    nodes = ranked.join(met, pool).select(*beside, "rank", "oid", "SO", "degree")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["slice_id", "link_id", "try", "u", "v"]
        kinds = [pa.string(), *[pa.int64()] * 4]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        own = left.column("slice_id")[0].as_py()
        order = right.column("rank").to_numpy()
        at = {}
        for name in ("oid", "SO", "degree"):
            at[name] = np.empty(len(order), np.int64)
            at[name][order] = right.column(name).to_numpy()
        cols = ("link_id", "d_pos", "tolerance", "deg_u_pos", "deg_v_pos")
        anchors = {name: left.column(name).to_numpy() for name in cols}
        parts = _passed(f"{seed}|{own}|".encode(), anchors, at, tries, by_degree)
        link, turn, u, v = (
            (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        )
        rows = [pa.array([own] * len(link), pa.string()), link, turn, at["oid"][u], at["oid"][v]]
        return pa.table([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    schema = "slice_id string, link_id long, `try` long, u long, v long"
    own = [f"_of_{c}" for c in key]
    links, nodes = links.repartition(n, *key), nodes.repartition(n, *own)
    return links.groupBy(*key).cogroup(nodes.groupBy(*own)).applyInArrow(each, schema)
