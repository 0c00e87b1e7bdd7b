"""Runs of periodic words, found by minimizers at several scales.

A run is a longest stretch of words that repeats with a smallest period q at least
EXPONENT times over. Periods below SHORT are found by comparing the whole sequence with
itself at each lag. Every other period p belongs to one scale, a power of two w with
w/2 <= p < w:

* Windows of w words are hashed, by doubling the windows of the scale before. As w > p,
  two windows of a run are equal only if they are whole periods apart.
* Among any w/2 neighbouring windows the one with the least hash is a minimizer. A run of
  4p words holds two such neighbourhoods one period apart, so at least one minimizer of
  the run and its next equal one are p words apart.
* Next equal minimizers w/2 to w - 1 words apart are seeds. A seed is extended to both
  sides by comparing words at its distance; seeds inside a run of that distance are done.

A seed means a stretch of more than two periods, so extension costs about as much as
the repeats that are really there, and the work on a text is n log n. All texts of a slice
are searched as one sequence, in which no word of one text equals a word of another.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.llm.common import map_arrow, text_of
from seqbraid.llm.textnp import mix

EXPONENT = 4
MIN_WORDS = 6
SHORT = 8
SLICE_BYTES = 1 << 20
_WIDER = np.uint64(0xD6E8FEB86659FD93)
_RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)


def shortest_run(period: int) -> int:
    return max(MIN_WORDS, EXPONENT * period)


def lag_runs(ids: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    """(start, end) of all stretches with this period that are long enough, by one scan."""
    if len(ids) < shortest_run(period):
        return
    equal = np.zeros(len(ids) - period + 2, np.int8)
    equal[1:-1] = ids[period:] == ids[:-period]
    edge = np.flatnonzero(np.diff(equal))
    start, stop = edge[::2], edge[1::2]
    long_enough = stop - start + period >= shortest_run(period)
    yield from zip(
        start[long_enough].tolist(), (stop[long_enough] + period).tolist(), strict=True
    )


def _slide(values: np.ndarray, width: int, fold) -> np.ndarray:
    """`fold` over every `width` (a power of two) neighbouring values."""
    step = 1
    while step < width:
        values = fold(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(windows: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hashes among any `width` neighbours; equal least ones all count."""
    if len(windows) < width:
        return np.zeros(0, np.int64)
    least = _slide(windows, width, np.minimum)
    pad = np.zeros(width - 1, windows.dtype)
    return np.flatnonzero(_slide(np.concatenate((pad, least, pad)), width, np.maximum) == windows)


def seeds(windows: np.ndarray, at: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of next equal minimizers of one scale, by distance and position."""
    chosen = minimizers(windows, scale // 2)
    order = np.argsort(windows[chosen], kind="stable")
    chosen = chosen[order]
    place, value = at[chosen], windows[chosen]
    distance = np.diff(place)
    keep = np.flatnonzero(
        (value[1:] == value[:-1]) & (distance >= scale // 2) & (distance < scale)
    )
    order = np.lexsort((place[keep], distance[keep]))
    return place[keep][order], distance[keep][order]


def _equal_steps(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How far ids from a on, one by one in direction `step`, equal those from b on."""
    done, size = 0, 64
    room = len(ids) - b if step > 0 else a + 1
    while done < room:
        size = min(size, room - done)
        if step > 0:
            same = ids[a + done : a + done + size] == ids[b + done : b + done + size]
        else:
            lo, hi = a - done - size + 1, a - done + 1
            same = (ids[lo:hi] == ids[lo + b - a : hi + b - a])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, size = done + size, size * 2
    return done


def scale_runs(
    ids: np.ndarray, place: np.ndarray, distance: np.ndarray
) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs of seeds that come by distance and position."""
    period, end = -1, -1
    for at, d in zip(place.tolist(), distance.tolist(), strict=True):
        if d == period and at < end - d:
            continue
        period = d
        start = at - _equal_steps(ids, at - 1, at - 1 + d, -1)
        end = at + _equal_steps(ids, at, at + d, 1) + d
        if end - start >= shortest_run(d):
            yield start, end, d


def runs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs, by start and period.

    `ids` are the words of texts of these sizes one after another; no two texts may share
    an id. A period that is a multiple of a smaller one has the same stretch and is left out.
    """
    found: dict[tuple[int, int], int] = {}
    for period in range(1, SHORT):
        for stretch in lag_runs(ids, period):
            found.setdefault(stretch, period)
    windows = mix(ids.astype(np.uint64) + np.uint64(1))
    at, held, scale = np.arange(len(ids)), np.asarray(sizes, np.int64), 1
    while True:
        scale *= 2
        windows = mix(windows * _WIDER + np.append(windows[scale // 2 :], windows[: scale // 2]))
        if scale < 2 * SHORT:
            continue
        # Shorter texts hold no run of this scale's periods.
        long_enough = held >= EXPONENT * (scale // 2)
        if not long_enough.any():
            break
        keep = np.repeat(long_enough, held)
        windows, at, held = windows[keep], at[keep], held[long_enough]
        for start, end, period in scale_runs(ids, *seeds(windows, at, scale)):
            found.setdefault((start, end), period)
    out = np.array(sorted((s, e - s, p) for (s, e), p in found.items()), np.int64).reshape(-1, 3)
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    return out[:, 0], out[:, 1], out[:, 2]


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """An id for every word; equal within a text only where the words are equal."""
    count = itertools.count()
    ids: list[int] = []
    for words in texts:
        ids.extend(map(defaultdict(count.__next__).__getitem__, words))
    return np.array(ids, np.int64)


def _collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period, joined by a blank."""
    if found:
        cover = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            cover[start + period] += 1
            cover[start + length] -= 1
        words = itertools.compress(words, np.cumsum(cover)[:-1] == 0)
    return b" ".join(words)


def _searched(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    words = [text.split() for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    start, length, period = runs(_numbered(words), sizes)
    text = np.searchsorted(begin + sizes, start, "right")
    cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    own = list(
        zip((start - begin[text]).tolist(), length.tolist(), period.tolist(), strict=True)
    )
    for i, w in enumerate(words):
        found = own[cut[i] : cut[i + 1]]
        yield found, _collapse(w, found)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period), collapsed.

    Words are what ASCII white space (0x20, 0x09-0x0D) separates. `collapsed` is the text
    without the words that any run holds after its first period, joined by one blank. Null
    and empty texts have no words, no runs and an empty `collapsed`. Texts of any length are
    searched whole. Every row is answered for itself, so repeated or null ids are kept and
    doc_id keeps its type; an empty table gives an empty one. Columns other than doc_id and
    text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).cast(pa.large_binary())
            sizes = np.cumsum([0, *map(len, texts.to_pylist())])
            found, collapsed, row = [], [], 0
            while row < len(texts):
                last = int(np.searchsorted(sizes, sizes[row] + SLICE_BYTES, "right")) - 1
                last = min(max(last, row + 1), len(texts))
                for own, kept in _searched(texts.slice(row, last - row).to_pylist()):
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    collapsed.append(kept)
                row = last
            return pa.record_batch(
                [
                    batch.column(0),
                    pa.array(found, _RUN_TYPE),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )

        return each

    texts = docs.select("doc_id", text_of().alias("text"))
    return map_arrow(texts, make, f"doc_id {kind}, runs {_RUNS}, collapsed string")


def strongest(found: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones."""
    return F.reduce(
        found,
        F.get(found, 0),
        lambda best, run: F.when(
            run["length"] * best["period"] > best["length"] * run["period"], run
        ).otherwise(best),
    )


def run_table(found: Column) -> Column:
    """A `start,length,period` line for every run."""
    return F.array_join(
        F.transform(
            found,
            lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
        ),
        "",
    )
