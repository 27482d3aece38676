"""Periodic runs of words: an online sparse diagonal dynamic programme.

A run is a stretch of words with smallest period q (words q apart are equal), at
least ``max(LEAST, REPEATS * q)`` words long, that no neighbouring word extends.
Word i and an earlier occurrence of it at i - p lie on diagonal p (the lag); the
length of the match that ends there is one more than that of the pair before it
on the diagonal. A diagonal that ends with enough matches emits its run, and of
the runs that cover the same stretch the one with the smallest lag stays.

The programme is sparse in two exact ways. Lags are taken by octaves: a lag of
2^k or more can only make a run with a match of ``max(LEAST - p, p)`` words, so
every ``stride``-th word is looked up, together with the ``width - 1`` words behind
it, and any match of that length holds such a window. And only words whose window
occurs elsewhere in the text stay for longer windows, so a text without repeats is
done after one sort. A word has at most 2^k earlier occurrences in an octave and
every 2^(k-1)-th word asks, which bounds the pairs of an octave by twice the words of
the text, also if all its words are equal. The two ends of an ended diagonal are
then moved by the words that the stride left out, with windows of halved widths.

All words of a block of texts are worked on together (numpy), told apart by a
number mixed into the word hashes; a long text is a block by itself. Words are
compared by 64-bit hashes. Rows are independent: one narrow pass, no shuffle.

Defined results: a null text has no words; a null id is no number, so its text is not
edited by ``edited``; texts are split at blank and the ASCII controls tab to
return; rows with equal ids are rows of their own; ties between greatest runs go to
the smaller start, then period; an empty table gives no rows; of other columns only those
named in ``keep`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm.minhash import mix
from nightjar.llm.pieces import blocks, run_hashes

#: Words in a run, at least, and periods in a run, at least.
LEAST, REPEATS = 12, 2
#: Characters and texts of a block.
BLOCK_CHARS, BLOCK_DOCS = 2_000_000, 4096

U = np.uint64
RUNS = "start bigint, length bigint, period bigint"


@dataclass
class Words:
    """The words of a block's texts, one after the other: hashes told apart by text, text numbers, first word of each text."""

    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, bytes]:
        """And where each word starts and ends in the joined texts."""
        joined = b" ".join(texts) + b" "
        data = np.frombuffer(joined, np.uint8)
        blank = (data == 32) | (data >= 9) & (data <= 13)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        heads = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        text = np.searchsorted(heads, starts, "right") - 1
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        return Words(run_hashes(data, starts, ends, 0) if len(starts) else np.zeros(0, U), text, first), starts, ends, joined

    def taken(self, order: np.ndarray) -> Words:
        return Words(self.hashes[order], self.text, self.first)


def edited(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a text of n words starts to repeat and its period, for one id in ten."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    start = g % n
    return start, 1 + (n - start) // (3 + g % 8)


def _octaves(longest: int, least: int, repeats: int) -> Iterator[tuple[int, int, int, int]]:
    """lowest lag, next octave's lowest lag, width of a window and stride; widths never fall."""
    lows = [1 << k for k in range(longest.bit_length()) if repeats << k <= longest]
    matches = [min(max(least - p, (repeats - 1) * p) for p in range(low, min(2 * low, low + least))) for low in lows]
    widths = [1 << (2 * match // 3).bit_length() - 1 for match in matches]
    for i, low in enumerate(lows):
        width = min(widths[i:])
        yield low, 2 * low, width, min(width, matches[i] - width + 1)


def find_runs(words: Words, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and period of every run of the block, by start, then period (starts count over the block)."""
    n = len(words.hashes)
    none = np.zeros(0, np.int64)
    if n == 0 or least < 3 or repeats < 2:
        if n:
            raise ValueError("runs need at least 3 words and 2 periods")
        return none, none, none
    sizes = np.diff(words.first)
    ends = words.first[1:][words.text]
    #: Hashes of the windows of 1, 2, 4, ... words at each word; a window that leaves the text equals no other.
    windows = [mix(words.hashes + mix(words.text.astype(U) + U(1)))]

    def window(width: int) -> np.ndarray:
        while 1 << (len(windows) - 1) < width:
            half = 1 << (len(windows) - 1)
            own = windows[-1]
            longer = own * U(0x9E3779B97F4A7C15)
            longer[:n - half] += own[half:]
            longer[max(0, n - half):] += np.arange(min(half, n), dtype=U)
            windows.append(mix(longer))
        return windows[width.bit_length() - 1]

    def same(at: np.ndarray, lag: np.ndarray, width: int) -> np.ndarray:
        """Whether ``width`` words at these places equal those ``lag`` before; places may leave the text."""
        inside = (at - lag >= words.first[text_of]) & (at + width <= ends_of)
        own = window(width)
        return inside & (own[np.where(inside, at, 0)] == own[np.where(inside, at - lag, 0)])

    alive, width_of_alive = np.arange(n), 0
    found = []
    for low, high, width, stride in _octaves(int(sizes.max()), least, repeats):
        own = window(width)
        if width != width_of_alive:
            # Sorted by window, then place; windows that occur once can't be in a longer one that occurs twice.
            alive = alive[alive + width <= ends[alive]]
            order = np.lexsort((alive, own[alive]))
            alive = alive[order]
            keys = own[alive]
            equal = keys[1:] == keys[:-1]
            repeated = np.zeros(len(alive), bool)
            repeated[1:] |= equal
            repeated[:-1] |= equal
            alive, keys = alive[repeated], keys[repeated]
            group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else none
            place = group * (n + 1) + alive
            back, width_of_alive = np.sort(alive), width
        if not len(alive):
            break
        asking = (alive - words.first[words.text[alive]]) % stride == 0
        at, base = alive[asking], place[asking] - alive[asking]
        lo = np.searchsorted(place, base + np.maximum(at - high + 1, 0))
        hi = np.searchsorted(place, base + np.maximum(at - low + 1, 0))
        count = np.maximum(hi - lo, 0)
        if not count.sum():
            continue
        index = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        i = np.repeat(at, count)
        lag = i - alive[index]
        # Along each diagonal: pairs a stride apart carry the match on, any other pair starts one.
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        starts = np.ones(len(i), bool)
        starts[1:] = (lag[1:] != lag[:-1]) | (i[1:] - i[:-1] != stride) | (words.text[i[1:]] != words.text[i[:-1]])
        heads = np.flatnonzero(starts)
        tails = np.append(heads[1:], len(i)) - 1
        a, b, lag = i[heads], i[tails] + width, lag[heads]  # the match: words a to b - 1
        text_of, ends_of = words.text[a], ends[a]
        step = 1 << max(0, (stride - 1).bit_length() - 1)
        while step and stride > 1:
            b = np.where(same(b, lag, step), b + step, b)
            a = np.where(same(a - step, lag, step), a - step, a)
            step //= 2
        start, length = a - lag, b - a + lag
        enough = (length >= least) & (length >= repeats * lag)
        found.append(np.column_stack([start[enough], length[enough], lag[enough]]))
    if not found:
        return none, none, none
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # A stretch with periods p and q that holds both of them twice has their greatest common divisor as a period.
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return tuple(runs[np.lexsort((runs[:, 2], runs[:, 0]))].T)


def _outside(words: Words, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which words no run holds after its first period."""
    start, length, period = runs
    depth = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


SUMMARY = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")


def summaries(ids: list[int | None], texts: list[str | None], edit: Callable[[int | None, int], tuple[int, int] | None] | None = edited,
              least: int = LEAST, repeats: int = REPEATS) -> dict[str, list]:
    """The columns of SUMMARY and ``runs`` and ``collapsed`` for a block of texts."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, starts, ends, joined = Words.of(data)
    order = np.arange(len(words.hashes))
    touched = set()
    for k, doc_id in enumerate(ids):
        a, b = int(words.first[k]), int(words.first[k + 1])
        if edit and (made := edit(doc_id, b - a)):
            at, period = made
            order[a + at:b] = a + at + np.arange(b - a - at) % period
            touched.add(k)
    words = words.taken(order)
    runs = find_runs(words, least, repeats)
    keep = _outside(words, runs)
    text_of_run = words.text[runs[0]]
    bounds = np.searchsorted(text_of_run, np.arange(len(texts) + 1))
    out = {name.split()[0]: [] for name in SUMMARY.split(", ")} | {"runs": [], "collapsed": []}
    for k in range(len(texts)):
        own = slice(bounds[k], bounds[k + 1])
        a, b = int(words.first[k]), int(words.first[k + 1])
        start, length, period = ((r[own] - x).tolist() for r, x in zip(runs, (a, 0, 0)))
        out["n_runs"].append(len(start))
        best = min(zip(length, start, period), key=lambda r: (-r[0], r[1], r[2]), default=None)
        for name, value in zip(("start", "length", "period", "exponent_milli"), (best[1], best[0], best[2], 1000 * best[0] // best[2]) if best else (None,) * 4):
            out[name].append(value)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start, length, period))
        out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in zip(start, length, period)])
        out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
        if k in touched or start:
            of = order[a:b][keep[a:b]]
            collapsed = b" ".join([joined[x:y] for x, y in zip(starts[of].tolist(), ends[of].tolist())])
        else:
            collapsed = b" ".join(data[k].split())
        out["collapsed"].append(collapsed)
        out["collapsed_sha256"].append(hashlib.sha256(collapsed).hexdigest())
    return out


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, int], tuple[int, int] | None] | None = None, least: int = LEAST, repeats: int = REPEATS,
                  keep: tuple[str, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """Per row: the columns of ``keep``, those of SUMMARY and, ``with_text``, all runs and the collapsed text.

    ``edit`` gives, for an id and its number of words, from which word on the text shall repeat with which period."""
    slim = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    fields = [f"__{i} {slim.schema[f'__{i}'].dataType.simpleString()}" for i in range(len(keep))] + [SUMMARY]
    fields += [f"runs array<struct<{RUNS.replace(' ', ':').replace(',:', ',')}>>, collapsed string"] if with_text else []
    run_type = pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in RUNS.split(", ")]))

    def run(batches):
        for batch in blocks(batches, BLOCK_CHARS, BLOCK_DOCS):
            made = summaries(batch.column("__id").to_pylist(), batch.column("text").to_pylist(), edit, least, repeats)
            columns = {f"__{i}": batch.column(f"__{i}") for i in range(len(keep))}
            columns |= {c.split()[0]: pa.array(made[c.split()[0]], pa.int64() if c.endswith("bigint") else pa.string()) for c in SUMMARY.split(", ")}
            if with_text:
                columns |= {"runs": pa.array(made["runs"], run_type), "collapsed": pa.array([c.decode("utf-8", "surrogatepass") for c in made["collapsed"]], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return slim.mapInArrow(run, ", ".join(fields)).withColumnsRenamed({f"__{i}": c for i, c in enumerate(keep)})
