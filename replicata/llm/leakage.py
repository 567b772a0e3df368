"""Problem 7: passages of held-out items inside a corpus.

Items and documents become sequences of words.  Every window of as many words as the shortest passage that counts is
embedded by a CGK random walk over its words, which maps few edits to a small Hamming distance; repeated samples of the
walk's places are the keys of a locality-sensitive hash, repeated as often as the wanted recall asks for.  Hits are verified by the exact
edit distance in words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicata.plans.skew import join_pairs
from replicata.plans.storage import materialize, spread

_DROPPED = re.compile("[­​-‏⁠-⁤﻿᠎]")
_BROKEN = re.compile("(?<=[^\\W_])[-‐‑][^\\S\r\n]*(?:\r\n|[\r\n\x0b\x0c\x85  ])[^\\S\r\n]*(?:>[^\\S\r\n]*)*(?=[^\\W_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits without letter case; soft hyphens and zero-width characters are dropped, words broken at a line end joined."""
    if not text:
        return []
    return _WORD.findall(_BROKEN.sub("", _DROPPED.sub("", text)).lower())


def word_hash(w: str) -> int:
    """A 64-bit number of a word, never 0."""
    return xxhash.xxh64_intdigest(w) or 1


class Walks:
    """CGK embeddings of windows of word numbers, each with one sample of its places as a 64-bit key.

    At place j a walk writes the word under its pointer (0 beyond the end) and moves on by a random bit of (j, word).  It takes two steps for each word that
    edits cannot take away, so that it seldom meets the end of a window and a window's length decides nothing.
    """

    def __init__(self, window: int, edits: int, tables: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.n, self.steps = window + edits, max(2 * (window - edits), 1)
        odd = lambda shape: rng.integers(1, 2**63, size=shape, dtype=np.uint64) | np.uint64(1)
        self.salt, self.mix = odd((tables, self.steps)), odd((tables, self.steps))
        self.places = [frozenset(rng.choice(self.steps, size=min(bits, self.steps), replace=False).tolist()) for _ in range(tables)]

    def keys(self, windows: np.ndarray, table: int) -> np.ndarray:
        """Keys in one table of windows of ``n`` word numbers, padded with 0."""
        m = len(windows)
        padded = np.concatenate([windows, np.zeros((m, 1), np.uint64)], axis=1)
        at, row, out = np.zeros(m, dtype=np.int64), np.arange(m), np.full(m, table, dtype=np.uint64)
        for j in range(max(self.places[table]) + 1):
            w = padded[row, at] + np.uint64(1)
            if j in self.places[table]:
                h = w * self.mix[table, j]
                out = (out ^ h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            h = w * self.salt[table, j]
            at = np.minimum(at + ((h ^ (h << np.uint64(31))) >> np.uint64(63)).astype(np.int64), self.n)
        return out


def windows_of(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers from each start on, 0 beyond the end."""
    return np.concatenate([ids, np.zeros(n, np.uint64)])[starts[:, None] + np.arange(n)]


@lru_cache(maxsize=64)
def tables_for(window: int, edits: int, target_recall: float, bits: int, sample: int = 2000) -> int:
    """How many tables find a passage with ``edits`` random edits with probability ``target_recall``: measured on random words, edits and places.

    Substitutions, insertions and deletions are measured apart; the worst of them must reach the target.
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng(11)
    lost = []
    most, size = 512, window + edits
    walks = Walks(window, edits, most, bits)
    for kind in range(3):
        a = rng.integers(1, 2**63, size=(sample, window + 4 * edits), dtype=np.uint64)
        b = []
        for row in a:
            words_, places = row.tolist(), sorted(rng.choice(window, size=edits, replace=False), reverse=True)
            for p in places:
                words_[p : p + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 2**63))]
            b.append(words_[:size])
        lost.append((np.concatenate([a[:, :window], np.zeros((sample, edits), np.uint64)], axis=1), np.array(b, dtype=np.uint64), np.ones(sample, dtype=bool)))
    for t in range(most):
        for a, b, still in lost:
            still &= walks.keys(a, t) != walks.keys(b, t)
        if max(still.mean() for _, _, still in lost) <= 1 - target_recall:
            return t + 1
    raise ValueError(f"no {most} tables of {bits} places reach a recall of {target_recall} with {edits} edits of {window} words")


def passage_distances(items: np.ndarray, texts: np.ndarray, most: int) -> np.ndarray:
    """Least word edits between each item's window and a beginning of the text beside it, or most + 1 if there are more."""
    m, n = items.shape
    out = np.where((items == texts[:, :n]).all(axis=1), 0, most + 1)
    rest = np.flatnonzero(out) if most else np.zeros(0, np.int64)
    for part in np.array_split(rest, len(rest) // 50_000 + 1):
        x, y = items[part], texts[part]
        place = np.arange(y.shape[1] + 1, dtype=np.int16)
        row = np.broadcast_to(place, (len(part), len(place)))
        for i in range(n):
            new = np.empty(row.shape, np.int16)
            new[:, 0] = i + 1
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (x[:, i : i + 1] != y), out=new[:, 1:])
            # words of the text may be passed over one by one: the least over all places before, plus the way from there
            row = np.minimum.accumulate(new - place, axis=1) + place
        out[part] = np.minimum(row.min(axis=1), most + 1)
    return out


class Index:
    """The tables of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, edits: int, tables: int, bits: int):
        self.window, self.edits, self.walks = window, edits, Walks(window, edits, tables, bits)
        self.number = {w: word_hash(w) for _, ws in items for w in ws}
        wins, owner, pairs = [np.zeros((0, window), np.uint64)], [], [np.zeros(0, np.uint64)]
        for item, ws in items:
            ids = np.array([self.number[w] for w in ws], dtype=np.uint64)
            starts = np.arange(max(len(ids) - window + 1, 0))
            wins.append(windows_of(ids, starts, window))
            owner += [item] * len(starts)
            pairs.append(_pairs(ids))
        self.wins, self.owner, self.pairs = np.concatenate(wins), owner, np.unique(np.concatenate(pairs))
        padded = np.concatenate([self.wins, np.zeros((len(self.wins), edits), np.uint64)], axis=1)
        self.tables = []
        for t in range(tables):
            keys = self.walks.keys(padded, t)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The places of a text from which a passage can start: each edit takes at most one of an item's words and two of its pairs of words."""
        sure = self.window - self.edits
        if len(ids) < sure or not len(self.wins):
            return np.zeros(0, np.int64)
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        ok = strange[sure:] - strange[:-sure] <= self.edits
        if not ok.any() or sure < 2:
            return np.flatnonzero(ok)
        at = np.minimum(np.searchsorted(self.pairs, p := _pairs(ids)), len(self.pairs) - 1)
        odd = np.concatenate([[0], np.cumsum(self.pairs[at] != p)])
        return np.flatnonzero(ok & (odd[sure - 1 :] - odd[: len(odd) - sure + 1] <= 2 * self.edits))

    def found(self, text: str) -> dict[int, int]:
        """Items of which some window is within the edits of a stretch of ``text``, with the fewest edits."""
        ids = np.fromiter((self.number.get(w, 0) for w in words(text)), dtype=np.uint64)
        out: dict[int, int] = {}
        starts = self.starts(ids)
        for part in np.array_split(starts, len(starts) // 50_000 + 1):
            if not len(part):
                continue
            windows, hits = windows_of(ids, part, self.window + self.edits), []
            for t, (known, order) in enumerate(self.tables):
                keys = self.walks.keys(windows, t)
                lo = np.searchsorted(known, keys)
                n = np.searchsorted(known, keys, side="right") - lo
                at = np.repeat(np.arange(len(part)), n)
                hits.append(at * len(order) + order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(at))])
            at, c = np.divmod(np.unique(np.concatenate(hits)), len(self.wins))
            for i, e in zip(c, passage_distances(self.wins[c], windows[at], self.edits), strict=True):
                if e <= self.edits and e < out.get(self.owner[i], self.edits + 1):
                    out[self.owner[i]] = int(e)
        return out


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Numbers of neighbouring words."""
    return ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]


_FOUND = "doc_id bigint, item_id bigint, edits int"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def leaked_items(docs: DataFrame, items: DataFrame, window: int = 12, edits: int = 1, target_recall: float = 0.95, bits: int = 4, block_windows: int = 500_000) -> DataFrame:
    """``doc_id, item_id, edits``: documents that hold at least ``window`` consecutive words of an item, up to ``edits`` word edits (inserted, deleted or
    replaced words), with the fewest edits found.

    Passages without edits have equal walks and are always found; with edits they are found with probability ``target_recall``, from which
    and from ``bits``, the places of a walk that make a key, the number of tables follows (:func:`tables_for`).  Stretches with more unknown words or pairs of
    words than ``edits`` can make are passed over: they cannot match.  Items shorter than the window and null texts match nothing; a pair comes
    out once; null ids stay.  Whole texts are read.

    Items of at most ``block_windows`` windows go to every task, which keeps their tables for the next one, and the corpus is scanned once
    without a shuffle.  More items are matched by a join on the keys of both sides, whatever their number.
    """
    if not 0 <= edits < window:
        raise ValueError("edits must be fewer than the words of a window")
    spark, tables = docs.sparkSession, tables_for(window, edits, target_recall, bits)
    corpus = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = items.filter("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(max(len(words(t)) - window + 1, 0) for b in batches for t in b.column(0).to_pylist())], pa.int64())], ["n"])

    total = known.select("text").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    if total > block_windows:
        return _joined(corpus, known, window, edits, tables, bits)
    block = [(r.item_id, ws) for r in known.toLocalIterator() if len(ws := words(r.text)) >= window]
    shared = spark.sparkContext.broadcast({"items": block})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "index" not in held:  # a worker keeps what it was sent, so the index is made once in each
            held["index"] = Index(held["items"], window, edits, tables, bits)
        for b in batches:
            rows = [(d, i, e) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for i, e in held["index"].found(t).items()]
            if rows:
                yield _batch(rows, ["doc_id", "item_id", "edits"], [pa.int64(), pa.int64(), pa.int32()])

    return spread(corpus).mapInArrow(run, _FOUND).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _joined(corpus: DataFrame, items: DataFrame, window: int, edits: int, tables: int, bits: int) -> DataFrame:
    """:func:`leaked_items` by a join on the tables' keys; a key of very many windows is dealt to several tasks."""
    size = window + edits

    def keyed(side: DataFrame, own: str, is_item: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walks, memo = Walks(window, edits, tables, bits), {}
            for b in batches:
                for owner, text in zip(b.column(own).to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = np.fromiter((memo.get(w) or memo.setdefault(w, word_hash(w)) for w in words(text)), dtype=np.uint64)
                    if len(memo) > 1_000_000:
                        memo.clear()
                    least = window if is_item else window - edits
                    starts = np.arange(max(len(ids) - least + 1, 0))
                    for part in np.array_split(starts, len(starts) // 20_000 + 1):
                        wins = windows_of(ids, part, window if is_item else size)
                        padded = np.concatenate([wins, np.zeros((len(part), size - wins.shape[1]), np.uint64)], axis=1)
                        for t in range(tables if len(part) else 0):
                            offsets = np.arange(len(part) + 1, dtype=np.int32) * wins.shape[1]
                            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(wins.reshape(-1).view(np.int64)))
                            yield pa.RecordBatch.from_arrays([pa.array(walks.keys(padded, t).view(np.int64)), pa.array([owner] * len(part), pa.int64()), lists], ["key", own, f"{own}_words"])

        return materialize(spread(side).mapInArrow(run, f"key bigint, {own} bigint, {own}_words array<bigint>"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts, wins = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("doc_id_words", "item_id_words"))
            e = passage_distances(wins, texts, edits)
            take = np.flatnonzero(e <= edits)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(take)), b.column("item_id").take(pa.array(take)), pa.array(e[take].astype(np.int32))], ["doc_id", "item_id", "edits"])

    item_keys = keyed(items, "item_id", True)
    probes = keyed(corpus, "doc_id", False).join(item_keys.select("key").distinct(), "key", "left_semi")
    return join_pairs(probes, item_keys, ["key"]).mapInArrow(verify, _FOUND).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
