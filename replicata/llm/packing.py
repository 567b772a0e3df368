"""Problem 6: containers of fixed capacity filled with items of varying length, by best-two-fit.

A bin is filled greedily with the largest item that fits; then its smallest item gives way to two unpacked ones that fit the
widened gap more tightly.  Items are dealt to groups by hash, so that groups are packed independently.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicata.plans.storage import materialize, spread

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def _encoder(folder: str, name: str):
    path = os.path.join(folder, name)
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(docs: DataFrame, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, n_tokens`` of every non-null text, in tokens of a public byte-level vocabulary; the empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(folder, name)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return spread(docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


class Stock:
    """Unpacked items by size: the largest that fits, and the best pair for a gap."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")
        self.items = order
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.sizes = np.flatnonzero(self.count)
        self.left = len(sizes)

    def largest(self, room: int) -> int:
        """The largest size of an unpacked item that is at most ``room``, or -1."""
        i = int(np.searchsorted(self.sizes, room, side="right")) - 1
        return int(self.sizes[i]) if i >= 0 else -1

    def take(self, size: int) -> int:
        self.count[size] -= 1
        self.left -= 1
        if not self.count[size]:
            self.sizes = np.delete(self.sizes, np.searchsorted(self.sizes, size))
        return int(self.items[self.first[size] + self.count[size]])

    def give_back(self, size: int, item: int) -> None:
        self.items[self.first[size] + self.count[size]] = item
        if not self.count[size]:
            self.sizes = np.insert(self.sizes, np.searchsorted(self.sizes, size), size)
        self.count[size] += 1
        self.left += 1

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """Sizes of two unpacked items with the largest sum that is at most ``room``."""
        s = self.sizes[self.sizes > 0]
        a = s[: np.searchsorted(s, room // 2, side="right")]
        if not len(a):
            return None
        at = np.searchsorted(s, room - a, side="right") - 1
        b = s[at]
        alone = (b == a) & (self.count[a] < 2)
        b = np.where(alone & (at > 0), s[np.maximum(at - 1, 0)], np.where(alone, -a, b))
        total = a + b
        i = int(np.argmax(total))
        return (int(a[i]), int(b[i])) if total[i] > 0 else None


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes are at most ``capacity``.  Items of size 0 go into the first bin."""
    stock, bins, n = Stock(sizes, capacity), np.zeros(len(sizes), dtype=np.int64), 0
    while stock.left:
        room, packed = capacity, []
        while stock.left and (s := stock.largest(room)) >= 0:
            packed.append((s, stock.take(s)))
            room -= s
        while room and stock.left and packed:
            smallest = min(packed)
            pair = stock.best_pair(room + smallest[0])
            if pair is None or sum(pair) <= smallest[0]:
                break
            packed.remove(smallest)
            packed += [(s, stock.take(s)) for s in pair]
            stock.give_back(*smallest)
            room += smallest[0] - sum(pair)
        for _, item in packed:
            bins[item] = n
        n += 1
    return bins


_PACKED = "target_id int, doc_id bigint, chunk bigint, container string, start bigint, n_tokens bigint"


def pack(items: DataFrame, targets: DataFrame, group_items: int = 20_000) -> DataFrame:
    """Every item in containers of each target's capacity: one row per piece of an item.

    ``items``: ``doc_id, n_tokens``; ``targets``: ``target_id, capacity_tokens`` (null or non-positive capacities are left out).  An item
    is cut only if it exceeds the capacity itself: into pieces of full capacity, each a container of its own, and a rest that is packed
    like an item.  ``start`` is the piece's first token in its item.  Containers are named by target, group and number.

    Items are dealt by hash to groups of about ``group_items`` (a task's unit: identifiers and sizes only); a group leaves at most a few
    containers ill-filled, so the loss does not grow with the data.
    """
    items = materialize(items.filter("n_tokens is not null").select("doc_id", "n_tokens"))
    groups = max(1, -(-items.count() // group_items))
    # The targets are a short list of sizes: literals, of which every item gets each.
    sizes = [F.struct(F.lit(r.target_id).cast("int").alias("target_id"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity")) for r in targets.filter("capacity_tokens > 0").select("target_id", "capacity_tokens").toLocalIterator()]
    if not sizes:
        return items.sparkSession.createDataFrame([], _PACKED)
    dealt = items.select("*", F.inline(F.array(*sizes))).withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        target, grp = key
        cap = int(d["capacity"].iloc[0])
        d = d.sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
        size, doc = d["n_tokens"].to_numpy(), d["doc_id"].to_numpy()
        whole = np.where(size > cap, size // cap, 0)
        rest = size - whole * cap
        keep = (whole == 0) | (rest > 0)
        bins = best_two_fit(rest[keep], cap)
        name = lambda kind, n: [f"{target}-{grp}-{kind}{i}" for i in n]
        out = [pd.DataFrame({"doc_id": doc[keep], "chunk": whole[keep], "container": name("", bins), "start": whole[keep] * cap, "n_tokens": rest[keep]})]
        if whole.any():
            owner = np.repeat(np.arange(len(size)), whole)
            chunk = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
            out.append(pd.DataFrame({"doc_id": doc[owner], "chunk": chunk, "container": name("f", range(len(owner))), "start": chunk * cap, "n_tokens": cap}))
        return pd.concat(out).assign(target_id=target)[["target_id", "doc_id", "chunk", "container", "start", "n_tokens"]]

    return dealt.groupBy("target_id", "grp").applyInPandas(run, _PACKED)


def fill(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space left over, per target."""
    used = packed.groupBy("target_id", "container").agg(F.sum("n_tokens").alias("used")).groupBy("target_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return used.join(targets.select("target_id", "target_name", "capacity_tokens"), "target_id").withColumn("left_over", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
