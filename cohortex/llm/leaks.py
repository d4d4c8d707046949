"""Evaluation texts inside a corpus: seeds by join, matches by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.llm.text import Rolling, WordHashes, word_hash, words
from cohortex.staging import stage

#: Up to this many item windows the seeds are sent to the tasks (8 bytes each); beyond, they are joined by a shuffle.
SENT_SEEDS = 2_000_000

#: Texts whose word hashes a task keeps while it compares pairs.
KEPT_TEXTS = 64


def item_seeds(items: DataFrame, item: str, text: str, seed: int) -> DataFrame:
    """``item_id, seed, at, size``: every window of ``seed`` words of every item, its place, and the item's number of words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for i, t in zip(batch["i"], batch["t"]):
                v = np.array(hashes.of(t), np.uint64)
                h = Rolling(v).windows(seed).view(np.int64)
                out.append(pd.DataFrame({"item_id": i, "seed": h, "at": np.arange(len(h), dtype=np.int32), "size": np.int32(len(v))}))
            if out:
                yield pd.concat(out)

    return items.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").mapInPandas(cut, "item_id long, seed long, at int, size int")


def corpus_hits(docs: DataFrame, doc: str, text: str, seed: int, wanted: np.ndarray | None, vocabulary: frozenset[int] | None) -> DataFrame:
    """``doc_id, seeds``: the distinct window hashes of every document, only the ``wanted`` ones where given.

    With a vocabulary, a window that holds a word of no item is never hashed.
    Whole texts; a batch of documents is hashed as one sequence with a 0 after
    each document, which no window may span.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(vocabulary)
        for batch in batches:
            parts, owner = [], []
            for k, t in enumerate(batch["t"]):
                v = hashes.of(t)
                parts += v
                parts.append(0)
                owner.append(len(v) + 1)
            v = np.array(parts, np.uint64)
            if len(v) < seed:
                continue
            zeros = np.concatenate(([0], np.cumsum(v == 0)))
            start = np.flatnonzero(zeros[seed:] == zeros[:-seed])
            if not len(start):
                continue
            with np.errstate(over="ignore"):
                h, p = np.zeros(len(start), np.uint64), np.uint64(1)
                for j in range(seed):
                    h += v[start + j] * p
                    p *= np.uint64(0x9E3779B97F4A7C15)
            if wanted is not None:
                at = np.searchsorted(wanted, h)
                hit = wanted[np.minimum(at, len(wanted) - 1)] == h
                h, start = h[hit], start[hit]
            d = np.repeat(np.arange(len(owner)), owner)[start]
            out = pd.DataFrame({"k": d, "seed": h.view(np.int64)}).drop_duplicates().groupby("k")["seed"].apply(list)
            if len(out):
                yield pd.DataFrame({"doc_id": batch["d"].to_numpy()[out.index], "seeds": out.to_numpy()})

    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t <> ''").mapInPandas(scan, "doc_id long, seeds array<long>")


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (place in a, place in b, length), longest first.

    Each round finds the longest run of unmarked words common to both (running
    Karp-Rabin: does a common window of this length exist is decided by
    hashes, the length by bisection), marks every non-overlapping occurrence of
    that length from the left, and goes on until none of ``least`` is left.
    Matches are compared word by word before they are marked.
    """
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    ra, rb = Rolling(a), Rolling(b)
    out, longest = [], min(len(a), len(b))

    def common(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok_a = np.flatnonzero(np.convolve(~free_a, np.ones(k, np.int32), "valid") == 0)
        ok_b = np.flatnonzero(np.convolve(~free_b, np.ones(k, np.int32), "valid") == 0)
        ha, hb = ra.windows(k)[ok_a], rb.windows(k)[ok_b]
        return ok_a[np.isin(ha, hb)], ok_b, hb

    while longest >= least:
        lo, hi, best = least, longest, None
        got = common(lo)
        if not len(got[0]):
            break
        best = lo, got
        lo += 1
        while lo <= hi:
            mid = (lo + hi + 1) // 2 if hi - lo > 1 else lo
            got = common(mid)
            if len(got[0]):
                best, lo = (mid, got), mid + 1
            else:
                hi = mid - 1
        k, (at_a, ok_b, hb) = best
        order, ha = np.argsort(hb, kind="stable"), ra.windows(k)
        hs, marked = hb[order], 0
        for i in at_a:
            if not free_a[i : i + k].all():
                continue
            for j in ok_b[order[np.searchsorted(hs, ha[i], "left") : np.searchsorted(hs, ha[i], "right")]]:
                if free_b[j : j + k].all() and np.array_equal(a[i : i + k], b[j : j + k]):
                    free_a[i : i + k] = free_b[j : j + k] = False
                    out.append((int(i), int(j), int(k)))
                    marked += 1
                    break
        longest = k if marked else k - 1
    return out


def leaked_items(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, seed: int = 12, tile: int = 12, coverage: float = 0.0, run: int = 12) -> DataFrame:
    """Pairs of document and item that share passages: ``doc_id, item_id, coverage, longest, tiles``.

    A pair comes out if its longest tile has ``run`` words or more, or if tiles
    of at least ``tile`` words cover at least ``coverage`` (> 0) of the item's
    words, in whatever order they stand.  Words are compared without case,
    accents, punctuation, spacing and markup.

    1. All windows of ``seed`` words of the items are hashed; documents are
       scanned once for them and give the distinct seeds they hold.
    2. Seeds are joined with the items.  A pair goes on only if the seeds shared
       could make up a run or the coverage; both are necessary conditions
       (seed <= tile <= run), so nothing is lost.
    3. Each remaining pair is tiled on its own, from whole texts.

    Null and empty texts, and items or documents shorter than a seed, match
    nothing.  Repeated items and documents are reported each under its own id;
    rows that share an id are one document (or item) with several texts.
    """
    if not seed <= tile <= run:
        raise ValueError("seed <= tile <= run is needed")
    spark = docs.sparkSession
    seeds = stage(item_seeds(items, item, item_text, seed), "item-seeds")
    n = seeds.count()
    if n == 0:
        return spark.createDataFrame([], "doc_id long, item_id long, coverage double, longest int, tiles int")
    if n <= SENT_SEEDS:
        wanted = np.unique(np.array([r[0] for r in seeds.select("seed").distinct().collect()], np.int64).view(np.uint64))
        vocab = items.select(F.col(item_text).alias("t")).where("t is not null").mapInPandas(_vocabulary(seed), "h long").distinct()  # at most seed words a window
        hits = stage(corpus_hits(docs, doc, text, seed, wanted, frozenset(r[0] % (1 << 64) for r in vocab.collect())), "hits")
    else:
        hits = stage(corpus_hits(docs, doc, text, seed, None, None), "hits")
    shared = hits.select("doc_id", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("shared"), F.max("size").alias("size"))
    enough = F.lit(run - seed + 1) if coverage <= 0 else F.least(F.lit(run - seed + 1), F.ceil(F.col("size") * coverage / seed))
    pairs = stage(shared.where(F.col("shared") >= enough).select("doc_id", "item_id"), "pairs")
    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("t")).where("t <> ''")
    near = pairs.select("doc_id").distinct()
    near = F.broadcast(near) if near.count() <= 200_000 else near
    some = stage(texts.join(near, "doc_id", "left_semi"), "near")  # only texts of pairs; the corpus itself is not shuffled
    item_texts = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("it")).where("it is not null")
    both = pairs.join(some, "doc_id").join(item_texts, "item_id")

    def tile_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        known: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            """A text's word hashes; the texts met last are kept, since a document meets all its items one after another."""
            if t not in known:
                if len(known) >= KEPT_TEXTS:
                    del known[next(iter(known))]
                known[t] = np.array(hashes.of(t), np.uint64)
            return known[t]

        for batch in batches:
            out = []
            for d, i, t, it in batch[["doc_id", "item_id", "t", "it"]].itertuples(index=False):
                a, b = of(t), of(it)
                got = tiles(np.where(np.isin(a, b), a, np.uint64(0)), b, tile)
                longest = max((k for _, _, k in got), default=0)
                cover = sum(k for _, _, k in got) / max(1, len(b))
                if longest >= run or coverage > 0 and cover >= coverage:
                    out.append((d, i, cover, longest, len(got)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage", "longest", "tiles"])

    found = both.mapInPandas(tile_pairs, "doc_id long, item_id long, coverage double, longest int, tiles int")
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("longest").alias("longest"), F.max("tiles").alias("tiles"))


def _vocabulary(seed: int):
    """Hashes of the words of all items that have a window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {word_hash(w) for t in batch["t"] for ws in (words(t),) if len(ws) >= seed for w in ws}
            yield pd.DataFrame({"h": np.array(sorted(found), np.uint64).view(np.int64)})

    return run
