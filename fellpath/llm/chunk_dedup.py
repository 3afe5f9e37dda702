"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 characters has its upper four
bits clear, at least ``MIN_CHARS`` after the previous end; where no such place
comes within ``MAX_CHARS``, as in periodic text, it ends at the smallest hash on
the way. Ends depend on the text around them only, so an insertion moves the
chunks beside it and no others. Chunks are compared by a 128-bit digest;
one whose digest also occurs in another document is shared. Neighbouring shared
chunks form runs, and runs of at least ``MIN_WORDS`` words count. A run is split
to regions where the first holder (smallest id) of its chunks changes: that
document holds all of the region and keeps it, the others may drop it, so of
every shared chunk one holder is never told to drop it.

Counting is summed on the map side, so a passage that a third of all documents
hold meets in one row. The shared digests are written, so that marking their
occurrences is a plain join of two scans, with one row for each digest on one
side, which adaptive execution splits where a digest is hot.

Defined results: null or empty text has no chunk; chunks that repeat only
within one document are not shared; rows with equal ids are one document; a
null id takes no part; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise

MIN_CHARS, MAX_CHARS = 16, 128
MIN_WORDS = 20

_GEAR = np.random.RandomState(611953).randint(0, 1 << 16, 256).astype(np.uint16)
_CUT = np.uint16(0xF000)


def _ends(text: str) -> list[int]:
    """Ends of the chunks of ``text``."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _GEAR[((cps ^ (cps >> np.uint32(8))) & np.uint32(0xFF)).astype(np.uint8)]
    for k in (1, 2, 4, 8):  # after these steps h holds the gear sum of 16 characters
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint16(k)
        h = nxt
    n, ends, last = len(text), [], 0
    for at in [*(np.flatnonzero((h & _CUT) == 0) + 1).tolist(), n]:
        while at - last > MAX_CHARS:
            last += MIN_CHARS + int(h[last + MIN_CHARS - 1 : last + MAX_CHARS].argmin())
            ends.append(last)
        if at - last >= MIN_CHARS or at == n > last:
            ends.append(at)
            last = at
    return ends


def chunks(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of all chunks of a text, in code points."""
    if not text:
        return []
    ends = _ends(text)
    return list(zip([0, *ends[:-1]], ends, strict=True))


def chunk_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (h1, h2, id, place) of all chunks; place: start, then 8 bits each for
    length and words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, starts, ends, words, raw = [], [], [], [], []
            for key, body in zip(batch["id"], batch["text"], strict=True):
                if not isinstance(body, str):
                    continue
                spans = chunks(body)
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
                ids.append(np.full(len(spans), key, np.int64))
                for s, e in spans:
                    part = body[s:e].encode("utf-8", "surrogatepass")
                    words.append(part.count(b" ") + part.count(b"\n"))
                    raw.append(hashlib.blake2b(part, digest_size=16).digest())
                if len(raw) > 200_000:
                    yield _rows(ids, starts, ends, words, raw)
                    ids, starts, ends, words, raw = [], [], [], [], []
            if raw:
                yield _rows(ids, starts, ends, words, raw)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    return rows.mapInPandas(cut, "h1 long, h2 long, id long, place long")


def _rows(ids: list, starts: list, ends: list, words: list, raw: list) -> pd.DataFrame:
    digest = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
    start, end = np.array(starts, np.int64), np.array(ends, np.int64)
    place = start << 16 | (end - start) << 8 | np.array(words, np.int64)
    return pd.DataFrame({"h1": digest[:, 0], "h2": digest[:, 1], "id": np.concatenate(ids), "place": place})


def shared_regions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per region that other documents share: ``doc_id``, ``start``,
    ``end`` (code points), ``n_chunks``, ``words``, ``first_doc_id`` (smallest
    holder of each of its chunks) and ``kept`` (whether this document is it).
    ``min_words`` holds for the run of neighbouring regions, not for each."""
    rows = chunk_table(docs, doc_id, text)
    holders = rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h1", "h2", "first")
    holders = materialise(holders, "shared-chunks")
    marked = rows.join(holders, ["h1", "h2"]).repartition("id")
    start, length = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    marked = marked.select("id", start.alias("start"), (start + length).alias("end"), F.col("place").bitwiseAND(F.lit(255)).alias("words"), "first").distinct()
    order = Window.partitionBy("id").orderBy("start", "end")
    touches = F.lag("end").over(order) == F.col("start")
    run = F.sum(F.when(touches, 0).otherwise(1)).over(order)
    part = F.sum(F.when(touches & (F.lag("first").over(order) == F.col("first")), 0).otherwise(1)).over(order)
    regions = marked.withColumns({"run": run, "part": part}).groupBy("id", "run", "part", "first").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.sum("words").alias("words"))
    regions = regions.withColumn("run_words", F.sum("words").over(Window.partitionBy("id", "run"))).where(F.col("run_words") >= min_words)
    return regions.select(F.col("id").alias(doc_id), "start", "end", "n_chunks", "words", F.col("first").alias("first_doc_id"), (F.col("first") == F.col("id")).alias("kept"))
