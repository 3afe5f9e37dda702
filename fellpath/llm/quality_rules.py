"""Quality rules: plain counts of a text, and how often its lines recur on its host.

A line is normalised (lower case, runs of white space as one blank, every digit
as 0) and hashed to 64 bits. Per host, every distinct text counts each of its
lines once, so that copies of a text and repeats within it add nothing. Lines
in more distinct texts of their host than its limit, ``MIN_TEXTS`` or the share
``SHARE`` of all its distinct texts, whichever is larger, are boilerplate and are
removed. A text is depleted, and rejected, if fewer than ``MIN_WORDS`` words or
less than the share ``LEFT`` of its words remain.

Base rules come first: fewer than ``MIN_WORDS`` words, or over 30 in 100 words in
windows of eight words that occur twice or more.

Both passes go over whole texts in blocks. Line hashes of copies collapse in
the map-side part of the first aggregation, those of one line in that of the
second: neither a host nor a line is ever gathered in one task. Lines over the
limit are broadcast up to ``BROADCAST_LINES`` and joined by shuffle beyond.

Defined results: null text counts as empty and fails the base rules; a null
host is a host of its own; repeated rows give repeated results; other columns
are kept by ``apply`` and not touched by ``measure``; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellpath.llm import _words
from fellpath.llm._tables import materialise

MIN_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
MIN_TEXTS, SHARE, LEFT = 5, 0.1, 0.5
SYMBOLS = "#*$%&|<>"
#: Pairs of host and line (16 bytes each) that are broadcast at most.
BROADCAST_LINES = 2_000_000

_SPACES = " \t\n\x0b\x0c\r"
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normalised(line: str) -> str:
    return _DIGIT.sub("0", " ".join(_WORD.findall(line.lower())))


def line_hashes(lines: list[str]) -> np.ndarray:
    """64-bit hashes of normalised lines; 0 for lines without a word."""
    plain = [normalised(x) for x in lines]
    if not plain:
        return np.zeros(0, np.int64)
    found = pd.util.hash_array(np.array(plain, object), categorize=False).view(np.int64)
    found[[not x for x in plain]] = 0
    return found


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    if len(hashes) <= width:
        return 0
    n = len(hashes) - width + 1
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows = _words.mix64(windows + hashes[k : k + n] * np.uint64(2 * k + 1))
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    if not again.any():
        return 0
    step = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def _words_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text as they stand, letter case told apart."""
    held, size = [], 0
    for i in range(len(texts) + 1):
        raw = texts[i].encode("utf-8", "surrogatepass") if i < len(texts) else b""
        if held and (i == len(texts) or size + len(raw) > _words.BLOCK_BYTES):
            hashes, offsets = _words.hash_words(held)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield hashes[a:b]
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def _host(host: str) -> Column:
    """A key of the host; null is told apart from every string."""
    return F.xxhash64(F.col(host).isNull(), F.col(host).cast("string"))


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", *, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """Rows (host, line): hashes of the lines over the limit of their host."""
    body = F.col(text).cast("string")
    rows = docs.where(body.isNotNull()).select(_host(host).alias("host"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), body.alias("__text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [t.split("\n") for t in batch["__text"]]
            hashes = line_hashes([x for own in lines for x in own])
            ends = np.cumsum([len(own) for own in lines])
            out = batch.drop(columns="__text")
            out["lines"] = [np.setdiff1d(hashes[e - len(own) : e], [0]) for own, e in zip(lines, ends, strict=True)]
            yield out

    each = rows.mapInPandas(scan, "host long, k1 long, k2 long, lines array<long>")
    texts = materialise(each.groupBy("host", "k1", "k2").agg(F.first("lines").alias("lines")), "distinct-lines")
    limits = texts.groupBy("host").agg(F.greatest(F.lit(float(min_texts)), F.count("*") * share).alias("limit"))
    counted = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_texts)
    return counted.join(limits, "host").where("n > limit").select("host", "line")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", *, keep: list[str] | None = None, **limits: float) -> DataFrame:
    """Per row: ``doc_id``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, words_left, cleaned text, base_failed and kept."""
    spark = docs.sparkSession
    frequent = materialise(frequent_lines(docs, host, text, **limits), "frequent-lines")
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("__id"), _host(host).alias("__host"), F.coalesce(body, F.lit("")).alias("__text"), F.struct(*(F.col(c) for c in keep or [doc_id])).alias("__kept"))
    few = frequent.count() <= BROADCAST_LINES
    if few:
        table = frequent.toPandas()
        pairs = {int(h): np.sort(own.to_numpy(np.int64)) for h, own in table.groupby("host")["line"]}
        known = spark.sparkContext.broadcast(pairs)
    else:
        # Lines of a text that are over the limit, gathered by the text's row: bounded by its length.
        rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
        hits = _row_lines(rows).join(frequent, ["host", "line"]).groupBy("__row").agg(F.collect_list("line").alias("__over"))
        rows = rows.join(hits, "__row", "left").drop("__row")

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, words_left long, cleaned string")
    def judge(texts: pd.Series, hosts: pd.Series, over: pd.Series) -> pd.DataFrame:
        bodies = texts.tolist()
        out = []
        for i, (body, words) in enumerate(zip(bodies, _words_of(bodies), strict=True)):
            lines = body.split("\n")
            wanted = known.value.get(int(hosts.iloc[i]), ()) if few else (over.iloc[i] if over.iloc[i] is not None else ())
            left, cleaned = len(words), body
            if len(wanted):
                gone = np.isin(line_hashes(lines), wanted)
                if gone.any():
                    left -= sum(len(_WORD.findall(x)) for x, out_ in zip(lines, gone, strict=True) if out_)
                    cleaned = "\n".join(x for x, out_ in zip(lines, gone, strict=True) if not out_)
            out.append((len(words), len(body) - sum(map(body.count, _SPACES)), sum(map(body.count, SYMBOLS)), duplicate_lines(body), repeated_words(words), left, cleaned))
        return pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", "cleaned"])

    over = F.lit(None).cast("array<long>") if few else F.col("__over")
    judged = rows.select("__id", "__kept", judge("__text", "__host", over).alias("m")).select("__id", "__kept", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    depleted = (F.col("words_left") < MIN_WORDS) | (F.col("words_left") < LEFT * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    return judged if keep else judged.drop("__kept").withColumnRenamed("__id", doc_id)


def _row_lines(rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [np.unique(line_hashes(t.split("\n"))) for t in batch["__text"]]
            yield pd.DataFrame({"__row": batch["__row"], "host": batch["__host"], "lines": lines})

    found = rows.select("__row", "__host", "__text").mapInPandas(scan, "__row long, host long, lines array<long>")
    return found.select("__row", "host", F.explode("lines").alias("line"))


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, frequent lines taken out of ``text``."""
    judged = measure(docs, doc_id, text, host, keep=docs.columns, **limits).where("kept")
    return judged.select(*(F.col("cleaned").alias(c) if c == text else F.col("__kept")[c].alias(c) for c in docs.columns))
