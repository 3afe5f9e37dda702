"""URL filter by a ratio of two character language models.

Rules (host and path prefix) decide the URLs they fit. The URLs that rules
accept and reject are the samples of two variable-order Markov models over
characters: each context backs off to a shorter one as far as it is rare, by
interpolation with the lower order (Witten-Bell smoothing), from order 5 down
to the uniform distribution. Contexts are keyed by their own characters and counted
over all ruled URLs. Of each order the most frequent ones, ``CONTEXTS`` at most, are
sent to all tasks; the rest stay a table, and where there is one, URLs are joined to
it by the contexts that were not sent. Scores are the same wherever a context lies.

A URL's score is the difference of its two log-likelihoods over its length. The
threshold is calibrated on a quarter of the ruled URLs that the models do not
see: it maximises balanced accuracy there, among all scores that occur (the middle
between the lowest best one and the score below it). All ruled URLs are counted.

Defined results: a null URL or one without ``://`` has empty host and path, and
scores by its characters like any other; a null or empty URL scores 0 and is
blocked; where rules leave one side without samples the threshold is 0; labels
of repeated URLs count as often as they occur; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise

ORDER = 5
#: Contexts of each order and verdict that are sent to all tasks, at most 64 cells each; the rest are joined.
CONTEXTS = 65_536
#: Of the ruled URLs, one in so many calibrates and is not learned from.
CALIBRATE_ONE_IN = 4
#: The histogram of scores that tells in which bins the best threshold can lie.
BINS, RANGE = 4001, 4.0
BLOCK_CHARS = 300_000

#: Fixed symbols: letters, digits and the punctuation of URLs; others share one.
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
_OTHER, _START, _ALPHABET = 60, 61, 64
_TABLE = np.full(256, _OTHER, np.uint8)
for _k, _c in enumerate(_SYMBOLS):
    _TABLE[ord(_c)] = _k
for _k in range(26):
    _TABLE[ord("A") + _k] = _k


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, rule: str) -> Rule:
    host, slash, path = rule.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (its text) and its verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _symbols(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all URLs, each after ``ORDER`` start symbols, and their lengths."""
    raw = [u.encode("utf-8", "surrogatepass") if isinstance(u, str) else b"" for u in urls]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = _TABLE[np.frombuffer((b"\0" * ORDER).join([b"", *raw]), np.uint8)] if raw else np.zeros(0, np.uint8)
    begin = np.cumsum(lengths + ORDER) - lengths
    start = np.zeros(len(data), bool)
    for k in range(1, ORDER + 1):
        start[begin - k] = True
    data[start] = _START
    return data, lengths


def _contexts(data: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` symbols before every position from ORDER on, as one number."""
    n = len(data) - ORDER
    context = np.zeros(max(n, 0), np.int64)
    for k in range(order, 0, -1):
        context = context * _ALPHABET + data[ORDER - k : ORDER - k + n]
    return context


def _blocks(urls: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, u in enumerate(urls):
        size += len(u) if isinstance(u, str) else 0
        if size > BLOCK_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(urls):
        yield first, len(urls)


class MarkovModel:
    """Interpolated log-probabilities: by order the sorted contexts with their totals
    and kinds of symbols, and the sorted (context, symbol) cells with their counts."""

    def __init__(self, cells: list[tuple[np.ndarray, np.ndarray]]):
        self.cells, self.counts, self.contexts, self.total, self.kinds = [], [], [], [], []
        for keys, n in cells:
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            contexts, first = np.unique(keys // _ALPHABET, return_index=True)
            self.cells.append(keys)
            self.counts.append(n.astype(np.float32))
            self.contexts.append(contexts)
            self.total.append(np.add.reduceat(n, first).astype(np.float32) if len(n) else np.zeros(0, np.float32))
            self.kinds.append(np.diff(np.append(first, len(keys))).astype(np.float32))

    def holds(self, order: int, context: np.ndarray) -> np.ndarray:
        known = self.contexts[order]
        return known[np.minimum(np.searchsorted(known, context), len(known) - 1)] == context if len(known) else np.zeros(len(context), bool)

    def log_prob(self, data: np.ndarray, rest: dict[int, tuple[np.ndarray, ...]] | None = None) -> np.ndarray:
        """Of every position from ORDER on; ``rest`` holds by order the positions whose
        contexts lie elsewhere, with their counts, totals and kinds."""
        p = np.full(max(len(data) - ORDER, 0), 1.0 / _ALPHABET, np.float64)
        for order in range(ORDER + 1):
            if len(self.contexts[order]):
                context = _contexts(data, order)
                at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
                seen = np.flatnonzero(self.contexts[order][at] == context)
                at, cell = at[seen], context[seen] * _ALPHABET + data[ORDER:][seen]
                place = np.minimum(np.searchsorted(self.cells[order], cell), len(self.cells[order]) - 1)
                count = np.where(self.cells[order][place] == cell, self.counts[order][place], 0)
                p[seen] = (count + self.kinds[order][at] * p[seen]) / (self.total[order][at] + self.kinds[order][at])
            if rest and order in rest:
                where, count, total, kinds = rest[order]
                p[where] = (count + kinds * p[where]) / (total + kinds)
        return np.log(p)


def _context() -> Column:
    return F.floor(F.col("cell") / _ALPHABET)


def _counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (verdict, ord, cell, n) of all ``rows`` (verdict, url), and the contexts (verdict, ord, context) to be sent."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for verdict, part in batch.groupby("verdict", sort=False)["url"]:
                urls = part.tolist()
                for a, b in _blocks(urls):
                    data, _ = _symbols(urls[a:b])
                    real = data[ORDER:] != _START
                    for order in range(ORDER + 1):
                        cells, n = np.unique((_contexts(data, order) * _ALPHABET + data[ORDER:])[real], return_counts=True)
                        yield pd.DataFrame({"verdict": verdict, "ord": np.int32(order), "cell": cells, "n": n.astype(np.int64)})

    found = materialise(rows.mapInPandas(count, "verdict string, ord int, cell long, n long").groupBy("verdict", "ord", "cell").agg(F.sum("n").alias("n")), "url-cells")
    totals = found.groupBy("verdict", "ord", _context().alias("context")).agg(F.sum("n").alias("total"))
    # Totals are few, whatever the number of contexts: those above the least that leaves no more than CONTEXTS are sent.
    held = F.sum("count").over(Window.partitionBy("verdict", "ord").orderBy(F.desc("total")))
    least = totals.groupBy("verdict", "ord", "total").count().withColumn("held", held).where(F.col("held") <= CONTEXTS).groupBy("verdict", "ord").agg(F.min("total").alias("least"))
    return found, materialise(totals.join(F.broadcast(least), ["verdict", "ord"]).where("total >= least").select("verdict", "ord", "context"), "url-contexts")


def _rest(found: DataFrame, sent: DataFrame) -> DataFrame | None:
    """(verdict, ord, context, total, kinds, seen) of the contexts that are not sent, with the counts of their symbols."""
    cells = found.withColumn("context", _context()).join(sent, ["verdict", "ord", "context"], "left_anti")
    symbol = F.struct((F.col("cell") % _ALPHABET).cast("int").alias("symbol"), "n")
    rest = materialise(cells.groupBy("verdict", "ord", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.map_from_entries(F.collect_list(symbol)).alias("seen")), "url-rest")
    return None if rest.isEmpty() else rest


def _fit(rows: DataFrame) -> dict[str, MarkovModel]:
    """Models by verdict of ``rows`` (verdict, url), of the contexts that are sent."""
    return _models(*_counted(rows))


def _models(found: DataFrame, sent: DataFrame) -> dict[str, MarkovModel]:
    cells = found.withColumn("context", _context()).join(sent, ["verdict", "ord", "context"], "left_semi").select("verdict", "ord", "cell", "n").toPandas()
    models = {}
    for verdict, own in cells.groupby("verdict"):
        parts = [own[own["ord"] == order] for order in range(ORDER + 1)]
        models[str(verdict)] = MarkovModel([(x["cell"].to_numpy(np.int64), x["n"].to_numpy(np.int64)) for x in parts])
    return models


def _spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each URL of a block begins and ends among the positions from ORDER on."""
    end = np.cumsum(lengths + ORDER) - ORDER
    return end - lengths, end


def _score_column(models: dict[str, MarkovModel], url: Column, spark, hits: Column | None = None) -> Column:  # noqa: ANN001
    shared = spark.sparkContext.broadcast(models)

    def scores(urls: pd.Series, hits: pd.Series | None) -> pd.Series:
        both, out = shared.value, np.zeros(len(urls))
        if "allow" in both and "block" in both:
            texts = urls.tolist()
            for a, b in _blocks(texts):
                data, lengths = _symbols(texts[a:b])
                if len(data) > ORDER:
                    begin, end = _spans(lengths)
                    rest: dict[str, dict] = {"allow": {}, "block": {}}
                    if hits is not None:
                        found = pd.DataFrame([(h["verdict"], h["ord"], begin[i] + h["at"], h["n"], h["total"], h["kinds"]) for i, x in enumerate(hits.iloc[a:b]) if x is not None for h in x], columns=["verdict", "ord", "at", "n", "total", "kinds"])
                        for (verdict, order), x in found.groupby(["verdict", "ord"]):
                            rest[verdict][order] = (x["at"].to_numpy(np.int64), *(x[c].to_numpy(np.float32) for c in ("n", "total", "kinds")))
                    gain = both["allow"].log_prob(data, rest["allow"]) - both["block"].log_prob(data, rest["block"])
                    gain[data[ORDER:] == _START] = 0
                    running = np.concatenate((np.zeros(1), np.cumsum(gain)))
                    out[a:b] = (running[end] - running[begin]) / np.maximum(lengths, 1)
        return pd.Series(out)

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        return scores(urls, None)

    @F.pandas_udf("double")
    def score_with(urls: pd.Series, hits: pd.Series) -> pd.Series:
        return scores(urls, hits)

    return score(url) if hits is None else score_with(url, hits)


def _scored(rows: DataFrame, url: Column, models: dict[str, MarkovModel], rest: DataFrame | None) -> DataFrame:
    """``rows`` with ``__score`` of their ``url``.

    Where contexts lie in ``rest``, each distinct URL looks up there those of its contexts
    that were not sent, and is scored with what it finds."""
    spark = rows.sparkSession
    if rest is None or len(models) < 2:
        return rows.withColumn("__score", _score_column(models, url, spark))
    texts = materialise(rows.select(url.alias("__text")).where("__text <> ''").distinct().withColumn("id", F.monotonically_increasing_id()), "urls")
    shared = spark.sparkContext.broadcast(models)

    def unknown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            urls, ids = batch["__text"].tolist(), batch["id"].to_numpy()
            for a, b in _blocks(urls):
                data, lengths = _symbols(urls[a:b])
                begin, _ = _spans(lengths)
                for order in range(ORDER + 1):
                    context = _contexts(data, order)
                    for verdict, model in shared.value.items():
                        at = np.flatnonzero(~model.holds(order, context) & (data[ORDER:] != _START))
                        own = np.searchsorted(begin, at, "right") - 1
                        yield pd.DataFrame({"id": ids[a:b][own], "verdict": verdict, "ord": np.int32(order), "context": context[at], "at": (at - begin[own]).astype(np.int32), "symbol": data[ORDER:][at].astype(np.int32)})

    asked = texts.mapInPandas(unknown, "id long, verdict string, ord int, context long, at int, symbol int")
    hit = F.struct("verdict", "ord", "at", F.coalesce(F.col("seen")[F.col("symbol")], F.lit(0)).alias("n"), "total", "kinds")
    hits = asked.join(rest, ["verdict", "ord", "context"]).groupBy("id").agg(F.collect_list(hit).alias("hits"))
    known = texts.join(hits, "id", "left").select("__text", _score_column(models, F.col("__text"), spark, F.col("hits")).alias("__found"))
    known = materialise(known, "url-scores")
    return rows.withColumn("__text", url).join(known, "__text", "left").withColumn("__score", F.coalesce("__found", F.lit(0.0))).drop("__text", "__found")


def _threshold(scored: DataFrame) -> float:
    """The score that maximises balanced accuracy of rows (verdict, score), among all that
    occur; where several do, the lowest, moved halfway to the score below it.

    A histogram tells in which bins it can lie; only in those every score is looked at."""
    at = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = materialise(scored.groupBy("score").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")).withColumn("at", at), "score-counts")
    bins = sorted(tuple(r) for r in counts.groupBy("at").agg(F.sum("a"), F.sum("b")).collect())
    allow, block = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not allow or not block:
        return 0.0
    below, a, b = [], 0, 0
    for k, more_a, more_b in bins:
        # The accuracy, times both sizes, at the lower edge, and what no score in the bin can exceed.
        below.append((k, a, b, (allow - a) * block + b * allow, (allow - a) * block + (b + more_b) * allow))
        a, b = a + more_a, b + more_b
    best = max(x[3] for x in below)
    chosen = counts.sparkSession.createDataFrame([x[:3] for x in below if x[4] >= best], "at int, base_a long, base_b long")
    before = Window.partitionBy("at").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    so_far = [F.col(f"base_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in "ab"]
    whole = "decimal(38,0)"
    value = (F.lit(allow) - so_far[0]).cast(whole) * F.lit(block) + so_far[1].cast(whole) * F.lit(allow)
    cut = counts.join(F.broadcast(chosen), "at").select("score", value.alias("value")).agg(F.min(F.struct((-F.col("value")).alias("v"), "score")).alias("x")).first()["x"]["score"]
    under = counts.where(F.col("score") < cut).agg(F.max("score").alias("x")).first()["x"]
    return cut if under is None else cut - (cut - under) / 2


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``."""
    host, path = split_url(F.col(url).cast("string"))
    rule, verdict = match_rule(F.col("__host"), F.col("__path"), rules)
    ruled = pages.withColumns({"__host": host, "__path": path}).withColumns({"__rule": rule, "__verdict": verdict})
    sample = ruled.where("__verdict is not null").select(F.col("__verdict").alias("verdict"), F.col(url).cast("string").alias("url"))
    apart = F.pmod(F.xxhash64("url"), F.lit(CALIBRATE_ONE_IN)) == 0
    found, sent = _counted(sample.where(~apart))
    models, rest = _models(found, sent), _rest(found, sent)
    cut = _threshold(_scored(sample.where(apart), F.col("url"), models, rest).select("verdict", F.col("__score").alias("score")))
    scored = _scored(ruled, F.col(url).cast("string"), models, rest)
    own = F.when((F.length(F.coalesce(F.col(url).cast("string"), F.lit(""))) > 0) & (F.col("__score") >= cut), "allow").otherwise("block")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    return scored.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__score").alias("score"), F.coalesce("__verdict", own).alias("verdict"))
