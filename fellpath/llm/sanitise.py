"""Information-theoretic sanitisation of personal data.

Entities to protect are the addresses, network addresses, card and phone
numbers found by fixed patterns, each at several grains: the value itself, the
name and the domain of an address, the networks of a network address, the issuer
of a card, country and area of a phone number. A value seldom recurs, so it is
the coarser grains that most often have the support to show what discloses them; a term
that discloses any grain counts. A term (a run of letters) of a text that holds
an entity discloses it as far as seeing the term tells that the entity is there: with
counts of distinct texts over the whole corpus, copies of a text counting once,

    disclosure(e, t) = PMI(e; t) / IC(e) = log(N n_et / (n_e n_t)) / log(N / n_e)

which is 1 when the term occurs in texts of the entity only. Co-occurrence is
over whole texts of any length. Terms that co-occur with an entity (a grain) in at least
``MIN_SUPPORT`` different texts and disclose it by ``GENERALISE`` or more become
spans wherever they occur, also in texts without the entity: they are
generalised to their shape, and from ``REMOVE`` on removed. Spans of the fixed
patterns always stay.

One pass finds entities and the terms of the texts that hold them, another
counts the distinct texts of every term, a third finds the disclosing terms in
all texts. Counts are summed before any shuffle by a common key; entities or
terms of any frequency stay spread, and no list per entity is ever built.

Defined results: null text has no spans and stays null; rows are told apart by
id and text, so repeated rows give the same spans; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise

KINDS = ("email", "ip", "card", "phone", "term")
MIN_SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Entities, disclosing terms or term spans that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Keys of copies (8 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_COPIES = 1_000_000
#: Terms whose verdict a task remembers at once; more are looked up anew.
REMEMBERED = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_NAME = re.compile(r"[a-z]{3,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        at = text.find("@", max(at + 1, low))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of every run of dotted numbers."""
    for run in _DOTTED.finditer(text):
        parts, start = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        if 16 <= run.end() - run.start() <= 37:
            digits = run[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield run.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and 8 <= sum(c.isdigit() for c in found[0]) <= 15:
            yield found.span()
        at = text.find("+", found.end() if found else at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns by kind, then start; code points."""
    if not text:
        return []
    return [(kind, s, e) for kind, find in enumerate((_emails, _ips, _cards, _phones)) for s, e in find(text)]


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _term_hash(terms: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(terms, object), categorize=False).view(np.int64) if terms else np.zeros(0, np.int64)


def _terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all terms of a text outside ``spans``."""
    found = [(m[0].lower(), *m.span()) for m in _TERM.finditer(text)]
    if not found or not spans:
        return found
    covered = np.array(sorted((s, e) for _, s, e in spans))
    reach = np.maximum.accumulate(covered[:, 1])
    before = np.searchsorted(covered[:, 0], [e for _, _, e in found])
    free = (before == 0) | (reach[before - 1] <= np.array([s for _, s, _ in found]))
    return [x for x, out in zip(found, free.tolist(), strict=True) if out]


def _entities(text: str, span: tuple[int, int, int]) -> list[str]:
    """What a span protects, at several grains: its value, and the parts that others may share."""
    kind, start, end = span
    value = text[start:end].lower()
    if kind == 0:
        local, _, domain = value.partition("@")
        name = _NAME.match(local)
        parts = [value, f"@{domain}", *([f"{name[0]}@"] if name else [])]
    elif kind == 1:
        four = value.split(".")
        parts = [value, ".".join(four[:3]), ".".join(four[:2])]
    else:
        digits = re.sub("[^0-9]", "", value)
        parts = [digits, digits[: 6 if kind == 2 else 5] + "*"]
    return [f"{kind}:{part}" for part in parts]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(doc_id), body).alias("k1"), F.xxhash64(body, F.lit(1), F.col(doc_id)).alias("k2"), F.when(body.isNotNull(), F.xxhash64(body)).alias("same"), body.alias("__text"))


def find_entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``__id``, keys, counts by kind, the base spans, its distinct
    entities ``e`` and, where it has any, all its distinct terms ``t``; written once."""
    keyed = _keyed(docs, doc_id, text)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, counts, entities, terms = [], [], [], []
            for body in batch["__text"]:
                spans = base_spans(body if isinstance(body, str) else "")
                base.append(render(spans))
                counts.append([sum(k == kind for k, _, _ in spans) for kind in range(4)])
                entities.append(_term_hash(sorted({e for x in spans for e in _entities(body, x)})))
                terms.append(_term_hash(sorted({x[0] for x in _terms(body, spans)})) if spans else np.zeros(0, np.int64))
            out = batch.drop(columns="__text")
            out[["n_email", "n_ip", "n_card", "n_phone"]] = np.array(counts, np.int64).reshape(-1, 4)
            out["base"], out["e"], out["t"] = base, entities, terms
            yield out

    kind = keyed.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, k1 long, k2 long, same long, n_email long, n_ip long, n_card long, n_phone long, base string, e array<long>, t array<long>"
    return materialise(keyed.mapInPandas(scan, schema), "entities")


def _distinct_texts(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each distinct text once as ``__text``. Only keys are grouped; texts move
    only where the same row is repeated, or where more copies than
    ``BROADCAST_COPIES`` have to be told apart."""
    rows = found.where("same is not null").groupBy("same", "k1").agg(F.count("*").alias("m"))
    first = rows.groupBy("same").agg(F.min(F.struct("k1", "m")).alias("first"))
    later = rows.join(first, "same").where(F.col("k1") != F.col("first.k1")).select("k1")
    again = first.where(F.col("first.m") > 1).select(F.col("first.k1").alias("k1"))
    aside = materialise(later.withColumn("later", F.lit(True)).unionByName(again.withColumn("later", F.lit(False))), "copies")
    n_aside = aside.count()
    marked = F.broadcast(aside) if n_aside <= BROADCAST_COPIES else aside
    joined = _keyed(docs, doc_id, text).select("k1", "__text").where("__text is not null").join(marked, "k1", "left")
    once = joined.where("later is null").select("__text")
    if not n_aside or aside.where("not later").isEmpty():
        return once
    return once.union(joined.where("not later").select("__text").distinct())


def term_documents(texts: DataFrame) -> DataFrame:
    """Rows (t, n_t): in how many of the distinct ``texts`` (column ``__text``) each term occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for body in batch["__text"]:
                seen.update({term.lower() for term in set(_TERM.findall(body))})
            yield pd.DataFrame({"t": _term_hash(list(seen)), "n": np.fromiter(seen.values(), np.int64, len(seen))})

    return texts.mapInPandas(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))


def disclosing(found: DataFrame, terms: DataFrame, n_texts: int, *, min_support: int = MIN_SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """Rows (e, t, disclosure): the terms that give an entity away."""
    texts = found.where(F.size("e") > 0).select("same", "e", "t").distinct()
    entities = texts.select(F.explode("e").alias("e")).groupBy("e").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_support)
    entities = materialise(entities, "entity-texts")
    known = F.broadcast(entities) if entities.count() <= BROADCAST_ROWS else entities
    near = texts.select(F.explode("e").alias("e"), "t").join(known.select("e"), "e")
    together = near.select("e", F.explode("t").alias("t")).groupBy("e", "t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= min_support)
    rows = together.join(known, "e").join(terms, "t")
    n = F.lit(float(max(n_texts, 1)))
    share = (F.log(n * F.col("n_et") / (F.col("n_e") * F.col("n_t")))) / F.log(n / F.col("n_e"))
    return rows.where(F.col("n_e") < n).withColumn("disclosure", share).where(F.col("disclosure") >= generalise).select("e", "t", "disclosure")


def term_spans(docs: DataFrame, rules: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (k1, k2, terms): all occurrences of disclosing terms in each text
    that has any, as sorted (start, end, disclosure)."""
    rules = materialise(rules.groupBy("t").agg(F.max("disclosure").alias("d")), "disclosing-terms")
    few = rules.count() <= BROADCAST_ROWS
    known = docs.sparkSession.sparkContext.broadcast(np.sort(rules.select("t").toPandas()["t"].to_numpy(np.int64)) if few else None)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = known.value
        memo: dict[str, bool] = {}
        none = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        for batch in batches:
            held = []
            for body in batch["__text"]:
                words = {term.lower() for term in set(_TERM.findall(body))}
                if wanted is not None:
                    if len(memo) > REMEMBERED:
                        memo.clear()
                    new = [w for w in words if w not in memo]
                    hashes = _term_hash(new)
                    memo.update(zip(new, (np.searchsorted(wanted, hashes, "right") > np.searchsorted(wanted, hashes)).tolist(), strict=True))
                    if not any(memo[w] for w in words):
                        held.append(none)
                        continue
                found = [x for x in _terms(body, base_spans(body)) if wanted is None or memo[x[0]]]
                at = np.array([x[1:] for x in found], np.int32).reshape(-1, 2)
                held.append((_term_hash([x[0] for x in found]), at[:, 0], at[:, 1]))
            out = batch.drop(columns="__text")
            out["t"], out["s"], out["f"] = ([x[k] for x in held] for k in range(3))
            yield out[out["t"].map(len) > 0]

    rows = _keyed(docs, doc_id, text).select("k1", "k2", "__text").where("__text is not null")
    hits = rows.mapInPandas(scan, "k1 long, k2 long, t array<long>, s array<int>, f array<int>")
    hits = hits.select("k1", "k2", F.explode(F.arrays_zip("t", "s", "f")).alias("x")).select("k1", "k2", "x.t", "x.s", "x.f")
    hits = hits.join(F.broadcast(rules) if few else rules, "t").groupBy("k1", "k2", "s", "f").agg(F.max("d").alias("d"))
    return hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("s", "f", "d"))).alias("terms"))


def _plan(docs: DataFrame, doc_id: str, text: str, options: dict) -> tuple[DataFrame, DataFrame]:
    found = find_entities(docs, doc_id, text)
    rules = disclosing(found, term_documents(_distinct_texts(docs, found, doc_id, text)), found.where("same is not null").select("same").distinct().count(), **options)
    return found, materialise(term_spans(docs, rules, doc_id, text), "term-spans")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """Per row: ``doc_id``, counts by kind, ``base`` and ``spans``, both rendered
    as ``kind:start:end`` by kind, then start."""
    found, terms = _plan(docs, doc_id, text, options)
    extra = F.array_join(F.transform("terms", lambda x: F.concat(F.lit(f"{KINDS[4]}:"), x["s"].cast("string"), F.lit(":"), x["f"].cast("string"))), ",")
    out = found.drop("e", "t").join(terms, ["k1", "k2"], "left")
    spans = F.concat("base", F.coalesce(F.concat(F.when(F.col("base") != "", ",").otherwise(""), extra), F.lit("")))
    return out.select(F.col("__id").alias(doc_id), "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"))


def redact(text: str, terms: list[tuple[int, int, float]], remove: float = REMOVE) -> str:
    """``text`` with base spans replaced by their kind, and terms generalised to
    their shape or removed; overlapping spans are replaced as one."""
    cuts = [(s, e, f"[{KINDS[k].upper()}]") for k, s, e in base_spans(text)]
    for s, e, d in terms:
        shape = "[NAME]" if text[s:e].istitle() else "[WORD]"
        cuts.append((int(s), int(e), "" if d >= remove else shape))
    out, last = [], 0
    for s, e, tag in sorted(cuts):
        if s >= last:
            out += [text[last:s], tag]
        last = max(last, e)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; all rows and columns stay."""
    _, terms = _plan(docs, doc_id, text, options)
    terms = terms.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), *(F.col(f"terms.{c}").alias(f"__{c}") for c in "sfd"))
    if (terms.agg(F.sum(F.size("__s"))).first()[0] or 0) <= BROADCAST_ROWS:
        terms = F.broadcast(terms)

    @F.pandas_udf("string")
    def clean(body: pd.Series, s: pd.Series, f: pd.Series, d: pd.Series) -> pd.Series:
        none = ()
        return pd.Series([redact(b, list(zip(none if x is None else x, none if y is None else y, none if z is None else z, strict=True))) if isinstance(b, str) else None for b, x, y, z in zip(body, s, f, d, strict=True)], dtype=object)

    body = F.col(text).cast("string")
    keyed = docs.withColumns({"__k1": F.xxhash64(F.col(doc_id), body), "__k2": F.xxhash64(body, F.lit(1), F.col(doc_id))})
    joined = keyed.join(terms, ["__k1", "__k2"], "left")
    return joined.withColumn(text, clean(body, "__s", "__f", "__d")).select(*docs.columns)


def digest(base: Column) -> Column:
    """Lower-case hex SHA-256 of rendered spans."""
    return F.sha2(base, 256)
