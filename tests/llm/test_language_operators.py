"""Source divergence, tokenizer alignment and quality rules: SQL, brute force, odd input."""

import collections
import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from fellpath.llm import quality_rules, queries, source_divergence, tokenizer_alignment, transducer

DOCS = "doc_id long, text string, lang string, source string, n long, value int, host int, line string, p int"
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); further columns have clashing names."""
    return spark.createDataFrame([(*row, 1, 2, 3, "x", 4) for row in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """A hot source, ties, copies, letters of all kinds, a source without terms, nulls."""
    rng, rows = random.Random(5), []
    words = ["Ärger", "été", "naïve", "ZEBRA", "zebra", "a", "b", "ab", "abc", "Straße", "日本語", "x1y", "don't", "\U0001f600", "ÉTÉ"]
    for i in range(240):
        lang = ("en", "de", None, "")[i % 4] if i % 7 else "en"
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        rows.append((i, text, lang, None if i % 11 == 0 else f"s{0 if i % 3 else i % 5}"))
    rows += [(310 + k, "zebra abc", "en\x00" + "x" * (k % 2), "s0\x00") for k in range(20)]
    rows += [(300, None, "en", "s0"), (301, "", "en", "empty"), (302, "1 2 3", "en", "digits"), (None, "zebra " * 3, "en", "s0"), (5, rows[5][1], rows[5][2], rows[5][3]), (303, "only once", "fr", "s0"), (304, None, "fr", "s1")]
    return rows + [(305, "zebra abc " * 3000 + "\n" + "q" * 5000, "en", "s2")]


def brute_divergence(rows, min_documents):
    docs = [(t or "", la or "", s or "") for _, t, la, s in rows]
    held = collections.defaultdict(collections.Counter)
    seen = collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        held[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in seen[lang].items() if n >= min_documents]
        sources = sorted({s for la, s in held if la == lang})
        whole = sum((held[lang, s] for s in sources), collections.Counter())

        def p(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, of = p(whole), {s: p(held[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            tops = sorted((q[t] - of[s][t], t.encode()) for t in kept if held[lang, s][t] and of[s][t] > q[t])[:50]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, x in (("pair", pairs), ("term", tops)) for k, (v, i) in enumerate(x)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_against_brute_force(spark, corpus, monkeypatch, small):
    if small:
        for name, value in (("SHARD_TERMS", 3), ("BLOCK_BYTES", 4000), ("HELD", 5), ("TEXT_BYTES", 100), ("SOURCE_BLOCK", 2), ("CELLS", 8)):
            monkeypatch.setattr(source_divergence, name, value)
        make = source_divergence.transducers
        monkeypatch.setattr(source_divergence, "transducers", lambda terms: make(terms, 3))
    got = source_divergence.audit(documents(spark, corpus), min_documents=8)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(corpus, 8)


def test_divergence_large_counts(spark):
    """Counts beyond what a product in 64 bits holds stay exact."""
    frame = spark.createDataFrame([(12_345_678_901, 98_765_432_109, 1000)], "n long, total long, v long")
    got = frame.select(source_divergence._scaled(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (12_345_678_901 + 5) // (98_765_432_109 + 5000)


def test_transducer():
    rng = random.Random(1)
    for trial in range(100):
        terms = sorted({bytes(rng.choice(b"abc\xc3\xff") for _ in range(rng.randint(trial % 2, 6))) for _ in range(rng.randint(0, 60))})
        made = transducer.build(terms)
        asked = terms + [bytes(rng.choice(b"abc\xc3\xffz") for _ in range(rng.randint(0, 7))) for _ in range(50)]
        ends = np.cumsum([len(x) for x in asked])
        got = made.ordinals(np.frombuffer(b"".join(asked) + b" ", np.uint8), ends - [len(x) for x in asked], ends)
        place = {x: i for i, x in enumerate(terms)}
        assert got.tolist() == [place.get(x, -1) for x in asked]
        rests = {frozenset(x[k:] for x in terms if x[:k] == y[:k]) for y in terms for k in range(len(y) + 1)} | {frozenset(terms)}
        assert len(made.final) - 1 <= len(rests)
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    for name in ("op11_source_divergence", "op13_quality_rules"):
        want = con.execute(queries.ORACLE_SQL[name])
        columns = sorted(c[0] for c in want.description)
        order = [c[0] for c in want.description]
        theirs = sorted((tuple(dict(zip(order, row, strict=True))[c] for c in columns) for row in want.fetchall()), key=repr)
        got = queries.QUERIES[name](spark, SF_DIR).select(*columns)
        assert sorted(map(tuple, got.collect()), key=repr) == theirs and theirs


@pytest.fixture(scope="module")
def tokens(spark):
    return tokenizer_alignment.Pair.load(open(tokenizer_alignment.BYTE_BPE, "rb").read(), open(tokenizer_alignment.PIECE_BPE, "rb").read())


def brute_alignment(pair, rows):
    """Token by token over whole documents, without anchors or memory, A by its own library."""
    own = tokenizers.Tokenizer.from_file(tokenizer_alignment.BYTE_BPE)
    own.encode_special_tokens = True
    made = []
    for doc_id, text, *_ in rows:
        a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            a, b = [], []
        ends_a = list(itertools.accumulate(len(pair.a_bytes[i]) for i in a))
        ends_b = list(itertools.accumulate(len(pair.b_bytes[i]) for i in b))
        links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in sorted(set(ends_a) & set(ends_b))]
        groups, last = [], 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, ends, strict=True) if last < x <= e) for ids, ends in ((a, ends_a), (b, ends_b))))
            last = e
        made.append((doc_id, len(a), len(b), links, ";".join(groups)))
    counts = collections.Counter(x for row in made for x in row[3])
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((d, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, n_a, n_b, links, g in made), key=repr)


@pytest.mark.parametrize("shuffled", [False, True])
def test_alignment_against_brute_force(spark, tokens, corpus, monkeypatch, shuffled):
    if shuffled:
        for name, value in (("BROADCAST_PAIRS", 1), ("REMEMBERED", 2), ("BLOCK_CHARS", 50)):
            monkeypatch.setattr(tokenizer_alignment, name, value)
    rows = [r for r in corpus if r[0] != 305][::3] + [(400, "tab\tand\n\nlines  two  blanks ", None, None), (401, " leading", None, None), (402, "▁ mark", None, None), (403, "<|endoftext|> <s></s> <unk> <0x41>", None, None), (404, "\x00 nul   é", None, None), (405, "w" * 400, None, None), (405, "w" * 400, None, None), (406, " ", None, None), (407, "", None, None), (408, "…—„“ 12,345.67 $%&|", None, None)]
    got = tokenizer_alignment.align(documents(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_alignment(tokens, rows)
    marked = {r.doc_id: r for r in got.collect() if r.doc_id in (402, 403)}
    assert marked[402].n_a == 0 and marked[402].groups_sha256 == "" and marked[403].n_a > 5


def test_alignment_groups_kept(spark, tokens):
    row = tokenizer_alignment.aligned(documents(spark, [(1, "Hello world", None, None)]), keep_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert sum(row.times) == row.n_links == row.groups.count(";") + 1


def brute_quality(rows):
    texts = collections.defaultdict(set)
    for _, text, _, host in rows:
        if text is not None:
            texts[host].add(text)

    def plain(line):
        return " ".join(WORD.findall(re.sub("[0-9]", "0", line.lower())))

    often = set()
    for host, own in texts.items():
        counts = collections.Counter(x for t in own for x in {plain(y) for y in t.split("\n")} if x)
        often |= {(host, x) for x, n in counts.items() if n > max(5, 0.1 * len(own))}
    out = []
    for doc_id, text, _, host in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts = collections.Counter(windows)
        again = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        left = len(words) - sum(len(WORD.findall(x)) for x in lines if (host, plain(x)) in often)
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        kept = not failed and left >= 20 and left >= 0.5 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed, kept, left))
    return sorted(out, key=repr)


def quality_rows():
    rng, rows = random.Random(9), []

    def line(n):
        return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))

    menu = "Home | News 24 | Contact us & more"
    legal = "All rights reserved by the owner of this page and its   many friends in 2019"
    for i in range(60):
        lines = [line(rng.randint(3, 12)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines = [menu.replace("24", str(i % 10) + "1"), *lines, legal.upper()]
        if i % 9 == 0:
            lines += [lines[0], lines[0], "", " ", " \t"]
        if i % 13 == 0:
            lines = [*[f"{legal} {menu}"] * 2, line(3)]
        rows.append((i, "\n".join(lines), "en", ("a", "a", "b", None)[i % 4]))
    copied = "\n".join(line(9) for _ in range(5))
    rows += [(100 + i, copied, "en", "a") for i in range(40)]
    return rows + [(200, None, None, None), (201, "", "en", "a"), (None, line(25), "en", "c"), (202, (line(8) + "\n") * 5, "en", "a"), (203, line(30_000), "en", "a"), (203, "#*$%&|<> é😀 " * 30, "en", "a")]


@pytest.mark.parametrize("shuffled", [False, True])
def test_quality_against_brute_force(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)
    rows = quality_rows()
    got = quality_rules.measure(documents(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")
    want = brute_quality(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    kept = {r[0] for r in want if r[7]}
    assert set(range(100, 140)) <= kept
    assert any(r[8] < r[1] and r[7] for r in want) and any(not r[6] and not r[7] for r in want)


def test_quality_apply(spark):
    rows = quality_rows()
    docs = documents(spark, rows)
    clean = {(r.doc_id, r.source): r for r in quality_rules.apply(docs).collect()}
    assert docs.columns == quality_rules.apply(docs).columns
    assert all("rights reserved" not in r.text.lower() for r in clean.values() if r.source == "a")
    kept = sum(r[7] for r in brute_quality(rows))
    assert quality_rules.apply(docs).count() == kept


def test_empty_tables(spark):
    none = documents(spark, [])
    assert source_divergence.audit(none).count() == tokenizer_alignment.align(none).count() == quality_rules.measure(none).count() == 0
