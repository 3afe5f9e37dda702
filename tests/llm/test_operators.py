"""Each operator against brute force, round trips or held-out accuracy, and on odd input."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellpath.llm import chunk_dedup, decontaminate, knn_join, langid, mixing, pseudo_likelihood, sanitise, shingle_join, url_filter, warc_zst

DOCS = "doc_id long, text string, lang string, source string, n_chars int, id long, h long, size string"


def prose(seed, n, syllables="en ti re ha th ed in on er st ly of and the".split()):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); further columns have clashing names."""
    return spark.createDataFrame([(d, t, la, s, len(t or ""), 7, 8, "x") for d, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long = prose(1, 20_000)
    return documents(spark, [(1, None, "en", "a"), (2, "", "en", None), (3, " \n ", None, "a"), (4, long, "en", "a"), (4, long, "en", "a"), (None, prose(2, 30), "en", "b"), (5, "0", None, "b"), (6, "é" * 50, "fr", "a"), (7, "\U0001f600 x@y.zz", None, None)])


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def mixed(spark):
    """Prose with exact copies, near copies and short texts."""
    rng, rows = random.Random(3), []
    for i in range(60):
        rows.append((i, prose(i, rng.randint(1, 120)), "en", f"s{i % 4}"))
    for i in range(60, 90):
        words = rows[i % 12 + 20][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s0"))
    return documents(spark, rows)


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/71?q", "http://b.com/en/7", "ftp://x.net/de/8", "http://example.net/de/8", "http://m.org/es/", "nonsense", None, "", "http://notexample.com/en/7", "http://com/en/#/x"]
    urls += [f"http://h{i}.net/de/{i}" for i in range(80)] + [f"http://h{i}.com/en/{i}.html" for i in range(80)] + ["http://h5.net/xx/5"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("score", F.lit("clash"))
    rules = [url_filter.parse_rule(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest)[0].lower()
        path = re.split(r"[?#]", rest[len(host):])[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.text)
        if best:
            assert got[i].verdict == best.verdict
    assert got[len(urls) - 1].verdict == "allow" and got[6].verdict == got[7].verdict == "block"
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def brute_markov(urls, url):
    """Witten-Bell probabilities by plain dictionaries, one character at a time."""
    counts = collections.defaultdict(collections.Counter)
    for u in urls:
        told = ["^"] * 5 + list(u)
        for i in range(5, len(told)):
            for k in range(6):
                counts[tuple(told[i - k : i])][told[i]] += 1
    told, out = ["^"] * 5 + list(url), []
    for i in range(5, len(told)):
        p = 1 / 64
        for k in range(6):
            own = counts.get(tuple(told[i - k : i]))
            if own:
                p = (own[told[i]] + len(own) * p) / (sum(own.values()) + len(own))
        out.append(math.log(p))
    return out


def test_markov_model_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    urls = ["http://" + "".join(rng.choice("abcde./") for _ in range(rng.randint(5, 30))) for _ in range(200)]
    rows = spark.createDataFrame([("allow", u) for u in urls], "verdict string, url string")
    model = url_filter._fit(rows)["allow"]
    for url in (urls[0], "http://zzz.a/b", "ab"):
        data, _ = url_filter._symbols([url])
        assert np.allclose(model.log_prob(data), brute_markov(urls, url), rtol=1e-5)
    data, _ = url_filter._symbols(["http://a.b/c"])
    ends = [np.concatenate((data[5:13], [c])).astype(np.uint8) for c in range(64)]
    assert math.isclose(sum(np.exp(model.log_prob(row)[-1]) for row in ends), 1, rel_tol=1e-5)
    monkeypatch.setattr(url_filter, "CONTEXTS", 20)
    small = url_filter._fit(rows)["allow"]
    assert all(len(c) <= 20 for c in small.contexts)
    assert math.isclose(sum(np.exp(small.log_prob(row)[-1]) for row in ends), 1, rel_tol=1e-5)


def test_url_filter_without_caps(spark, monkeypatch):
    """Scores are the same wherever contexts lie, also of repeated URLs; the threshold is the best of all scores."""
    rng = random.Random(3)
    urls = [f"http://h{rng.randint(0, 99)}.{rng.choice(['net/de', 'com/en', 'fr/x'])}/{prose(i % 90, 2)}" for i in range(240)] + [None, "", "x"]
    pages = spark.createDataFrame(list(enumerate(urls + urls[:20])), "page_id long, url string")
    rules = [url_filter.parse_rule("block", "com/en/"), url_filter.parse_rule("allow", "net/de/")]
    want = {r.page_id: (r.score, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    monkeypatch.setattr(url_filter, "CONTEXTS", 9)
    got = {r.page_id: (r.score, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert set(got) == set(want) and len(got) == len(urls) + 20
    assert all(math.isclose(got[i][0], want[i][0], rel_tol=1e-9, abs_tol=1e-12) and got[i][1] == want[i][1] for i in want)
    rows = [(rng.choice(["allow", "block"]), rng.gauss(0, 3e-4)) for _ in range(300)] + [("allow", 9.0), ("block", -9.0)]
    cut = url_filter._threshold(spark.createDataFrame(rows, "verdict string, score double"))
    sides = [[s for v, s in rows if v == side] for side in ("allow", "block")]

    def accuracy(t):
        return sum(s >= t for s in sides[0]) * len(sides[1]) + sum(s < t for s in sides[1]) * len(sides[0])

    assert accuracy(cut) == max(accuracy(s) for _, s in rows)


def test_knn_join(spark):
    rng = np.random.RandomState(4)
    rows = [(i, [float(x) for x in rng.randn(6).round(2)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)] + [(500, None), (550, [1.0, None]), (600, [float("nan")]), (650, [float("inf")]), (700, []), (None, [1.0])] + [rows[50]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in knn_join.top_k(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    held = {i: [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (6 - len(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in held if i % 50 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(held[q], v, strict=True)), i) for i, v in held.items() if i != q))[:5]
        assert got.pop(q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    assert knn_join.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert knn_join.top_k(frame.where("vec_id = 50").limit(1), F.col("vec_id") % 50 == 0).count() == 0


def test_knn_join_many_blocks(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 8), ("BLOCK_ROWS", 16), ("PIVOTS", 4)):
        monkeypatch.setattr(knn_join, name, value)
    test_knn_join(spark)


def test_decontaminate(spark, odd, empty):
    items = [(1, prose(100, 30)), (2, prose(101, 25).title()), (3, "short"), (4, None), (5, prose(102, 60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = list(items[4][1])
    for at in range(5, len(edited), 40):
        edited[at] = "#"
    del edited[100]
    rows = [(1, prose(5, 50) + " " + items[0][1] + " " + prose(6, 50), None, None), (2, items[1][1].upper().replace(" ", "\n"), None, None), (3, prose(7, 300), None, None), (4, prose(8, 9) + "".join(edited), None, None), (5, items[0][1][:60], None, None)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 5)}
    assert rows[0][1][got[1, 1].start : got[1, 1].end] == items[0][1] and got[1, 1].edits == 0
    assert 0 < got[4, 5].edits <= 0.1 * len(items[4][1])
    docs = documents(spark, rows)
    assert {r.doc_id for r in docs.where(decontaminate.leaks(docs, bench) == 0).collect()} == {3, 5}
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert docs.where(decontaminate.leaks(docs, bench.limit(0)) == 0).count() == 5


def test_alignment_against_plain_edit_distance():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.randrange(4) for _ in range(rng.randint(8, 14))]
        region = [rng.randrange(4) for _ in range(len(item) + 8)]
        cost, _ = decontaminate._align(np.array(item), np.array([region]))
        row = [0] * (len(region) + 1)
        for i, x in enumerate(item, 1):
            nxt = [i]
            for j, y in enumerate(region, 1):
                nxt.append(min(row[j - 1] + (x != y), row[j] + 1, nxt[-1] + 1))
            row = nxt
        assert cost[0] >= min(row)
        if min(row) == 0:
            assert cost[0] == 0


def brute_edits(item, text):
    """Fewest edits of the whole item against any part of a text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_search_against_brute_force(monkeypatch):
    """Exactly the items within their budget are found, with their edits, in every text."""
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", 50)
    rng = random.Random(12)
    items = [prose(700 + k, 6 + 5 * k)[: 30 + 40 * k] for k in range(6)] + ["a" * 40, " ." * 20]
    texts = ["", "a" * 300, " . " * 60 + " ." * 30, prose(800, 60)]
    for _ in range(40):
        part = list(rng.choice(items))
        for _ in range(rng.randint(0, len(part) // 7)):
            at = rng.randrange(len(part))
            part[at] = rng.choice(["", "#", part[at] + "x"])
        texts.append(prose(rng.randint(900, 990), rng.randint(0, 20)) + "".join(part) + prose(rng.randint(900, 990), rng.randint(0, 20)))
    index = decontaminate.Index(list(range(len(items))), items)
    got = {}
    for row, item, _, _, edits in index.search(texts):
        got[row, item] = min(edits, got.get((row, item), 999))
    want = {}
    for row, text in enumerate(texts):
        for k, item in enumerate(items):
            edits = brute_edits(item.lower(), text.lower())
            if edits <= index.edits[k]:
                want[row, k] = edits
    assert got == want and sum(1 for e in want.values() if e) > 5


def test_long_items_have_their_whole_budget():
    item = prose(720, 500)[:2000]
    edited = list(item)
    for at in range(3, 2000, 20):
        edited[at] = "#"
    index = decontaminate.Index([1], [item])
    (found,) = index.search(["x " * 400 + "".join(edited) + " y" * 300])
    assert found[1] == 0 and 90 <= found[4] <= 100


def test_long_documents_are_searched_in_pieces(monkeypatch):
    item = prose(55, 40)
    text = prose(56, 400) + item + prose(57, 400) + item
    whole = decontaminate.Index([1], [item]).search([text])
    monkeypatch.setattr(decontaminate, "PIECE_CHARS", 300)
    assert sorted(decontaminate.Index([1], [item]).search([text])) == sorted(whole) and len(whole) == 2


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", "<p>" + prose(i % 7, 40)) for i in range(40)] + [(90, None, None), (91, "http://x/\r\ny", ""), (92, "u", "é" * 49), (93, "u", "é" * 49), (94, "u", "é" * 50), (95, "u", "é" * 50), (96, "v", prose(3, 30_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r.page_id: r for r in warc_zst.round_trip(pages).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        keep = len(body) < 100 or first.setdefault(body, i) == i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].error) == (len(body), hashlib.sha256(body).hexdigest(), None)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if keep else ("revisit", first[body]))
        assert got[i].payload == (body if keep else None)
    assert warc_zst.round_trip(pages.limit(0)).count() == 0


def test_warc_null_and_repeated_ids(spark):
    body, lone = "<p>" + prose(1, 60), "<p>" + prose(2, 60)
    rows = [(None, "a", body), (7, "b", body), (3, "c", body), (3, "c", body), (None, None, lone), (None, "d", lone), (9, "e", "small")]
    got = warc_zst.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    told = sorted((str(r.page_id), r.url or "", r.record_type, r.refers_to or 0, r.error) for r in got)
    assert told == sorted([("None", "a", "revisit", 3, None), ("7", "b", "revisit", 3, None), ("3", "c", "response", 0, None), ("3", "c", "response", 0, None), ("None", "", "response", 0, None), ("None", "d", "response", 0, None), ("9", "e", "response", 0, None)])


def test_warc_reader_reports_damage():
    import zstandard

    record = warc_zst.build_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc_zst.parse_record(record)["error"] is None
    assert warc_zst.parse_record(record[:-1])["error"] == "length"
    assert warc_zst.parse_record(record.replace(b"abc", b"abd"))["error"] == "digest"
    assert warc_zst.parse_record(record.replace(b"WARC-Date", b"X-Date"))["error"] == "missing WARC-Date"
    assert warc_zst.parse_record(b"WARC/0.9\r\n\r\n")["error"] == "version"
    raw = bytes(range(256)) * 20
    body = warc_zst.archive_head(raw) + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(record) * 2
    assert list(warc_zst.read_archive(body)) == [(record, None)] * 2
    assert [e for _, e in warc_zst.read_archive(body[:-3])] == [None, "frame cut short"]
    assert [e is None for _, e in warc_zst.read_archive(body[:100])] == [False]


def brute_spans(text):
    out = []
    for kind, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")) or kind == 2 and not (16 <= len(digits) <= 19 and sanitise._luhn(digits)) or kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(5)
    for _ in range(8000):
        text = "".join(rng.choice("aB1.@+-( )9 2.%x") for _ in range(rng.randint(0, 60)))
        assert sanitise.base_spans(text) == brute_spans(text)
    assert sanitise.base_spans("4111 1111 1111 1111, 1.2.3.4.5.6.7.8") == brute_spans("4111 1111 1111 1111, 1.2.3.4.5.6.7.8")
    assert sanitise.base_spans("1" * 200_000 + "@" + "+1" + "(" * 200_000) == []


def test_sanitise(spark, odd, empty):
    rows = [(i, f"{prose(i, 20)} Zorbane wrote from bob@mail.example.com today {prose(i + 50, 20)}", "en", "a") for i in range(6)]
    rows += [(i, prose(i, 40), "en", "a") for i in range(6, 60)]
    found = {r.doc_id: r for r in sanitise.detect(documents(spark, rows)).collect()}
    for i, text, _, _ in rows:
        base = brute_spans(text)
        assert found[i].base == sanitise.render(base) and found[i].n_email == len(base)
        at = text.find("Zorbane")
        assert (f"term:{at}:{at + 7}" in found[i].spans.split(",")) == (i < 6)
    clean = {r.doc_id: r.text for r in sanitise.sanitise(documents(spark, rows)).collect()}
    assert all("Zorbane" not in clean[i] and "[EMAIL]" in clean[i] for i in range(6)) and clean[20] == rows[20][1]
    kept = sanitise.sanitise(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert sanitise.detect(odd).count() == odd.count() and sanitise.detect(empty).count() == 0 and sanitise.sanitise(empty).count() == 0
    assert {r.n_email for r in sanitise.detect(odd).where("doc_id = 7").collect()} == {1}


def test_sanitise_counts_copies_once(spark):
    rows = [(i, f"Zorbane wrote from bob@mail.example.com {prose(i, 20)}", "en", "a") for i in range(3) for _ in range(40)]
    rows = [(k, *row[1:]) for k, row in enumerate(rows)] + [(1000 + i, prose(i + 50, 10), "en", "a") for i in range(300)]
    found = sanitise.detect(documents(spark, rows)).where("doc_id < 1000").collect()
    assert len(found) == 120 and all("term:0:7" in r.spans.split(",") for r in found)


def brute_disclosing(texts):
    """Terms that disclose a grain of an entity, by plain counting over distinct texts."""
    n_e, n_t, n_et = collections.Counter(), collections.Counter(), collections.Counter()
    texts = {t for t in texts if t is not None}
    for text in texts:
        spans = sanitise.base_spans(text)
        grains = set()
        for k, s, e in spans:
            value = text[s:e].lower()
            digits = re.sub("[^0-9]", "", value)
            if k == 0:
                local, domain = value.split("@")
                grains |= {(k, value), (k, "@" + domain)} | {(k, m[0] + "@") for m in [re.match("[a-z]{3,}", local)] if m}
            elif k == 1:
                grains |= {(k, value), (k, value.rsplit(".", 1)[0]), (k, value.rsplit(".", 2)[0])}
            else:
                grains |= {(k, digits), (k, digits[: 6 if k == 2 else 5] + "*")}
        outside = list(text)
        for _, s, e in spans:
            outside[s:e] = "\0" * (e - s)
        whole = {m.lower() for m in re.findall(r"[^\W\d_]{3,}", text)}
        beside = {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", text) if all(m.end() <= s or m.start() >= e for _, s, e in spans)}
        n_e.update(grains)
        n_t.update(whole)
        n_et.update((g, t) for g in grains for t in beside)
    n = len(texts)
    return {t for (g, t), both in n_et.items() if both >= 3 and n_e[g] < n and math.log(n * both / (n_e[g] * n_t[t])) / math.log(n / n_e[g]) >= 0.8}


def test_disclosure_against_plain_counts(spark):
    """Terms of the given documents, and of planted ones, are those of plain counts; every occurrence is a span."""
    rows = [(r.doc_id, r.text, None, None) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(10_000 + k, f"{prose(k, 30)} Zorblat {prose(k + 50, 9)} write to someone{k}@zorb.example today quuxify", None, None) for k in range(6)] + [(10_100, "only Zorblat here, zorblat again", None, None), (10_101, None, None, None)]
    want = brute_disclosing([t for _, t, _, _ in rows])
    assert {"zorblat", "quuxify"} <= want and len(want) > 2
    for r in sanitise.detect(documents(spark, rows)).collect():
        text = next(t for d, t, _, _ in rows if d == r.doc_id) or ""
        base = sanitise.base_spans(text)
        told = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in want and all(m.end() <= s or m.start() >= e for _, s, e in base)]
        assert r.spans == ",".join([*([sanitise.render(base)] if base else []), *(f"term:{s}:{e}" for s, e in told)])


def test_sanitise_finds_disclosing_terms_in_whole_texts(spark, monkeypatch):
    """A name far from its address, again further on, and in a text without the address."""
    rows = [(i, f"Zorbane {prose(i, 400)} zorbane {prose(i + 50, 400)} bob@mail.example.com", "en", "a") for i in range(6)]
    rows += [(6, f"{prose(70, 50)} Zorbane, {prose(71, 50)}", "en", "a")]
    rows += [(i, prose(i, 300), "en", "a") for i in range(100, 200)]
    for most in (sanitise.BROADCAST_ROWS, 0):
        monkeypatch.setattr(sanitise, "BROADCAST_ROWS", most)
        found = {r.doc_id: r.spans.split(",") for r in sanitise.detect(documents(spark, rows)).collect()}
        for i, text, _, _ in rows[:7]:
            for m in re.finditer("zorbane", text.lower()):
                assert f"term:{m.start()}:{m.end()}" in found[i]
        clean = {r.doc_id: r.text for r in sanitise.sanitise(documents(spark, rows)).collect()}
        assert len(clean) == len(rows) and all("zorbane" not in t.lower() for t in clean.values())


def test_terms_outside_spans():
    text = "one bob@mail.example.com two three 4111 1111 1111 1111four"
    assert sanitise._terms(text, sanitise.base_spans(text)) == [("one", 0, 3), ("two", 25, 28), ("three", 29, 34), ("four", 54, 58)]


def test_chunk_dedup(spark, odd, empty):
    passage = prose(400, 70)
    rows = [(i, prose(i, 150), None, None) for i in range(30)]
    for i in (3, 8, 15):
        words = rows[i][1].split()
        rows[i] = (i, " ".join([*words[: 20 + i], passage, *words[20 + i :]]), None, None)
    rows.append((50, "ab ab " * 100, None, None))
    rows.append((51, "x" + "ab ab " * 90, None, None))
    got = chunk_dedup.shared_regions(documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == {3, 8, 15, 50, 51}
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        if r.doc_id < 50:
            assert texts[r.doc_id][r.start : r.end] in passage and r.first_doc_id == 3 and r.kept == (r.doc_id == 3)
    for text in (passage, "a", "aaaa" * 1000, prose(9, 500)):
        spans = chunk_dedup.chunks(text)
        assert "".join(text[s:e] for s, e in spans) == text and max(e - s for s, e in spans) < 256
    assert chunk_dedup.shared_regions(odd).count() == 0 and chunk_dedup.shared_regions(empty).count() == 0


def test_chunk_dedup_keeps_one_holder_of_every_shared_chunk(spark):
    """An original, a near copy with an edited middle and an exact copy of that; passages of two documents side by side."""
    original = prose(600, 300).split()
    edited = " ".join([*original[:120], *prose(601, 60).split(), *original[180:]])
    texts = {1: " ".join(original), 2: edited, 3: edited, 4: prose(602, 200), 5: prose(603, 200)}
    texts[6] = texts[7] = texts[4] + " " + texts[5] + " " + prose(604, 80)
    got = chunk_dedup.shared_regions(documents(spark, [(i, t, None, None) for i, t in texts.items()])).collect()
    holders, dropped = collections.defaultdict(set), collections.defaultdict(set)
    for i, text in texts.items():
        for s, e in chunk_dedup.chunks(text):
            holders[text[s:e]].add(i)
            if any(r.doc_id == i and r.start <= s and e <= r.end and not r.kept for r in got):
                dropped[text[s:e]].add(i)
    assert dropped and all(min(held) not in dropped[part] for part, held in holders.items())
    assert all(texts[r.doc_id][r.start : r.end] in texts[r.first_doc_id] and r.kept == (r.first_doc_id == r.doc_id) for r in got)
    assert any(r.doc_id == 2 and r.kept for r in got) and not any(r.doc_id == 3 and r.kept for r in got)
    whole = {i: sum(r.end - r.start for r in got if r.doc_id == i) for i in (3, 7)}
    assert whole[3] == len(texts[3]) and whole[7] == len(texts[7])


def test_langid(spark, odd, empty):
    german = "ein der und sch keit ung heit ie".split()
    rows = [(i, prose(i, 30) if i % 2 else prose(i, 30, german), "en" if i % 2 else "de", "s") for i in range(120)]
    docs = documents(spark, rows)
    model = langid.fit(docs, where=~langid.held_out())
    out = langid.predict(docs, model, ["doc_id", "lang"]).withColumn("held", langid.held_out()).collect()
    unseen = [r for r in out if r.held]
    assert len(out) == 120 and len(unseen) > 20 and all(r.lang == r.lang_pred and 0.5 <= r.score <= 1 for r in unseen)
    counted = collections.Counter()
    for order in langid.ORDERS:
        codes, s, e = langid._codes(["Ab,  cd9"])
        assert "".join(map(chr, codes[s[0] : e[0]])) == "ab cd "
        counted[order] = e[0] - s[0] - order + 1
    assert langid._counts(["Ab,  cd9"], langid.ORDERS, 15).sum() == sum(counted.values())
    got = langid.predict(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3, 5))
    assert langid.predict(empty, model, ["doc_id"]).count() == 0
    nothing = langid.fit(empty)
    assert nothing.labels == () and {r.lang_pred for r in langid.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}


def brute_classes(rows):
    sets = {}
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d]) for d in sets}


def test_shingle_join(spark, mixed, odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(mixed).collect()}
    want = brute_classes([(r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect()])
    assert got == want and len({c for _, c in got.values()}) < len(got)
    out = shingle_join.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {(r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id in (1, 2, 3)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert shingle_join.near_duplicates(empty).count() == 0


def test_shingle_join_small_tiles(spark, mixed, monkeypatch):
    for name, value in (("BLOCK_ROWS", 3), ("TILE_SHINGLES", 200), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(shingle_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(mixed).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect()])


def test_bitmaps_bound_from_above():
    """No pair that links is lost by bitmaps of any width."""
    rng = np.random.RandomState(8)

    def may_link(x, y):
        a, b = shingle_join._signature(x), shingle_join._signature(y)
        words = min(len(a), len(b)) // 8
        differing = int(np.bitwise_count(shingle_join._fold(a, words) ^ shingle_join._fold(b, words)).sum())
        return shingle_join._may_link(len(x), len(y), differing, 80, 100)

    for n in (1, 40, 500, 530, 700, 1000, 1100, 5000):
        for share in (0.0, 0.85, 0.9, 0.95, 1.0):
            for m in (n, int(n * 1.1)):
                both = rng.randint(0, 2**62, int(n * share) + 1).astype(np.uint64)
                x, y = (np.unique(np.concatenate((both, rng.randint(0, 2**62, k - int(n * share)).astype(np.uint64)))) for k in (n, m))
                assert may_link(x, y) or not shingle_join._linked(x, y, 80, 100)
    for n in (300, 1000, 2000, 3000):
        x, y = rng.randint(0, 2**62, n).astype(np.uint64), rng.randint(0, 2**62, n).astype(np.uint64)
        assert not may_link(x, y)


def test_shingle_join_shared_passage(spark):
    """A passage in hundreds of documents makes no candidates among them."""
    passage, rows = prose(950, 60), []
    for i in range(300):
        rows.append((i, f"{prose(1000 + i, 40)} {passage}", "en", "s"))
    rows += [(300, prose(2000, 3000), "en", "s"), (301, prose(2000, 2990) + " a b c", "en", "s"), (302, rows[7][1] + " more", "en", "s")]
    docs = documents(spark, rows)
    want = {d: (n, c) for d, (n, c) in brute_classes([(r[0], r[1]) for r in rows[7:8] + rows[300:]]).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(docs).collect()}
    assert {d: got[d] for d in want} == want and all(got[d][1] == d for d in range(300))
    keyed = docs.select(F.col("doc_id").alias("id"), "text")
    table = shingle_join._order_table(shingle_join._scan(keyed.select("id", F.lit(False).alias("gone"), "text", F.lit(0).cast("long").alias("tx")), 5).where("chunk is not null"))
    assert shingle_join._lists(shingle_join._prefixes(keyed, table, 5, 80, 100)).groupBy("h").count().agg(F.max("count")).first()[0] <= 3


def test_shingle_join_one_id_with_two_texts(spark):
    """The id is one node: it links to what either of its texts links to."""
    a, b = prose(3000, 60), prose(3001, 60)
    rows = [(3, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (9, b + " x", "en", "s"), (10, prose(3002, 60), "en", "s")]
    got = {(r.doc_id, r.component_id) for r in shingle_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (10, 10)}


def test_shingle_join_wide_tiles(spark):
    """Members that share shingles but not a class with the smallest member."""
    base, rows = prose(900, 60).split(), []
    for i in range(24):
        words = list(base)
        for k in range(i % 6):
            words[(7 * k + i) % 60] = f"w{i}"
        rows.append((i, " ".join(words), "en", "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_classes([(r[0], r[1]) for r in rows])


def test_mixing(spark, odd, empty):
    rows = [(i, prose(i, 5 + i % 40), None, ("a", "b", "c", None)[i % 4]) for i in range(2000)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert {(r.doc_id, r.size) for r in got} == {(i, len(t.split())) for i, t, _, _ in rows}
    total, share = sum(r.size for r in got), {"a": 5, "b": 2, "c": 1, None: 5}
    for s, w in share.items():
        own = [r for r in got if r.source == s]
        assert math.isclose(own[0].target, total * w / 13) and own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.02 * own[0].target
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0


def brute_mix(rows, seed=0):
    """Ranks and copies by plain sorting; rows as for ``documents`` with distinct ids."""
    held = collections.defaultdict(list)
    for d, t, _, s in rows:
        key = str(d)
        held[s].append((len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), key, d))
    names = sorted(held, key=lambda s: (s is None, s or ""))
    goals = mixing.targets([sum(x[0] for x in held[s]) for s in names])
    return names, dict(zip(names, goals, strict=True)), held


def test_mixing_meets_targets_with_large_documents(spark):
    """A document of a fifth of its source does not move the mix off its target, and
    the copies of the others are the crossings of plain running sums."""
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randint(1, 90)), None, ("a", "b", "c")[i % 3]) for i in range(900)] + [(1000 + k, prose(k, n), None, s) for k, (n, s) in enumerate([(9000, "a"), (4000, "a"), (3000, "b"), (20_000, "c"), (700, "c")])]
    got = {r.doc_id: r for r in mixing.mix(documents(spark, rows).withColumn("extra", F.col("doc_id") * 2), keep=["extra"]).collect()}
    names, goals, held = brute_mix(rows)
    assert all(r.extra == 2 * d for d, r in got.items())
    for s in names:
        own = [got[d] for _, _, d in held[s]]
        assert math.isclose(own[0].target, goals[s]) and abs(sum(r.taken for r in own) - goals[s]) <= 0.005 * goals[s]
        large = sorted((r for r in own if r.size > mixing.LARGE * goals[s]), key=lambda r: -r.size)[: mixing.LARGE_DOCUMENTS]
        rate = goals[s] / own[0].source_size
        assert sum(r.taken for r in large) == sum(c * r.size for c, r in zip(mixing.whole_copies([r.size for r in large], rate), large, strict=True))
        assert all(r.copies in (int(rate), int(rate) + 1) for r in large)
        rest = [r for r in own if r not in large]
        left = (goals[s] - sum(r.taken for r in large)) / max(1, sum(r.size for r in rest))
        assert sum(r.copies for r in rest) in (math.floor(left * len(rest)), math.ceil(left * len(rest)))
        by_size = sorted(rest, key=lambda r: r.size)
        for k in range(0, len(by_size), 25):
            assert abs(sum(r.copies for r in by_size[:k]) - left * k) <= 1


def test_mixing_of_the_given_documents(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    off = got.groupBy("source").agg((F.abs(F.sum("taken") - F.max("target")) / F.max("target")).alias("off"))
    assert off.agg(F.max("off")).first()[0] < 0.02


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([10, 90]) == [30.0, 70.0]
    assert mixing.targets([1, 1, 98]) == [3.0, 3.0, 94.0]
    for sizes in ([5, 1, 7, 100, 3], [1000, 1, 1, 1]):
        out = mixing.targets(sizes)
        assert math.isclose(sum(out), sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(out, sizes, strict=True))


def test_pseudo_likelihood(spark, odd, empty):
    rows = [(i, " ".join("a b c d".split() * (20 + i)), None, None) for i in range(200)]
    shuffled = "a b c d".split() * 20
    random.Random(1).shuffle(shuffled)
    docs = documents(spark, rows)
    net = pseudo_likelihood.train(docs)
    test = documents(spark, [(1, rows[0][1], None, None), (2, " ".join(shuffled), None, None)])
    got = {r.doc_id: r for r in pseudo_likelihood.score(test, net).collect()}
    assert got[1].mean_pll > got[2].mean_pll + 0.3 and got[1].n_tokens == 80
    out = {r.doc_id: r for r in pseudo_likelihood.score(odd, net).collect()}
    assert out[1].pll == out[2].pll == 0 and out[3].mean_pll is None
    assert pseudo_likelihood.score(empty, pseudo_likelihood.train(empty)).count() == 0


def small_network(dtype=np.float32):
    net = pseudo_likelihood.Network.fresh(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return pseudo_likelihood.Network(net.known, net.symbol, *(x.astype(dtype) for x in (net.embed, net.place)), [x.astype(dtype) for x in net.out], [x.astype(dtype) for x in net.bias])


def test_network_gradient_against_differences():
    rng = np.random.RandomState(5)
    net = small_network(np.float64)
    around, target = rng.randint(0, pseudo_likelihood.SYMBOLS + 1, (30, 4)), rng.randint(0, pseudo_likelihood.SYMBOLS, 30)
    around[3] = around[4] = around[5]
    target[7] = target[8]
    for array, gradient in zip(net.arrays(), net.gradient(around, target), strict=True):
        where = [tuple(x) for x in np.argwhere(gradient)[:: max(1, np.count_nonzero(gradient) // 5)]]
        for at in where[:5]:
            held, side = array[at], []
            for step in (1e-5, -1e-5):
                array[at] = held + step
                side.append(-net.log_prob(around, target).mean())
            array[at] = held
            assert math.isclose((side[0] - side[1]) / 2e-5, gradient[at], rel_tol=1e-4, abs_tol=1e-9)


def test_network_is_normalised_and_learns():
    rng = np.random.RandomState(6)
    net = small_network()
    every = np.arange(pseudo_likelihood.SYMBOLS)
    around = np.tile(rng.randint(0, 100, (1, 4)), (len(every), 1))
    assert math.isclose(np.exp(net.log_prob(around, every)).sum(), 1, rel_tol=1e-4)
    around = rng.randint(0, 50, (20_000, 4))
    target = around[:, 1] * 7 % 50 + 300
    before = net.log_prob(around, target).mean()
    net.learn(around, target)
    assert net.log_prob(around, target).mean() > before + 3


def test_pseudo_likelihood_depends_on_rows_only(spark):
    """The same rows in one and in many partitions, in any order, give the same scores."""
    docs = documents(spark, [(i, prose(i % 50, 40 + i), None, None) for i in range(120)])
    told = []
    for rows in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id"))):
        net = pseudo_likelihood.train(rows, shard_tokens=2000)
        told.append({r.doc_id: r.mean_pll for r in pseudo_likelihood.score(docs, net).collect()})
    assert all(math.isclose(told[0][d], other[d], abs_tol=1e-4) for other in told[1:] for d in told[0])


def test_pseudo_likelihood_against_plain_sums(spark):
    """Scores of Spark are the plain sums over words one by one, and every document is learned from."""
    rows = [(i, prose(i, 5 + i), None, None) for i in range(30)]
    docs = documents(spark, rows)
    net = pseudo_likelihood.train(docs)
    assert len(net.known) == len({w for r in rows for w in r[1].split()})
    for r in pseudo_likelihood.score(docs, net).collect():
        words = [net.symbols(np.array([pseudo_likelihood.hash_words([w.encode()])[0][0]], np.uint64))[0] for w in rows[r.doc_id][1].split()]
        padded = [pseudo_likelihood.SYMBOLS] * 2 + words + [pseudo_likelihood.SYMBOLS] * 2
        total = sum(float(net.log_prob(np.array([[padded[k], padded[k + 1], padded[k + 3], padded[k + 4]]]), np.array([w]))[0]) for k, w in enumerate(words))
        assert r.n_tokens == len(words) and math.isclose(r.pll, total, rel_tol=1e-4)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = prose(300, 30)
    rows = [(i, prose(i, 60 + i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(30, rows[4][1], "en", "s0"), (31, prose(31, 40) + " " + item, "en", "s1"), (32, None, "en", "s1"), (33, "123 !!", "en", None), (34, prose(34, 30) + " bob@x.example", "en", "s2")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "mix":
            assert docs.columns == DOCS.replace(",", "").split()[::2]
    clean = set(range(30)) | {34}
    assert kept["language"] == clean | {30, 31} and kept["near_duplicates"] == clean | {31} and kept["decontaminate"] == kept["sanitise"] == clean
    assert spark.read.parquet(f"{tmp_path}/sanitise").where("doc_id = 34 and text like '%[EMAIL]'").count() == 1
    assert kept["mix"] <= clean
    ran = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(ran) == kept["mix"]


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Null ids, repeated rows and a very long text pass; an empty table stays empty."""
    import corpus_pipeline

    for name, frame in (("odd", odd.union(documents(spark, [(i, prose(40 + i, 50), "en", "a") for i in range(20, 30)]))), ("empty", empty)):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, prose(600, 30)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, f"{tmp_path}/odd").write.parquet(f"{tmp_path}/odd/{name}")
        docs = spark.read.parquet(f"{tmp_path}/odd/{name}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert None in ids and not {1, 2, 3, 5} & set(ids) and ids.count(4) == (2 if name == "language" else 1)
    assert not {1, 2, 3, 5} & {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}


def test_predict_gives_way_on_clashing_names(spark):
    docs = documents(spark, [(i, prose(i, 20), "en", "a") for i in range(10)]).withColumns({"score": F.lit(1), "lang_pred": F.lit("x")})
    out = langid.predict(docs, langid.fit(docs), ["doc_id", "score", "lang_pred"])
    assert out.columns == ["doc_id", "lang_pred", "score"] and {r.lang_pred for r in out.select("lang_pred").collect()} == {"en"}


def test_sanitise_counts_repeated_rows_once(spark):
    """Rows repeated with their id count as one text."""
    base = [(i, f"Zorbalix wrote to bob@x.example about {prose(i, 8)}", None, None) for i in range(4)] + [(i, prose(i, 12), None, None) for i in range(10, 60)]
    one = {r.doc_id: r.spans for r in sanitise.detect(documents(spark, base)).collect()}
    many = {r.doc_id: r.spans for r in sanitise.detect(documents(spark, base + base[:3] + base[:2] + [(90, base[0][1], None, None)])).collect()}
    assert all("term:" in one[i] for i in range(4)) and {i: many[i] for i in one} == one and many[90] == one[0]


def test_rows_are_reduced_all_at_once():
    """Largest and sum of every row equal those of numpy to the last bit, so the network does not change."""
    model = pseudo_likelihood
    rows = (np.random.RandomState(5).randn(4_000, model.BRANCHES) * 50).astype(np.float32)
    assert (model._largest(rows) == rows.max(1)).all() and (model._sums(np.exp(rows / 9)) == np.exp(rows / 9).sum(1)).all()
    assert model._sums(rows[:0]).shape == model._largest(rows[:0]).shape == (0,)
