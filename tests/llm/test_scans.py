"""License scan, fill-in-the-middle and filter audit against plain Python."""

import hashlib
import re
from itertools import permutations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.llm import audit, boundaries, licenses, middle, words

DOCS = "doc_id long, text string, lang string, n int, score string, labels string, part int"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, 1, "y", "z", 2) for i, t, lang in rows], DOCS)


# --- words ------------------------------------------------------------------

def test_words_with_patterns_have_hashes_of_their_own():
    a, b = "a", "b"
    for _ in range(10):  # the Thue-Morse words, equal under any sum of powers modulo 2**64
        a, b = a + b, b + a
    short = ["a", "b", "ab", "ba", "a\0", "", "abcdefgh", "abcdefghi", "é", "x" * 63, "x" * 64, "x" * 65, a[:64], b[:64]]
    ws = [w.encode() for w in [a, b, *short]]
    data = np.frombuffer(b"".join(ws), np.uint8)
    ends = np.cumsum([len(w) for w in ws])
    hashes = words.word_hashes(data, np.append(0, ends[:-1]), ends)
    assert len(set(hashes.tolist())) == len(ws)
    assert len(set(words.text_hashes(data, np.append(0, ends)).tolist())) == len(ws)
    again = np.frombuffer(b"__" + b"".join(ws), np.uint8)
    assert (words.word_hashes(again, np.append(0, ends[:-1]) + 2, ends + 2) == hashes).all()


# --- license scan -----------------------------------------------------------

def plain_scan(text, df, n_docs):
    """The contract and the templates, one word at a time."""
    ws = licenses.words_of(text or "")
    found = {}
    for k, (label, phrase) in enumerate(licenses.PHRASES):
        p = licenses.words_of(phrase)
        found[k] = (label, [i for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p])
    places = sorted(i for _, at in found.values() for i in at)
    base = sorted({label for label, at in found.values() if at})
    labels, score = set(base), licenses.MENTION * bool(base)
    idf = lambda w: np.log1p((n_docs + 1) / (df.get(w, 0) + 1))
    index = licenses.Index()
    for t in licenses.TEMPLATES:
        body = licenses.words_of(t.text)
        order = sorted(set(body), key=lambda w: (-idf(w), index.vocabulary.index(w)))[:licenses.RARE]
        total = sum(idf(w) for w in body if w in order)
        hits = sorted((i - j, j) for i, w in enumerate(ws) for j, v in enumerate(body) if v == w and v in order)
        groups = []
        for h in hits:
            if groups and h[0] - groups[-1][-1][0] <= licenses.SLACK:
                groups[-1].append(h)
            else:
                groups.append([h])
        for g in groups:
            share = sum(idf(body[j]) for j in {j for _, j in g}) / total
            lo = max(0, g[0][0] - licenses.SLACK)
            inside = ws[lo:g[-1][0] + len(body) + licenses.SLACK]
            keys = [licenses.words_of(k) for k in t.keys]
            if share >= licenses.SHARE - 1e-12 and all(
                    any(inside[i:i + len(k)] == k for i in range(len(inside) - len(k) + 1)) for k in keys):
                labels.add(t.label)
                score = max(score, min(share, 1.0))
    return (len(ws), len(places), places[0] if places else None, places[-1] if places else None, base, sorted(labels),
            round(score, 9))


def test_license_scan(spark):
    mit, gpl = licenses.TEMPLATES[0].text, licenses.TEMPLATES[5].text
    rng = np.random.default_rng(3)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in licenses.words_of(t.text)}) + ["filler", "mit", "x1"]
    texts = [
        None, "", " \n", "MIT License", "the mit  LICENSE, mit-license; Apache license and general public\nlicense", "mit", "license mit",
        "mit licenses", "mit license" * 3, mit, "/* " + mit.replace(" ", "\n * ") + " */", mit.replace("software", "program"),
        "Copyright\n" + gpl + "\n" + mit + " mit license", gpl.replace("Public License", "Public code License"),
        "Licensed under CC BY-NC 4.0", "cc by nc", "Permission is hereby granted, free of charge " + "filler " * 300 + mit[60:],
        "mit license " * 20_000, "é" + "mit license" + "é", "MIT LICENSE", "mit\0license", "general public", "word " * 50 + "mit license"]
    texts += [" ".join(rng.choice(vocabulary, 120)) for _ in range(30)]
    texts += [t.text for t in licenses.TEMPLATES] + ["mit license"] * 30
    docs = docs_of(spark, [(k, t, "en") for k, t in enumerate(texts)] + [(3, "MIT License", "en"), (None, "mit license", None)])
    df = {}
    every = [*texts, "MIT License", "mit license"]
    for t in every:
        for w in set(licenses.words_of(t or "")):
            df[w] = df.get(w, 0) + 1
    out = licenses.license_labels(docs)
    assert set(docs.columns) <= set(out.columns)
    got = {}
    for r in out.collect():
        row = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
        assert got.setdefault(r.doc_id, row) == row  # repeated rows alike
        for m in r.matches:
            assert m.label in r.labels and 0 <= m.begin < m.end <= r.n_words
    for k, t in enumerate(texts):
        assert got[k] == plain_scan(t, df, len(every)), (k, t and t[:80])
    assert got[None] == (2, 1, 0, 0, ["mit"], ["mit"], 0.5)
    assert got[9][5] == ["mit"] and got[9][4] == [] and got[12][5] == ["gpl", "mit"] and got[14][5] == ["cc-by-nc"]
    assert licenses.license_labels(docs.limit(0)).count() == 0


def test_license_scan_of_texts_without_any_known_word(spark):
    out = licenses.license_labels(docs_of(spark, [(1, "zzz", "en"), (2, "", "en"), (3, None, "en")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.labels, r.score) for r in out) == [
        (1, 1, 0, [], 0.0), (2, 0, 0, [], 0.0), (3, 0, 0, [], 0.0)]


def test_license_index_refuses_empty_phrases():
    with pytest.raises(ValueError):
        licenses.Index((licenses.Template("x", "some words", ("--",)),))


# --- fill-in-the-middle -----------------------------------------------------

@pytest.mark.parametrize("values", [
    [], [0], [5, 65_535, 65_536, 65_537, 200_000], list(range(70_000)), list(range(0, 300_000, 3)),
    list(range(0, 140_000, 40)), [*range(100), *range(65_530, 65_540), *range(131_072, 200_000, 2)]])
def test_boundary_set(values):
    found = boundaries.BoundarySet(np.array(values, np.int64))
    assert len(found) == len(values)
    some = range(len(values)) if len(values) < 2000 else np.random.default_rng(1).integers(0, len(values), 2000).tolist()
    assert all(found.select(k) == values[k] for k in some)
    probes = np.random.default_rng(2).integers(0, max(values, default=1) + 70_000, 500).tolist() + values[:50]
    assert [found.rank(x) for x in probes] == np.searchsorted(values, probes).tolist()
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            found.select(k)


def test_boundary_set_takes_the_smallest_container():
    kinds = [type(c).__name__ for c in boundaries.BoundarySet(np.array(
        [3, 9, *range(65_536, 131_072), *range(131_072, 196_608, 2)])).containers]
    assert kinds == ["ArrayContainer", "RunContainer", "BitmapContainer"]


def plain_middle(doc_id, text, unit):
    text = text or ""
    units = list(text) if unit == "character" else re.findall(
        r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in middle.MARKS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", middle.UNITS)
def test_fill_in_middle(spark, unit):
    rng = np.random.default_rng(5)
    pieces = ["a", "é", "漢字", " ", "\n\t", " ", "\u0085", "<", "<S", ">", "<<", "😀", "\x0b", "x" * 70_000, "\\", "$1", "P>"]
    texts = [None, "", " ", "a", "a ", "  a", "<P>", "x <M> y", "<S", "\r\n", "w " * 90_000, "ab" * 100_000]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(300)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(13, "a b c", "en"), (None, "a b c d", "en"), (-4, "a b c d", None)]
    docs = docs_of(spark, rows)
    out = middle.fill_in_middle(docs, unit=unit).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    assert set(docs.columns) <= set(out.columns)
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=str)
    want = sorted(((i, t, *plain_middle(i, t, unit)) for i, t, _ in rows), key=str)
    assert got == want
    assert out.where("back <> coalesce(text, '')").count() == 0
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


# --- filter audit -----------------------------------------------------------

def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, part in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and first[t] < i}
        parts.setdefault(part or "", []).append((i, {f for f, x in fails.items() if x}))
    out = []
    for part, docs in parts.items():
        shapley, some = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                some.append((part, order, step, f, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone),
                             sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(*row, shapley[row[3]]) for row in some]
    return sorted(out)


def test_filter_audit(spark):
    rng = np.random.default_rng(7)
    longs = " ".join(f"w{k}" for k in range(250))
    pool = [None, "", " ", "short", "SHORT #1", longs, longs + " #", "W" + longs.upper(), "same " * 300, "SAME " * 300,
            "é" * 50 + " A", "a|b", "A" * 3 + "x" * 97, "A" * 4 + "x" * 96, "w " * 99 + "v " * 101, "a b " * 200, "x" * 100_000]
    rows = [(int(rng.integers(0, 90)), pool[rng.integers(len(pool))], [None, "", "en", "de", "fr"][rng.integers(5)])
            for _ in range(160)]
    rows += [(None, None, "en"), (None, "short", "de"), (None, "short", "de"), (1, longs + " own", "lone"), (200, "short", "late")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.integers(0, 95, 60)]
    labels += [(None, 1, 1), (200, None, 1), (200, 0, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    cols = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    for shuffled in (docs, docs.repartition(7)):
        got = sorted(tuple(r[c] for c in cols) for r in audit.filter_audit(shuffled, table).collect())
        assert got == plain_audit(rows, labels)
    assert audit.filter_audit(docs.limit(0), table).count() == 0
    assert audit.filter_audit(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_potentials_divide_without_rest(spark):
    """Shares of any game add up to the worth of all, and equal the mean over all orders."""
    rng = np.random.default_rng(11)
    k = 4
    cells = [(s, int(n)) for s, n in enumerate(rng.integers(0, 50, 2 ** k))]
    worth = [sum(n for f, n in cells if f & s) for s in range(2 ** k)]
    row = spark.createDataFrame([(worth,)], "worth array<bigint>").select(audit.potentials("worth[s]", k).alias("p")).first()
    full = 2 ** k - 1
    for i in range(k):
        total = sum(worth[before | 1 << i] - worth[before] for order in permutations(range(k))
                    for before in [sum(1 << j for j in order[:order.index(i)])])
        assert row.p[full] - row.p[full ^ 1 << i] == total
    assert sum(row.p[full] - row.p[full ^ 1 << i] for i in range(k)) == worth[full] * factorial(k)


def test_audit_of_other_filters(spark):
    docs = docs_of(spark, [(1, "a b", "en"), (2, "a", "en"), (3, None, "en")])
    out = audit.filter_audit(docs, failures={"X": F.length("text") > 1, "Y": F.col("text").contains("a")}, copies=None)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in out.collect()}
    assert got == {("XY", 1): (2, 1, 0, 1), ("XY", 2): (1, 1, 1, 3), ("YX", 1): (1, 2, 0, 3), ("YX", 2): (1, 0, 1, 1)}
    with pytest.raises(ValueError):
        audit.filter_names({"long name": F.lit(True)})
