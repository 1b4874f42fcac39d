"""Every operator against brute force on small hard tables."""

import base64
import gzip
import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from coterie.llm import (
    arrow, bpe, chat, components, decontaminate, embeddings, quality, queries, samples, simhash, substrings, tiles, tokens,
    toxicity, urls,
)

DOCS = "doc_id long, text string, extra string, fingerprint int, n_words string"


def docs_of(spark, texts):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], DOCS)


def by_id(df, *cols):
    out = defaultdict(list)
    for r in df.collect():
        out[r[0]].append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=str) for k, v in out.items()}


def prose(rng, n, words):
    return " ".join(rng.choice(words, n))


# --- URL filters ------------------------------------------------------------

def test_urls(spark):
    rows = [
        (1, "http://a.org/x", "org/", "allow"), (2, "https://Sub.EXAMPLE.org/es/7?q", "example.org/es/", "block"),
        (3, "http://example.org/en/12", "example.org/en/1", "block"), (4, "http://notexample.org/es/1", "org/", "allow"),
        (5, "http://b.com/de/", "com/de/", "block"), (6, "http://b.com/fr/1#x", "com/fr/", "allow"),
        (7, "http://b.com", None, "allow"), (8, "b.com/de/", None, "allow"), (9, None, None, "allow"), (10, "", None, "allow"),
        (11, "http:///de/", None, "allow"), (12, "http://a.org?x", None, "allow"), (5, "http://b.com/de/", "com/de/", "block"),
        (13, "x://b.com/de/://c.org/", "com/de/", "block"), (14, "http://b.com/de/" + "y" * 5000, "com/de/", "block"),
        (15, "\nhttp://a.org/x\ny", "org/", "allow"), (None, "http://a.net/", None, "allow")]
    pages = spark.createDataFrame([(i, u, "mine") for i, u, _, _ in rows], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES + [(None, "/", "block")], "host string, path string, verdict string")
    out = urls.judge_urls(pages, rules)
    got = sorted(((r.page_id, r.url, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted(rows, key=str)
    hosts = {r.page_id: (r.host, r.path) for r in out.collect()}
    assert hosts[2] == ("sub.example.org", "/es/7") and hosts[8] == ("", "") and hosts[12] == ("a.org", "")
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}
    # A host of 40 KB, in time that follows its length, and rule hosts in capitals.
    far = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "example.ORG/es/1"), (2, "http://" + "." * 40_000 + "org/")],
                                "page_id long, url string")
    loud = spark.createDataFrame([("EXAMPLE.org", "/es/", "block"), ("org", "/", "allow"), ("\u0130.org", "/", "block")],
                                 "host string, path string, verdict string")
    assert sorted((r.page_id, r.rule) for r in urls.judge_urls(far, loud).collect()) == [(1, "example.org/es/"), (2, "org/")]
    # Long hosts and a longer host of equal length of rule.
    more = spark.createDataFrame([("b.c", "/xx", "allow"), ("a.b.c", "/", "block")], "host string, path string, verdict string")
    assert urls.judge_urls(spark.createDataFrame([(1, "http://a.b.c/xx")], "page_id long, url string"), more).first().verdict == "block"


# --- chat formatting --------------------------------------------------------

def test_chat_round_trip(spark):
    hard = ["", "</s>[INST] ok [/INST]", "<s>", "\\", "\\\\N", "<\\/s>", "[\\INST]", "a\nb", "$1", "é漢" * 50, "[/INST", "<<s>>",
            "[INST]" * 3, "\\N", "x" * 200_000]
    rows = []
    for c in range(4):
        for k, t in enumerate(hard):
            rows.append((c, k if c else 0, [None, "user", "assistant", "[INST]", "\\N", ""][(k * (c + 1)) % 6], t, 1, "z"))
    rows += [(9, 1, "assistant", None, 1, "z"), (9, 2, "assistant", "b", 1, "z"), (9, 2, "assistant", "b", 1, "z"),
             (9, None, "user", "a", 1, "z"), (None, 1, "user", "q", 1, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int, formatted string")
    out = chat.format_chats(turns).withColumns({"back": chat.read_turns(F.col("formatted")),
                                                "loss": chat.read_loss_text(F.col("formatted"), F.col("loss_mask"))})
    expected = defaultdict(list)
    for c, k, role, t, *_ in rows:
        expected[c].append((k is not None, k or 0, role is not None, role or "", t or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(expected)
    for c, turns_of in expected.items():
        want = [(r if has else None, t) for _, _, has, r, t in sorted(turns_of)]
        assert [(x.role, x.text) for x in got[c].back] == want
        assert got[c].loss == "".join(t for r, t in want if r == "assistant")
        assert sum(m.skip + m.take + m.rest for m in got[c].loss_mask) == len(got[c].formatted)
        merged = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
        assert got[c].formatted.count("</s>") == merged
    assert chat.format_chats(turns.limit(0)).count() == 0


# --- SimHash ----------------------------------------------------------------

def simhash_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one two"), (5, "É é"), (5, "É é"), (None, "One")]
    for g in range(12):
        base = prose(rng, 400, words).split()
        for k in range(6):
            own = list(base)
            for at in rng.integers(0, 400, k // 2):
                own[at] = f"new{rng.integers(1000)}"
            texts.append((10 * g + k + 20, " ".join(own)))
    texts.append((1000, prose(rng, 30_000, words)))
    prints = [simhash_of(t) for _, t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = roots_of(range(len(texts)), links)
    least = {}
    for n, (i, _) in enumerate(texts):
        if i is not None:
            least[root[n]] = min(i, least.get(root[n], i))
    expected = sorted((str(i), f"{prints[n]:016x}", least.get(root[n])) for n, (i, _) in enumerate(texts))
    docs = docs_of(spark, texts)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == expected
    assert len(set(root.values())) < len(texts) - 20
    kept = sorted(str(r.doc_id) for r in simhash.one_of_each_group(docs).collect())
    assert kept == sorted([str(i) for i in set(least.values())] + ["None"])
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_near_links_of_crowded_blocks(spark, monkeypatch):
    """A chain and a crowd that share bit blocks, in tiles of seven rows."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))}
    prints |= {base ^ sum(1 << int(b) for b in rng.integers(0, 20, 9)) for _ in range(150)}
    prints |= {int(x) for x in rng.integers(0, 2**63, 100)}
    prints = sorted({x - 2**64 if x >= 2**63 else x for x in prints})
    deal = tiles.deal
    monkeypatch.setattr(tiles, "deal", lambda df, keys, row: deal(df, keys, row, 7))
    found = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"))
    got = roots_of(prints, [(r.u, r.v) for r in found.collect()])
    links = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert got == roots_of(prints, links)
    assert all(((r.u ^ r.v) & (2**64 - 1)) for r in found.collect())


def test_tiles_meet_once(spark):
    rows = [(k, n) for k, size in enumerate([1, 3, 50, 11]) for n in range(size)]
    dealt = tiles.deal(spark.createDataFrame(rows, "k long, n long"), ["k"], "n", 10).collect()
    met = defaultdict(list)
    for r in dealt:
        met[r.k, r.a, r.b].append(r)
    pairs = [(k, *sorted((x.n, y.n))) for (k, a, b), rs in met.items() for i, x in enumerate(rs) for y in rs[:i]
             if x.tile != y.tile or a == b]
    assert sorted(pairs) == sorted((k, i, j) for k, size in enumerate([1, 3, 50, 11]) for j in range(size) for i in range(j))


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(int(a), int(b)) for a, b in rng.integers(0, 90, (50, 2))] + [(7, 7)]
    links += [(500, i) for i in range(501, 560)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots_of(nodes, links)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    i, j = (np.array(x) for x in zip(*[(a, b) for a, b in links if a < 90]))
    want = roots_of(range(90), list(zip(i.tolist(), j.tolist())))
    assert components.local_roots(90, i, j).tolist() == [want[n] for n in range(90)]


# --- tokens -----------------------------------------------------------------

def test_token_scan(spark, tmp_path):
    rng = np.random.default_rng(4)
    streams = [[], [9], [9, 9], [1, 2, 3], [1, 9, 2, 2, 9, 9, 3], rng.integers(0, 12, 500).tolist() + [9]]
    want = []
    for n, ids in enumerate(streams):
        raw = np.array(ids, "<u2").tobytes()
        if n % 2:
            (tmp_path / f"part-{n}.gz").write_bytes(gzip.compress(raw))
        else:
            (tmp_path / f"part-{n}").write_bytes(raw)
        begin = 0
        for k, at in enumerate([i for i, x in enumerate(ids) if x == 9] + ([len(ids)] if ids and ids[-1] != 9 else [])):
            want.append((n, k, begin, max(0, at - begin - 2), ids[begin:at][:2]))
            begin = at + 1
    for block in (1, 3, 7, 1000):
        got = [(int(r.file.split("part-")[1][0]), r.document, r.start, r.n_tokens, list(r["head"])) for r in tokens.scan_token_files(
            spark, str(tmp_path), 9, head=2, block=block).collect()]
        assert sorted(got) == sorted(want), block


def test_token_counts(spark, tmp_path):
    ids = [5, None, -3, 2**62, 0, 0, 8191, -2**63]
    counts = [3, 2, 0, 70_000, 1, 1, 5, 7]
    rows = [(i, np.full(n, 50255, "<u4").tobytes() if n else None, "c") for i, n in zip(ids, counts)]
    docs = spark.createDataFrame(rows, "doc_id long, ids binary, record string")
    got = sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs, str(tmp_path / "t"), 50256).collect())
    assert got == sorted((-1 if i is None else i, n) for i, n in zip(ids, counts))
    assert tokens.token_counts(docs.limit(0), str(tmp_path / "u"), 50256).count() == 0
    with pytest.raises(Exception, match="separator"):
        tokens.token_counts(docs, str(tmp_path / "v"), 50255).count()


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    texts = ["", None, "a", "hello world's they're we'll 've", " " * 300, "x" * 900, "ab " * 200, "日本語" * 90, "🙂é" * 150,
             "a\n\n  b\t\t c   " * 60, "'" * 200 + "'re" * 100, "1234567" * 80, "<|endoftext|>" * 30, "…" * 200]
    alphabet = list("ab 1'\n\t  re.é")
    texts += ["".join(rng.choice(alphabet, 700)) for _ in range(40)]
    texts.append("word " * 20_000)
    docs = docs_of(spark, [(i, t) for i, t in enumerate(texts)] + [(50, texts[50]), (None, "x" * 400), (50, "other " * 90)])
    for chunk, overlap in ((64, 24), (37, 20), (1 << 15, 1 << 9)):
        out = bpe.decode_ids(bpe.encode_texts(docs, queries.RANKS, queries.PATTERN, chunk=chunk, overlap=overlap),
                             queries.RANKS, queries.PATTERN)
        got = by_id(out, "ids", "n_tokens", "decoded")
        want = defaultdict(list)
        for r in docs.collect():
            ids = np.array(encoder.encode_ordinary(r.text or ""), "<u4")
            want[r.doc_id].append((bytearray(ids.tobytes()), len(ids), bytearray((r.text or "").encode())))
        as_bytes = lambda rows: sorted((bytes(a), n, bytes(b)) for a, n, b in rows)
        assert {k: as_bytes(v) for k, v in got.items()} == {k: as_bytes(v) for k, v in want.items()}
    assert bpe.encode_texts(docs.limit(0), queries.RANKS, queries.PATTERN).count() == 0


# --- passages ---------------------------------------------------------------

def removed_of(texts, window):
    """The contract by brute force: repeated (id, text) rows are one document."""
    first = {}
    parsed = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    for i, ws in parsed:
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s:s + window])
            if i is not None:
                first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, ws in parsed:
        gone = set()
        for s in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[s:s + window])] < (i, s):
                gone |= set(range(s, s + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def test_grown_factors():
    """Pieces of four-word windows: the second follows the first in its reference, the
    third is another reference, the fourth skips a window, the fifth is another text."""
    rows = [(0, 0, 6, 9, 10), (0, 3, 8, 9, 13), (0, 5, 9, 8, 5), (0, 7, 12, 8, 7), (1, 9, 14, 8, 9)]
    got = substrings.grown_factors(4, *map(np.array, zip(*reversed(rows))))
    assert list(zip(*(a.tolist() for a in got))) == [(0, 0, 8, 9, 10), (0, 5, 9, 8, 5), (0, 7, 12, 8, 7), (1, 9, 14, 8, 9)]


@pytest.mark.parametrize("window", [20, 9])
def test_substrings(spark, window):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}é" for i in range(60)]
    passages = [prose(rng, n, vocabulary) for n in (19, 20, 21, 45, 90)]
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 70), (4, "a b " * 40), (5, "a " * 25)]
    for i in range(6, 60):
        parts = [prose(rng, int(rng.integers(1, 30)), vocabulary)]
        for _ in range(3):
            own = passages[rng.integers(5)].split()
            if rng.random() < 0.5:
                own[rng.integers(len(own))] = "edit"
            parts += [" ".join(own), prose(rng, int(rng.integers(1, 12)), vocabulary)]
        texts.append((i, "\n".join(parts)))
    texts += [(70, texts[20][1]), (71, texts[21][1]), (71, texts[21][1]), (72, texts[22][1]), (72, passages[4]), (None, texts[9][1]),
              (80, "  ".join(f"u{i}" for i in range(30_000)))]
    out = substrings.remove_duplicate_spans(docs_of(spark, texts), window)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=str)
    assert got == sorted(removed_of(texts, window), key=str)
    texts_of = defaultdict(list)
    for i, t in texts:
        texts_of[i].append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    grown = 0
    for r in out.collect():
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed
        # The factors cover what went, and each stands in its reference, which is earlier.
        own = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert {k for f in r.factors for k in range(f.begin, f.end)} == {k for s in r.spans for k in range(s.begin, s.end)}
        for f in r.factors:
            assert f.end - f.begin >= window and (f.ref_doc, f.ref_begin) < (r.doc_id, f.begin)
            assert any(ref[f.ref_begin:f.ref_begin + f.end - f.begin] == own[f.begin:f.end] for ref in texts_of[f.ref_doc])
            grown += f.end - f.begin > 2 * window
        # No factor goes on in the next one's reference.
        for a, b in zip(r.factors, r.factors[1:]):
            assert (a.ref_doc, a.ref_begin - a.begin) != (b.ref_doc, b.ref_begin - b.begin) or b.begin > a.end - window + 1
    assert grown
    assert substrings.remove_duplicate_spans(docs_of(spark, texts).limit(0)).count() == 0


def words9(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "漢字"]
    items = [(i, prose(rng, int(rng.integers(13, 40)), vocabulary)) for i in range(12)]
    items += [(20, "Short one here"), (21, "single"), (22, ""), (23, None), (24, "a B c d e f g"), (2, items[2][1]), (None, "null item words")]
    texts = [(0, None), (1, ""), (2, "..."), (3, "SINGLE"), (4, "x short, one-here y"), (5, "a b c d e f g a b c d e f g"), (6, "null item words")]
    for i in range(10, 60):
        own = prose(rng, int(rng.integers(1, 300)), vocabulary).split()
        if i % 3:
            quoted = items[rng.integers(12)][1].upper().split()
            lo = rng.integers(0, 5)
            own[5:5] = quoted[lo:lo + int(rng.integers(11, 20))]
        texts.append((i, ", ".join(own)))
    texts += [(10, texts[12][1]), (None, texts[13][1]), (11, texts[11][1]), (99, prose(rng, 20_000, [f"z{i}" for i in range(500)]))]
    known = {}
    for item, t in items:
        ws = words9(t)
        n = min(len(ws), 13)
        for s in range(len(ws) - n + 1 if ws else 0):
            known.setdefault(tuple(ws[s:s + n]), set()).add(item)
    want = []
    for i, t in texts:
        ws, hit, found = words9(t), set(), set()
        for n in {len(k) for k in known}:
            for s in range(len(ws) - n + 1):
                if tuple(ws[s:s + n]) in known:
                    hit |= set(range(s, s + n))
                    found |= known[tuple(ws[s:s + n])] - {None}
        want.append((i, len(ws), len(hit), len(found), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(ws)))
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    out = decontaminate.contamination(docs, bench)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = sorted(str(r.doc_id) for r in decontaminate.uncontaminated(docs, bench).collect())
    assert clean == sorted(str(w[0]) for w in want if not w[5])
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count()
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# --- embeddings -------------------------------------------------------------

def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(25):
        base = rng.standard_normal(24)
        base /= np.linalg.norm(base)
        for k in range(8):
            spread = [0, 0, 0.05, 0.08, 0.1, 0.12, 0.14, 0.2][k]
            away = rng.standard_normal(24)
            away -= away @ base * base
            v = base + spread * away / np.linalg.norm(away)
            rows.append((g * 10 + k, (v * rng.uniform(0.1, 9) if k else v).astype(np.float32).tolist(), g % 3))
    dense = rng.standard_normal(24)
    for k in range(60):
        rows.append((1000 + k, (dense + 0.005 * rng.standard_normal(24)).astype(np.float32).tolist(), 1))
    rows += [(2000 + k, rows[0][1], 0) for k in range(4)] + [(2000, rows[0][1], 0)]
    bad = [(3000, None, 0), (3001, [0.0] * 24, 0), (3002, [float("nan")] * 24, 0), (3003, [None] * 24, 0), (3004, [], 0),
           (3005, rows[0][1], None), (3006, rows[0][1][:20], 0), (None, rows[0][1], 0), (3007, [1.0, float("inf")] * 12, 0)]
    data = spark.createDataFrame([(*r, 1, "k") for r in rows + bad], "vec_id long, embedding array<float>, label int, n int, node string")
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near))]
    deal = tiles.deal
    monkeypatch.setattr(tiles, "deal", lambda df, keys, row: deal(df, keys, row, 25))
    got = embeddings.near_vectors(data).collect()
    assert len(got) == len(rows) + len(bad)
    found = sum(r.n_links for r in got)
    assert 0.9 * len(links) <= found <= len(links)
    # Tiles don't change what is found, and with many probes all links are.
    monkeypatch.setattr(tiles, "deal", deal)
    key = lambda rs: sorted(map(str, rs))
    assert key(embeddings.near_vectors(data).collect()) == key(got)
    every = [r for r in embeddings.near_vectors(data, tables=8, probes=40).collect() if r.vec_id is not None and r.vec_id < 3000]
    degree = defaultdict(list)
    for n, r in enumerate(rows):
        degree[r[0]].append(int(near[n].sum()))
    root = roots_of(range(len(rows)), links)
    least = {}
    for n, r in enumerate(rows):
        least[root[n]] = min(r[0], least.get(root[n], r[0]))
    assert by_id_of(every, "n_links") == {k: sorted(v) for k, v in degree.items()}
    assert {r.vec_id: r.component_id for r in every} == {r[0]: least[root[n]] for n, r in enumerate(rows)}
    for r in got:
        if r.vec_id is None or r.vec_id >= 3000:
            assert r.n_links == 0 and r.component_id == r.vec_id
            assert r.kept == (r.vec_id is not None)
    assert embeddings.near_vectors(data.limit(0)).count() == 0


def by_id_of(rows, col):
    out = defaultdict(list)
    for r in rows:
        out[r.vec_id].append(r[col])
    return {k: sorted(v) for k, v in out.items()}


def test_nearest_lattice_point():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200, 8)) * 3
    p = embeddings.nearest_e8(x) / 2
    assert ((p.sum(1) % 2) == 0).all()
    near = embeddings._roots() / 2
    assert len({tuple(r) for r in embeddings._roots().tolist()}) == 240
    for a, b in zip(x, p):
        assert ((a - b) ** 2).sum() <= (((b + near) - a) ** 2).sum(1).min() + 1e-9


# --- classifiers ------------------------------------------------------------

def held_out(scored, labels, label, threshold):
    rows = scored.where(samples.fold() == 1).join(labels, "doc_id").select("score", label).collect()
    y, p = np.array([r[1] for r in rows]), np.array([r[0] for r in rows]) >= threshold
    return (p[y == 1].mean(), p[y == 0].mean())


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.texts(spark, sf), queries.table(spark, sf, "labels")
    field = quality.train(docs, labels)
    found, wrong = held_out(quality.score(docs, field), labels, "quality", 0.5)
    assert found > 0.95 and wrong < 0.1
    hard = docs_of(spark, [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 300_000), (4, "x"), (None, "a\nb")])
    got = quality.score(hard, field).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.extra for r in got} == {"x"}
    assert quality.score(docs.limit(0), field).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(hard, none).collect()} == {0.5}


def test_forward_backward():
    rng = np.random.default_rng(10)
    unary, moves, first = rng.standard_normal((9, 2)), rng.standard_normal((2, 2)), np.array([0, 4, 5, 9])
    z, state, pair = quality.marginals(unary, moves, first, np.ones(9))
    total_pair = np.zeros((2, 2))
    for c, (lo, hi) in enumerate(zip(first, first[1:])):
        weights = {}
        for code in range(2 ** (hi - lo)):
            path = [code >> k & 1 for k in range(hi - lo)]
            weights[tuple(path)] = np.exp(sum(unary[lo + k, s] for k, s in enumerate(path)) + sum(
                moves[a, b] for a, b in zip(path, path[1:])))
        total = sum(weights.values())
        assert np.isclose(np.log(total), z[c])
        for k in range(hi - lo):
            assert np.isclose(sum(w for p, w in weights.items() if p[k]) / total, state[lo + k, 1])
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                total_pair[a, b] += w / total
    assert np.allclose(pair, total_pair)


def test_long_chains_are_walked_in_pieces():
    rng = np.random.default_rng(12)
    first = np.array([0, 1, 30, 37, 90, 91])
    unary, moves, weight = 3 * rng.standard_normal((91, 2)), rng.standard_normal((2, 2)), rng.random(91)
    whole = quality.marginals(unary, moves, first, weight)
    for piece in (1, 2, 7, 53):
        for a, b in zip(whole, quality.marginals(unary, moves, first, weight, piece)):
            assert np.allclose(a, b, rtol=1e-10, atol=1e-12)


def test_quality_of_long_texts_of_short_lines():
    """Blocks of lines give what one block gives; 400,000 lines take seconds."""
    rng = np.random.default_rng(13)
    field = quality.LineField(rng.random(14), rng.random(14) + 0.5, rng.standard_normal((43, 2)),
                              rng.standard_normal((2, 2)), 2.0, -1.0)
    long = "".join(rng.choice(["a b\n", "\n", "X y! z\n", "w" * 900 + " v\n"], 3000, p=[0.5, 0.2, 0.29, 0.01]))
    data, offsets = arrow.flat_text(pa.array([long]))
    raw, weight, first = quality.line_features(data, offsets)
    x = quality._with_neighbours((raw - field.mean) / field.scale, first)
    unary, w, f = quality._unary(field, data, offsets)
    assert np.allclose(unary, x @ field.states) and (w == weight).all() and f.tolist() == first.tolist()
    parts = list(quality.line_blocks(data, offsets, 500))
    assert len(parts) > 20 and (np.concatenate([p[0] for p in parts]) == raw).all()
    started = time.time()
    data, offsets = arrow.flat_text(pa.array(["a b\n" * 400_000]))
    unary, w, f = quality._unary(field, data, offsets)
    assert 0 <= quality._means(unary, field.moves, w, f)[0] <= 1 and len(w) == 400_000
    assert time.time() - started < 20


def test_quality_learns_from_one_row_per_id_and_bounded_lines(spark):
    docs = docs_of(spark, [(i, f"{'good line of words' if i % 2 else '#### !!!!'} {i}\n" * 3) for i in range(60)])
    docs = docs.union(docs.withColumn("text", F.concat(F.lit("zz "), "text")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    y, raw, weight, first = quality._training_lines(samples.training_rows(docs, labels, "quality", 60, one_each=True), 50)
    assert len(y) == 16 and len(raw) == len(weight) == first[-1] == 48
    known = samples.training_rows(docs, labels, "quality", 60, one_each=True)
    assert known.groupBy("doc_id").count().where("count > 1").count() == 0
    assert known.where("text LIKE 'zz %'").count() == 0
    scores = quality.score(docs, quality.train(docs, labels))
    assert {r.doc_id % 2 == (r.score > 0.5) for r in scores.collect()} == {True}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.texts(spark, sf), queries.table(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    found, wrong = held_out(toxicity.score(docs, model), labels, "toxic", 0.7)
    assert found > 0.85 and wrong < 0.02
    hard = docs_of(spark, [(1, None), (2, ""), (3, "!!!"), (4, "you " * 50_000), (4, "x"), (None, "É STUPID idiot, you moron")])
    got = toxicity.score(hard.withColumnRenamed("extra", "probability"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs.limit(0), labels)
    assert {r.score for r in toxicity.score(hard, none).collect()} == {0.0}
