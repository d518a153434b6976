"""The training-data operators against brute force, on odd rows and on planted cases."""

import hashlib
import html
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.llm import chat, common, decontam, extraction, jaccard, langid, linedup, packing, quality, secretscan, textcore, urls
from loomframe.llm.queries import URL_RULES, tokenizer

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [None, "", " \t\n ", "One", "ONE two", "a b c d e", "A\x0bB\fc d e f", "é ñ x y z w", "x" * 3000, " ".join(WORDS * 400), "l1\n\nl1\n  L1  \nlong enough line\nlong enough line"]
SCHEMA = "doc_id long, text string, source string, key string, token long, line string, node long, n long"


def corpus(n=160, seed=4):
    """Random texts, copies, near copies and odd rows, with clashing columns."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 120))) for _ in range(n)]
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(150))
    for _ in range(40):
        words = base.split()
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [base] * 12 + texts[:5] + ODD
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "k", 1, "l", 2, 3) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# textcore


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
def test_spans_are_words(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got = []
    for _, _, data, offsets in textcore.chunks(batch):
        s = textcore.Spans(data, offsets, textcore.SPACE)
        for d in range(len(offsets) - 1):
            got.append([bytes(data[s.start[i] : s.end[i]]).decode() for i in range(s.at[d], s.at[d + 1])])
    assert got == [words(t) for t in texts]


# op 5


def shingles(t):
    w = words(fold(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize(("seed", "together", "hot"), [(4, 256, 1024), (5, 1, 1024), (6, 5, 2), (7, 256, 0)])
def test_jaccard_components(spark, monkeypatch, seed, together, hot):
    monkeypatch.setattr(jaccard, "_TOGETHER", together)
    monkeypatch.setattr(jaccard, "_HOT", hot)
    rows = corpus(seed=seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(frame(spark, rows)).documents.collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("together", [256, 3])
def test_jaccard_links_are_all_links(spark, monkeypatch, together):
    monkeypatch.setattr(jaccard, "_TOGETHER", together)
    rows = corpus(n=60, seed=5)
    sets = {}
    for r in rows:
        w = words(fold(r[1]))
        sets[r[0]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    near = {(x, y) for x, y in itertools.combinations(sorted(sets), 2) if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    join = jaccard.jaccard_join(frame(spark, rows))
    ids = defaultdict(set)
    for r in join.members.collect():
        ids[r.node].add(r.doc_id)
    links = join.links.collect()
    got = {tuple(sorted((x, y))) for r in links for x in ids[r.a] for y in ids[r.b]}
    assert got == {(x, y) for x, y in near if sets[x] != sets[y]} and len({(r.a, r.b) for r in links}) == len(links)
    assert all((r.shared, r.joined) == (len(sets[r.a] & sets[r.b]), len(sets[r.a] | sets[r.b])) for r in links)
    assert join.connecting.count() < len(links)
    counts = Counter(x for pair in near for x in pair)
    assert {r.doc_id: r.n_links for r in join.link_counts.collect()} == {i: counts[i] for i in sets}
    # an id with two texts has the links of both
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (3, "h i j k l m n"), (4, "o p q"), (None, "a b c d e f g"), (5, None)]
    twice = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_links for r in twice.link_counts.collect()}[1] == 2 and {r.doc_id: r.n_links for r in twice.link_counts.where("doc_id > 3").collect()} == {4: 0, 5: 0}


def test_jaccard_shingles_taken_for_rare_ones(spark, monkeypatch):
    """A passage in many unlinked documents, with an order that knows no frequency: the exact counts keep the candidates few."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(40)
    near = [words(60) for _ in range(20)]
    rows = [(i, " ".join(words(30) + passage + words(30)), *[None] * 6) for i in range(600)] + [(1000 + 2 * i + j, " ".join(t[: 60 - j] + passage), *[None] * 6) for i, t in enumerate(near) for j in range(2)]
    monkeypatch.setattr(jaccard, "frequency_classes", lambda blocks: np.zeros(1 << jaccard.FREQ_BITS, np.uint8))
    sizes, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: sizes.append(pairs.count()) or verified(pairs, *rest))
    met = {}
    for hot in (1024, 64):
        monkeypatch.setattr(jaccard, "_HOT", hot)
        sizes.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(frame(spark, rows)).documents.collect()}
        assert got == brute_components(rows)
        met[hot] = sizes[1]
    assert met[64] < 640 < met[1024]  # the second turn's candidates: fewer than documents, against all pairs under the passage


def test_jaccard_odd_rows(spark):
    assert jaccard.jaccard_join(empty(spark)).documents.count() == 0
    text = " ".join(WORDS)
    rows = [(None, text, *[None] * 6), (3, text, *[None] * 6), (3, text, *[None] * 6), (9, text.upper(), *[None] * 6), (4, None, *[None] * 6)]
    got = sorted(jaccard.jaccard_join(frame(spark, rows)).documents.collect(), key=str)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter([(None, 20, None), (3, 20, 3), (3, 20, 3), (9, 20, 3), (4, 0, 4)])


def test_runs_over_batches():
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted({(rng.randrange(20), rng.randrange(3), rng.randrange(30)) for _ in range(120)})
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in b]), pa.array([r[2] for r in b]), pa.array([r[1] for r in b], pa.int32()), pa.array([10] * len(b))], names=["token", "doc_id", "place", "n"]) for b in (rows[i : i + size] for i in range(0, len(rows), size))]
        out = [x for b in jaccard._runs(80)(iter(batches)) for x in b.to_pylist()]
        by = defaultdict(list)
        for t, _, x in rows:
            by[t].append(x)
        want = Counter((t, x, xs[0]) for t, xs in by.items() if len(xs) > 1 for x in xs)
        assert Counter((r["token"], r["node"], r["pivot"]) for r in out if not r["edge"]) == want


# op 4


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = corpus() + [(900, "A <|endoftext|> b", *[None] * 6), (901, "  漢字 \x1c ok", *[None] * 6), (None, "x y", *[None] * 6)]
    t = Tokenizer.from_file(tokenizer()["tokenizer_path"])
    got = packing.pack(frame(spark, rows), **tokenizer(), group_rows=50, with_ids=True)
    out = got.collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        parts = sorted(by[r[0]], key=lambda p: p.piece)
        assert [x for p in parts for x in p.ids] == ids
        assert [p.start for p in parts] == list(itertools.accumulate([0] + [p.length for p in parts]))[:-1]
        assert all(p.length == 1024 for p in parts[1:])
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == list(itertools.accumulate([0] + [n for _, n in sorted(b)]))[:-1] and sum(n for _, n in b) <= 1024
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 1024) + 2
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(got).collect()} == {k: sum(n for _, n in b) for k, b in bins.items()}
    assert packing.pack(empty(spark), **tokenizer()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_is_tightest(lengths):
    left = []
    want = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(50 - n)
    want = sorted(left)
    x = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit(x, 50)
    fill = np.bincount(bins, weights=x).astype(int).tolist() if len(x) else []
    assert sorted(50 - f for f in fill) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from([chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250))]), max_size=200))
def test_both_encoders_give_the_same_ids(text):
    known = tokenizer()
    both = packing.encoder(known["tokenizer_path"], known["ranks_path"], known["pattern"])
    assert both(text) == both.exact.encode(text, add_special_tokens=False).ids


def test_both_encoders_on_documents():
    import pyarrow.parquet as pq

    known = tokenizer()
    both = packing.encoder(known["tokenizer_path"], known["ranks_path"], known["pattern"])
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    texts += ["<|endoftext|> a", "a<|b", "x" * 50_000, " " * 3000 + "a", "漢字 é", "'ll I'LL 'S", "a\u00ad b", "\r\n\r\n \t x"]
    assert all(both(t) == both.exact.encode(t, add_special_tokens=False).ids for t in texts)
    fast = sum(both.fast is not None and bool(packing._PLAIN.fullmatch(t)) for t in texts)
    assert fast > 0.9 * len(texts)


# op 7


def brute_lines(rows):
    key = lambda s: fold(s.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for x in (r[1] or "").split("\n"):
            first.setdefault(key(x), r[0])
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == r[0]]
        out[r[0]] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def brute_row_lines(rows):
    """As brute_lines, for rows that share ids."""
    key = lambda s: fold(s.strip(" \t\n\x0b\x0c\r"))
    least = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            least[key(x)] = min(least.get(key(x), r[0]), r[0])
    return Counter((r[0], "\n".join(x for x in (r[1] or "").split("\n") if len(key(x)) < 10 or least[key(x)] == r[0])) for r in rows)


@pytest.mark.parametrize(("share", "id_bits"), [(4, 22), (4096, 22), (4096, 6)])
def test_line_dedup(spark, monkeypatch, share, id_bits):
    monkeypatch.setattr(common, "ID_BITS", id_bits)
    rng = random.Random(2)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["  Line Number 3 of THE pool\t", "short", "", "hot line hot line"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(["hot line hot line", f"own {i} {j} text"]) for j in range(rng.randrange(0, 40))), *[None] * 6) for i in range(80)]
    rows += [(100 + i, t, *[None] * 6) for i, t in enumerate(ODD)]
    got = linedup.dedup_lines(frame(spark, rows), share=share)
    assert {r.doc_id: (r["__n_lines"], r["__n_dropped"], r.text or "") for r in got.collect()} == brute_lines(rows)
    assert {"key", "line", "token", "node", "n"} <= set(got.columns)


def test_line_keys_fold_ascii_only(spark):
    rng = random.Random(4)
    chars = [chr(c) for c in (*range(9, 14), *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x370, 0x3D0), 0x130, 0x131, 0x1C5, 0x2126, 0x212A, *range(0x2160, 0x2190), *range(0x24B6, 0x24EA), 0x10400, 0x10428, 0x1F130, 0x3A3, 0x3C2, 0xFF21, 0xFF41, 0x6F22)]
    rows = [(i, "".join(rng.choice(chars if i % 3 else "aB cD\t") for _ in range(rng.randrange(12)))) for i in range(3000)] + [(9000 + i, "A" + c + "z") for i, c in enumerate(chars)]
    got = spark.createDataFrame(rows, "i long, line string").select("line", linedup.line_key(F.col("line")).alias("key")).collect()
    assert all(r.key == fold(r.line.strip(" \t\n\x0b\x0c\r")) for r in got)


def test_line_dedup_odd_rows(spark):
    assert linedup.dedup_lines(empty(spark)).count() == 0
    rows = [(None, "same long line here", *[None] * 6), (1, "same long line here\nx", *[None] * 6), (1, "same long line here\nx", *[None] * 6)]
    got = sorted((str(r.doc_id), r.text) for r in linedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [("1", "x"), ("1", "x"), ("None", "same long line here")]


def test_line_dedup_of_unequal_texts_of_an_id(spark):
    rows = [(1, "hello wonderful world", *[None] * 6), (5, "hello wonderful world\nunique line of five", *[None] * 6), (5, "precious own first line\nother second line", *[None] * 6)]
    assert Counter((r.doc_id, r.text) for r in linedup.dedup_lines(frame(spark, rows)).collect()) == brute_row_lines(rows)
    rng = random.Random(8)
    rows = [(rng.randrange(12), "\n".join(f"a line with number {rng.randrange(25)}" for _ in range(rng.randrange(6))), *[None] * 6) for _ in range(60)]
    rows += rows[:9]
    assert Counter((r.doc_id, r.text) for r in linedup.dedup_lines(frame(spark, rows)).collect()) == brute_row_lines(rows)


# op 8

BASE = {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def brute_spans(t):
    out = []
    for k, (kind, (p, g, least)) in enumerate(BASE.items()):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t or "", re.ASCII) if len(m[g]) >= least]
    return [x[2] for x in sorted(out)]


def test_secret_scans_try_missing_rules_only(spark, monkeypatch):
    tried, scan_blobs = [], secretscan.scan_blobs
    monkeypatch.setattr(secretscan, "scan_blobs", lambda blobs, rules: tried.append(Counter((r.blob, r_.kind, r_.version) for r in blobs.collect() for r_ in rules)) or scan_blobs(blobs, rules))
    df = frame(spark, [(1, "token = abcdef123 " + "ab12" * 8, *[None] * 6), (2, None, *[None] * 6), (None, "token = abcdef123 " + "ab12" * 8, *[None] * 6), (2, "secret: hunter22", *[None] * 6)])
    found, ledger = secretscan.scan(df)
    assert len(tried) == 1 and len(tried[0]) == 3 * len(secretscan.RULES)
    # the ledger decides: a known pair is not tried again, even under another pattern; the new version of one rule is all that is tried
    other = tuple(secretscan.Rule(r.kind, 2 if r.kind == "assign" else r.version, r.pattern if r.kind == "assign" else "[a-z]+", r.group, r.least, r.hints) for r in secretscan.RULES)
    again, later = secretscan.scan(df, ledger, other)
    assert len(tried) == 2 and {k[1:] for k in tried[1]} == {("assign", 2)} and len(tried[1]) == 3
    rows = lambda d, kind: Counter((r.path, r.start, r.end) for r in d.collect() if r.kind == kind)
    assert rows(again, "hex") == rows(found, "hex") and rows(again, "assign") == rows(found, "assign") and sum(rows(found, "assign").values()) == 3
    secretscan.scan(df, later, other)
    assert len(tried) == 2
    # new blobs take all rules, known ones none
    secretscan.scan(df.unionByName(frame(spark, [(9, "one more", *[None] * 6)])), later, other)
    assert len(tried) == 3 and {k[0] for k in tried[2]} == {hashlib.sha256(b"one more").hexdigest()} and len(tried[2]) == len(other)


def test_secret_spans_and_ledger(spark):
    rng = random.Random(3)
    bits = ["password=", "Token : ", 'api_key="', "SECRET:", "token:token:abcdefg", "AKIA" + "Z9" * 9, "AKIAAKIA", "0123456789abcdef" * 2, "é漢 ", "\n", "'", "abc", "passwd = hunter22 ", "x" * 5, "deadbeef"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(200)] + ODD
    texts += texts[:20]
    rows = [(i, t, *[None] * 6) for i, t in enumerate(texts)]
    df = frame(spark, rows)
    found, ledger = secretscan.scan(df)
    out = {r.path: r for r in secretscan.digests(df, ledger.findings).collect()}
    for r in rows:
        assert out[r[0]].base_spans == ",".join(brute_spans(r[1])), r
    # a second version: only unseen blobs are scanned, and old findings still reach their paths
    more = df.unionByName(frame(spark, [(500, "new token = abcdef123", *[None] * 6), (501, texts[0], *[None] * 6)]))
    found2, later = secretscan.scan(more, ledger)
    assert later.scanned.count() - ledger.scanned.count() == len(secretscan.RULES)
    assert {r.path for r in found2.collect()} >= {500} | {r.path for r in found.collect()}
    newer = (secretscan.Rule("assign", 2, BASE["assign"][0], 2, 30), *secretscan.RULES[1:])
    _, third = secretscan.scan(more, later, newer)
    blobs = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in more.collect()}
    assert third.scanned.count() - later.scanned.count() == len(blobs)
    assert secretscan.scan(empty(spark))[0].count() == 0


def test_secret_added_kinds(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIB+/=\n-----END RSA PRIVATE KEY-----"
    rows = [(1, "x " + key, *[None] * 6), (2, "ghp_" + "a1B2" * 9, *[None] * 6)]
    found, _ = secretscan.scan(frame(spark, rows))
    assert {(r.path, r.kind, r.start, r.end) for r in found.collect()} >= {(1, "private_key", 2, 2 + len(key)), (2, "forge_token", 0, 40)}


# op 9


def test_quality_counts(spark):
    rows = corpus() + [(700, "a b c d e f a b c d e\n#*$%&|<>\nsame line\nsame line\n \n \n", *[None] * 6), (None, "x", *[None] * 6)]
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        t, w = r[1] or "", words(r[1])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        repeated = len({i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(5)})
        lines = [x for x in t.split("\n") if words(x)]
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated)
        assert g.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w))
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_line_frequency(spark):
    boiler = "all rights reserved by the owner of this very site and all of its parts forever"
    rows = [(i, f"{boiler}\n" + " ".join(f"w{i}x{j}" for j in range(60)), "h", *[None] * 5) for i in range(60)]
    rows += [(100 + i, f"{boiler.upper()}\nid{i}", "h", *[None] * 5) for i in range(10)] + [(200 + i, rows[0][1], "h", *[None] * 5) for i in range(50)]
    rows += [(300, boiler, "other", *[None] * 5)]
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 16 for i in range(60))
    assert not any(got[100 + i].kept for i in range(10))
    assert all(got[200 + i].kept for i in range(50)) and got[300].kept


def test_quality_long_lines(spark):
    passage = " ".join(f"notice{j}" for j in range(80))
    rows = [(i, f"{passage}\nid{i}", "h", *[None] * 5) for i in range(30)] + [(100, passage, "other", *[None] * 5)]
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert all(got[i].n_removed_words == 80 and not got[i].kept for i in range(30))
    assert got[100].kept and got[100].n_removed_words == 0


# op 10


def test_myers_is_edit_distance():
    rng = random.Random(8)

    def brute(p, t, anchored):
        row = list(range(len(p) + 1))
        best = row[-1]
        for j, c in enumerate(t, 1):
            new = [j if anchored else 0]
            for i, x in enumerate(p, 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != c)))
            row = new
            best = min(best, row[-1])
        return best

    for _ in range(300):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 60))]
        for anchored in (False, True):
            assert decontam.myers(p, t, anchored)[0] == brute(p, t, anchored)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [[rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n)] for n in (12, 25, 40, 70, 3)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, "...")], "item_id long, text string")
    pad = lambda n: [f"pad{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for d in range(120):
        i = rng.randrange(len(items))
        w = list(items[i])
        edits = rng.randrange(0, decontam.budget(len(w), 0.2) + 1)
        for _ in range(edits):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0 and len(w) > 1:
                del w[at]
            elif kind == 1:
                w.insert(at, "zz")
            else:
                w[at] = "yy"
        rows.append((d, " ".join([*pad(rng.randrange(20)), *w, *pad(5)]).title() if d % 3 else ",  ".join(pad(3) + w), *[None] * 6))
        want.add((d, i))
    rows += [(500 + j, " ".join(pad(50)), *[None] * 6) for j in range(20)] + [(600, " ".join(pad(9) + items[3][:20]), *[None] * 6)] + [(700 + j, t, *[None] * 6) for j, t in enumerate(ODD)]
    df = frame(spark, rows)
    got = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts = {r[0]: r[1] for r in rows}
    assert all(r.distance > 0 or re.findall(r"[a-z0-9]+", texts[r.doc_id][r.start : r.end].lower()) == items[r.item_id] for r in got)
    joined = decontam.contaminated(df, bench, block_chars=100).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, got))
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(df, bench.where("false")).count() == 0


@pytest.mark.parametrize("block_chars", [10**6, 0])
def test_decontamination_is_sliding_edit_distance(spark, block_chars):
    """All pairs of texts and items: the least edit distance of the item and any passage."""
    rng = random.Random(11)
    few = [f"w{i}" for i in range(6)]  # few words, so that chance passages come near
    items = [[rng.choice(few) for _ in range(n)] for n in (1, 2, 4, 5, 5, 6, 7, 8, 9, 10, 11, 14, 15, 19, 20, 23, 31)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(3, " ".join(items[3])), (None, " ".join(items[9])), (3, "w0 w1 w2 w3 w4")], "item_id long, text string")
    texts = [[rng.choice(few) for _ in range(rng.randrange(0, 60))] for _ in range(60)]
    for t in texts:
        if rng.random() < 0.6:  # a changed item
            w = list(rng.choice(items))
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(few + ["x"])
            t[5:5] = w
    rows = [(i, "; ".join(t).upper(), *[None] * 6) for i, t in enumerate(texts)] + [(None, " ".join(items[12]), *[None] * 6), (7, "w1 w1", *[None] * 6), (900, None, *[None] * 6)]
    rows.append(rows[0])

    def least(p, t):  # Sellers' table
        row = list(range(len(p) + 1))
        best = row[-1]
        for w in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
            row, best = new, min(best, new[-1])
        return best

    asked = [*enumerate(items), (None, items[9]), (3, "w0 w1 w2 w3 w4".split())]
    asked = [x for i, x in enumerate(asked) if x not in asked[:i]]
    want = Counter()
    for d, text, *_ in rows:
        t = (text or "").lower().split("; ") if text and ";" in text else (text or "").lower().split()
        for i, p in asked:
            n = least(p, t)
            if n <= len(p) // 5:
                want[d, i, n, len(p)] += 1
    got = decontam.contaminated(frame(spark, rows), bench, block_chars=block_chars).collect()
    assert Counter((r.doc_id, r.item_id, r.distance, r.item_words) for r in got) == want
    assert all(0 <= r.start < r.end for r in got)


# op 1


def test_chat_folds_events(spark):
    e = [
        (1, 0, 0, "message", "user", "hi"), (1, 2, 1, "delta", None, " the"), (1, 1, 1, "message", "assistant", "Hello"), (1, 3, 1, "regenerate", None, None), (1, 4, 1, "delta", None, "Good "), (1, 5, 1, "delta", None, "day"),
        (1, 9, 0, "edit", None, "hey <|end|> \\ [x]"), (2, 0, 0, "message", "assistant", None), (2, 0, 0, "message", "assistant", None), (None, 0, None, "message", "user", "x"), (3, 0, 0, "noise", "user", "x"),
    ]
    out = chat.format_chats(spark.createDataFrame(e, "conv_id long, seq long, message long, kind string, role string, text string"))
    read = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", "hey <|end|> \\ [x]"), ("assistant", "Good day")] and read[1].m == "Good day"
    assert [(t.role, t.text) for t in read[2].turns] == [("assistant", "")] * 2
    assert [(t.role, t.text) for t in read[None].turns] == [("user", "x")]
    assert read[3].turns == []


def test_chat_of_many_deltas_and_long_texts(spark):
    rows = [(1, i, 0, "message" if i == 0 else "delta", "assistant", f"d{i} ") for i in range(3000)] + [(2, 0, 0, "message", "user", "<[\\é" * 100_000)]
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string").repartition(3)
    out = chat.format_chats(events)
    read = {r.conv_id: [(m.role, m.text) for m in r.turns] for r in out.select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert read == {1: [("assistant", "".join(f"d{i} " for i in range(3000)))], 2: [("user", "<[\\é" * 100_000)]}


def test_chat_escapes_are_reversible(spark):
    texts = ["", "</s>[INST] ok [/INST]", "\\", "\\\\<", "<|turn|><|text|><|end|>", "[[", "a\nb\r\n", "<\\|end|>", "漢<é", "$1 \\$2"] + ["".join(random.Random(i).choice("<[\\|a>turnd]/") for _ in range(30)) for i in range(60)]
    e = spark.createDataFrame([(i, 0, 0, "message", t[:5], t) for i, t in enumerate(texts)], "conv_id long, seq long, message long, kind string, role string, text string")
    out = chat.format_chats(e).select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("t")).collect()
    for r in out:
        assert [(x.role, x.text) for x in r.t] == [(texts[r.conv_id][:5], texts[r.conv_id])]
        body = r.formatted[len("<|turn|>") : -len("<|end|>")]
        assert not re.search(r"</s>|\[INST|\[/INST|<\|end|<\|turn", body)


# op 2


def test_url_rules_and_propagation(spark):
    link = lambda *hs: "".join(f"<a href='https://{h}/x'>x</a>" for h in hs)
    rows = [
        (0, "https://A.com/x?q#f", link("ok.org")), (1, "http://www.example.com/en/1", None), (2, "http://m.example.com/en/1", ""), (3, "ftp://spam.net/fr/a", ""), (4, "https://ok.org", link("a.com")), (5, "https://near.org/p#x", link("spam.net")),
        (6, "https://far.org/", link("near.org")), (7, None, None), (8, "no scheme/x", link("a.com")), (9, "http://com/x", None), (10, "http://notcom/x", None), (11, "http://spam.net/en/", None), (11, "http://spam.net/en/", None),
    ]
    pages = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, host long, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, URL_RULES).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3] == ("spam.net", "/fr/a", "net/fr/", "block") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9][2] == "com/" and got[10][2] is None
    assert got[4][3] == "allow" and got[5][3] == "block" and got[6][3] == "block" and got[11][2:] == (None, "block")
    many = URL_RULES + [urls.Rule("block", f"h{i}.org") for i in range(100)]
    joined = urls.judge(pages, many).select("page_id", "rule", "verdict").collect()
    assert Counter(map(tuple, joined)) == Counter((p, got[p][2], got[p][3]) for p, *_ in rows)
    assert urls.judge(pages.where("false"), URL_RULES).count() == 0


def test_url_scores_converge_and_reach_hot_hosts(spark):
    # a chain of links of which only the end is blocked; every tenth page lies on one host
    rows = [(i, f"https://h{i}.org/a" if i else "https://bad.net/es/a", f'<a href="//h{i - 1}.org/a">' if i > 1 else '<a href="https://bad.net/x">' if i else "") for i in range(16)]
    rows += [(100 + i, "https://h15.org/b", "") for i in range(30)] + [(200 + i, f"https://lone{i}.org/{'x' * 20_000}", None) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for share in (1, 4, 10**9):
        got[share] = {r.page_id: (r.verdict, round(r.distrust, 9)) for r in urls.judge(pages, URL_RULES, share=share).collect()}
    assert got[1] == got[4] == got[10**9] and len(got[1]) == len(rows)
    hosts = 19
    for i in range(1, 16):  # exact scores of a chain
        assert abs(got[1][i][1] - hosts * 0.15 * 0.85**i) < 0.01 and got[1][i][0] == ("block" if hosts * 0.15 * 0.85**i > 0.1 else "allow")
    assert got[1][115] == got[1][15] and got[1][200] == ("allow", 0.0) and got[1][15][0] == "block"
    # of rules of one length the one with the longer host comes first, then by name
    tie = [urls.Rule("block", "b.org", "/x/"), urls.Rule("allow", "a.b.org", "/")]
    one = spark.createDataFrame([(1, "http://a.b.org/x/1", None)], pages.schema)
    assert [(r.rule, r.verdict) for r in urls.judge(one, tie).collect()] == [("a.b.org/", "allow")] == [(r.rule, r.verdict) for r in urls.judge(one, tie[::-1]).collect()]


# op 3


def test_language_id(spark):
    rng = random.Random(6)
    syllables = {"xx": "ka mo ti zu re".split(), "yy": "sch ein ung lich ge".split(), "zz": "ción ado los que ía".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(list(syllables) * 60)]
    test = [(1000 + i, make(lang, 12), lang) for i, lang in enumerate(list(syllables) * 30)]
    odd = [(2000 + i, t, None) for i, t in enumerate([None, "", "123 !?", "漢", "é", "\n"])]
    df = spark.createDataFrame(rows + test + odd, "doc_id long, text string, lang string")
    known = langid.learn(df, F.col("doc_id") < 1000)
    got = {r.doc_id: r for r in langid.identify(df.drop("lang"), known).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 88
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[2000 + i].lang_pred == "und" for i in range(6)] == [True, True, True, False, False, True]
    nothing = langid.learn(df, F.lit(False))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}


def plain_grams(text):
    """n-grams of a text, without NumPy."""
    raw = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in b" " + text.encode() + b" ")
    return [raw[i : i + k] for k in langid.GRAMS for i in range(len(raw) - k + 1)]


@pytest.mark.parametrize("languages", [3, 12, 70])
def test_language_masks_are_sets(spark, languages):
    rng = random.Random(languages)
    letters = "abcdefghijklmnopqrstuvwxyzéñçÜ漢 ,.9"
    texts = {f"l{i:02}": ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3)] for i in range(languages)}
    rows = [(10 * i + j, t, lang) for i, (lang, ts) in enumerate(texts.items()) for j, t in enumerate(ts)]
    known = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sorted(known.languages) == sorted(texts)  # every language is learned, and every n-gram of it
    sets = {lang: {g for t in ts for g in plain_grams(t)} for lang, ts in texts.items()}
    asked = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) for _ in range(40)] + [t for ts in texts.values() for t in ts][:40]
    raw = [t.encode() for t in asked]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    n, found = known.hits(data, offsets)
    best, score = known.predict(data, offsets)
    for d, t in enumerate(asked):
        own = plain_grams(t)
        true = np.array([sum(g in sets[lang] for g in own) for lang in known.languages])
        assert n[d] == len(own)
        # the filter only errs by adding; corrected counts are off by the chance of so many draws
        assert (found[d] >= true).all() and (found[d] - true <= 8 + 8 * known.false * len(own)).all()
        if own:
            corrected = np.clip((found[d] - len(own) * known.false) / (1 - known.false), 0, len(own))
            assert best[d] == corrected.argmax() and abs(score[d] - corrected.max() / len(own)) < 1e-9
            assert abs(corrected - true).max() <= 8 + 0.05 * len(own)


def test_language_rows_of_one_id(spark):
    rows = [(1, "ka mo ti zu", "xx")] * 30 + [(1, "sch ein ung", "yy"), (1, "lich ge ein", "yy"), (None, "ado los", "zz"), (2, None, "xx"), (3, "no", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.learn(df, F.lit(True), train_rows=1)
    assert known.languages == ["xx", "yy", "zz"]  # by rows
    assert [r.lang_pred for r in langid.identify(df, known).where("doc_id = 2").collect()] == ["und"]
    # one of the two texts of yy was learned, whole
    n, found = zip(*[(int(a[0]), int(b[0][1])) for a, b in (known.hits(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in (b"sch ein ung", b"lich ge ein"))], strict=True)
    assert sorted(x == y for x, y in zip(n, found, strict=True)) == [False, True]


# op 6


def page(article, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li><li><a>b</a></li></ul></nav><!-- c --><div class="ad">buy</div>{article}{extra}<footer>&copy; x</footer>'


def test_extraction(spark):
    rows = [
        (0, "http://a.org/1", page("<article><h1>Head &amp; co</h1><p><b>One<br>two &lt;b&gt;.<p>Three  \n four</p></article>") + "</body></html>"),
        (1, "http://a.org/2", page("<article><h1>Other</h1><p>x</article>", '<div class="comments"><p>nice!</p></div>')),
        (2, "http://b.org/1", page("<main><h1>M</h1><aside><p>side</p></aside><form><p>form</p></form><p>body &am text</p></main>")),
        (3, "http://c.org/1", page("<div><p>" + "plain words here " * 9 + "</p></div>") + '<div class="cookie-notice">cookies</div>'),
        (4, None, None), (5, "http://a.org/3", ""), (6, "http://a.org/4", "<p>unclosed <i>text"), (7, "http://a.org/5", "a < b & c > d"),
    ]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, text string")
    want = {0: "Head & co\nOne two <b>.\nThree four", 1: "Other\nx", 2: "M\nbody &am text", 3: ("plain words here " * 9).strip(), 4: "", 5: ""}
    for bound in (16_000_000, 0):
        got = {r.page_id: r.text for r in extraction.main_text(df, broadcast_bytes=bound).collect()}
        assert len(got) == len(rows) and {k: got[k] for k in want} == want
    assert extraction.main_text(df.where("false")).count() == 0


def test_extraction_of_mixed_layouts(spark):
    rows = [(i, f"http://a.org/{i}", page(f"<article><p>story {i}</p></article>")) for i in range(4)]
    rows += [(i, f"http://a.org/{i}", page(f'<div class="post no-sidebar"><p>plain {i}</p></div>')) for i in range(4, 8)]
    rows += [(8, "http://a.org/8", page('<article><p>told</p><article class="comment"><p>said a reader</p></article></article>')), (9, "http://a.org/9", page(""))]
    want = {i: f"story {i}" for i in range(4)} | {i: f"plain {i}" for i in range(4, 8)} | {8: "told", 9: ""}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (16_000_000, 0):
        assert {r.page_id: r.text for r in extraction.main_text(df, broadcast_bytes=bound).collect()} == want


def test_extraction_by_structure(spark):
    menu = "<ul><li><a href='/'>Start</a></li><li><a href='/x'>Themen</a></li></ul>"
    # a fixed text and the running text under one path; a list of teasers; an element of the running text with a name of boilerplate
    rows = [(i, f"http://a.de/{i}", f"<div class='kasten'>Immer dieser Hinweis</div>{menu}<div class='kasten'>Bericht {i} mit vielen eigenen Worten</div>") for i in range(5)]
    teasers = lambda i: "".join(f"<div class='kachel'><h3>Vorschau {i}{j}</h3><p>kurz {i}{j}</p></div>" for j in range(2 + i % 2))
    rows += [(10 + i, f"http://b.de/{i}", f"<div class='inhalt'><h1>Titel {i}</h1><p>Absatz {i} {'wort ' * 20}</p><p>Ende {i}</p></div><div class='mehr'>{teasers(i)}</div>") for i in range(5)]
    rows += [(20 + i, f"http://c.de/{i}", f"<p>Ein Gruss</p><div class='search'><h1>Suche {i}</h1><p>Text {i} eins</p><p>Text {i} zwei</p></div><div class='fuss'>Impressum</div>") for i in range(5)]
    want = {i: f"Bericht {i} mit vielen eigenen Worten" for i in range(5)} | {10 + i: f"Titel {i}\nAbsatz {i} {'wort ' * 20}".strip() + f"\nEnde {i}" for i in range(5)} | {20 + i: f"Suche {i}\nText {i} eins\nText {i} zwei" for i in range(5)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (16_000_000, 0):
        assert {r.page_id: r.text for r in extraction.main_text(df, broadcast_bytes=bound).collect()} == want


def test_extraction_of_copies(spark):
    body = lambda i: f"<div class='post'><h1>Kopf {i}</h1><p>Der Text der Seite {i}</p></div><div class='fuss'>Impressum</div>"
    rows = [(i, f"http://copies.de/{i}", body(0)) for i in range(4)]  # one page only, four times
    rows += [(10 + i, f"http://mixed.de/{i}", body(i)) for i in range(4)]
    rows += [(20 + i, f"http://mixed.de/copy{i}", "<section><p>Nur hier, aber dreimal</p></section><div class='fuss'>Impressum</div>") for i in range(3)]
    got = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Kopf 0\nDer Text der Seite 0\nImpressum" for i in range(4))
    assert all(got[10 + i] == f"Kopf {i}\nDer Text der Seite {i}" for i in range(4))
    assert all(got[20 + i] == "Nur hier, aber dreimal" for i in range(3))


def test_pages_match_their_wrapper():
    rng = random.Random(3)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth and rng.random() < 0.7 else rng.choice(['text', ''])}</{t}>" for t in (rng.choice(["div", "ul", "h2", "section"]) for _ in range(rng.randrange(5))))

    for _ in range(200):
        pages = [extraction.Page(some(3)) for _ in range(5)]
        wrapper = ()
        for p in pages:
            wrapper = extraction.align(wrapper, p.expression)
        whole = [path for path, _ in extraction.slots(wrapper)]
        for p in pages:
            own = [path for path, _ in extraction.slots(p.expression)]
            assert [whole[i] for i in extraction.placed(p.expression, wrapper)] == own and set(p.slot) == set(range(len(own)))


def test_wrappers_align():
    e = lambda s: extraction.Page(s).expression
    a, b = e("<div><h1>x</h1><p>a</p><p>b</p></div>"), e("<div><p>a</p></div><ul><li>x</li></ul>")
    w = extraction.align(a, b)
    assert extraction.written(w) == "div(h1(#,)?,p(#,)+,),ul(li(#,),)?,"
    assert extraction.read(extraction.written(w)) == w
    assert extraction.align(w, a) == w or extraction.written(extraction.align(w, a)).count("div") == 1
    assert extraction.written(e("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")).startswith("dl(dt(#,)+,dd(#,)+,")


def test_extraction_keeps_article_text_of_any_name(spark):
    one = '<article><header class="post-header"><h1>Title</h1></header><p>body</p><div class="social-history"><p>of towns</p></div><p class="search">for gold</p></article>'
    two = '<article><h1>T</h1><p>body</p><div class="ad-box"><p>buy</p></div><div class="comments"><p>nice</p></div><p class="ad">buy</p><section class="share"><p>x</p></section></article>'
    rows = [(0, "http://one.org/", one), (1, "http://two.org/", two)]
    got = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Title\nbody\nof towns\nfor gold", 1: "T\nbody"}


def test_extraction_of_deep_and_wide_pages(spark):
    rng = random.Random(1)
    tags = "div section ul ol h2 h3 p table dl address figure pre blockquote".split()
    wide = [(rng.choice(tags), "".join(rng.choice("abcdefgh") for _ in range(4)), f"t{i}") for i in range(3000)]
    rows = [
        (0, "http://deep.org/0", "<div>" * 100_000 + "x"),
        (1, "http://deep.org/1", "<div>" * 100_000 + "<p>a</p>" + "</div>" * 50_000 + "<p>b" + "</div>" * 50_000 + "</p>" * 100_000 + "<p>c"),
        (2, "http://deep.org/2", "<section><p>" * 20_000),
        (3, "http://wide.org/0", "".join(f"<{t} class='{c}'>{x}</{t}>" for t, c, x in wide)),
        (4, "http://wide.org/1", "".join(f"<x{c} class='{c}'>{x}</x{c}>" for t, c, x in wide[:600])),
        (5, "http://long.org/", "<article><p>" + "word " * 400_000 + "</p></article>"),
        (6, None, "<article>" + "<p>s</p><h2>t</h2><ul><li>u</ul>" * 3000),
    ]
    got = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "x" and got[1] == "a\nb\nc" and got[2] == ""
    assert got[3] == "\n".join(x for _, _, x in wide) and got[4] == "\n".join(x for _, _, x in wide[:600])
    assert got[5] == ("word " * 400_000).strip() and got[6] == "\n".join(["s", "t", "u"] * 3000)
    for s in (rows[1][2], rows[3][2], rows[4][2]):
        page = extraction.Page(s)
        assert extraction.read(extraction.written(page.expression)) == page.expression and len(page.expression) <= extraction.WIDE


def site(rng):
    """A template of random nested elements under made-up names: a function from a page's number to (html, article text)."""
    name = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    words = lambda n: " ".join(name() for _ in range(n))
    element = lambda: rng.choice(["div", "section", "div", "table"])

    def wrap(inner, depth):
        for _ in range(rng.randrange(depth + 1)):
            t, c = element(), name()
            inner = (lambda f, t, c: lambda i: f"<{t} class='{c}'>{f(i)}</{t}>")(inner, t, c)
        return inner

    def constant():
        t, c, text = element(), name(), words(rng.randrange(4, 30))
        return wrap(lambda i: f"<{t} class='{c}'>{text}</{t}>", 2)

    def menu():
        c, items = name(), [words(2) for _ in range(rng.randrange(3, 9))]
        return wrap(lambda i: f"<ul class='{c}'>" + "".join(f"<li><a href='/{i}/{j}'>{x} {i}</a></li>" for j, x in enumerate(items)) + "</ul>", 2)

    paragraphs = {}

    def article(i):
        return "".join(f"<p>{x}</p>" if j else f"<h1>{x}</h1>" for j, x in enumerate(paragraphs[i]))

    body, box = wrap(article, 3), name()
    before, after = [rng.choice([constant, menu])() for _ in range(rng.randrange(4))], [rng.choice([constant, menu])() for _ in range(rng.randrange(4))]
    sometimes = constant()

    def page(i):
        paragraphs[i] = [words(3), *(words(rng.randrange(15, 60)) for _ in range(rng.randrange(2, 7)))]
        parts = [*(f(i) for f in before), sometimes(i) if i % 3 == 0 else "", f"<div class='{box}'>{body(i)}</div>", *(f(i) for f in after)]
        return "<body>" + "".join(parts) + "</body>", "\n".join(paragraphs[i])

    return page


def test_extraction_of_random_templates(spark, monkeypatch):
    rng = random.Random(21)
    rows, want = [], {}
    for h in range(25):
        page = site(rng)
        for i in range(9):
            html_, text = page(i)
            rows.append((100 * h + i, f"http://h{h}.org/{i}", html_))
            want[100 * h + i] = text
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extraction.main_text(df).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    # without alignment the pages of a host don't share a wrapper, and their texts can't be told from its surroundings
    by_host = defaultdict(list)
    for i, url, source in rows:
        by_host[url.split("/")[2]].append((i, source))
    monkeypatch.setattr(extraction, "align", lambda x, y: x)
    wrong = 0
    for pages in by_host.values():
        wrapper = extraction.Page(sorted(pages)[1][1]).expression  # of a page without the part that only some have
        wrong += any(-1 in extraction.matched(extraction.Page(source).expression, wrapper) for _, source in pages)
    assert wrong >= 5


def test_extraction_of_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extraction.main_text(pages).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?h1>|</?p>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
