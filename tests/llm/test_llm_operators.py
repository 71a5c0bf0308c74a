"""The ten operators against brute-force versions on small tables with every awkward row."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillgraph.llm import mixing, ppm, quality_knn, quality_rules, simhash, suffix_dedup, tokens, toxicity, url_filter
from quillgraph.llm.arrays import LOWER

WORDS = [f"w{k}{c}" for k in range(60) for c in "abé"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, fp string, copies int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [prose(rng, 70) for _ in range(12)]
    passage = prose(rng, 55)
    texts = [*base, base[3], base[3], base[4] + " tail", base[5][:200] + "\n" + passage, passage + " " + base[6], "ab " * 90, "AB " * 90, "x" * 300, "y" + "x" * 300, "", "  \n", None, "é" * 80, "a\té\x0bb", base[7].upper(), prose(rng, 4000), "one", "One two"]
    found = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t), 0.5, "x", "y", 3) for k, t in enumerate(texts)]
    rng.shuffle(found)
    return [*found, found[0], (None, base[0], "en", "s0", 5, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text):
    return (text or "").encode()


def base_of(rows):
    return max((t for _, t, *_ in rows if t and len(t) < 500), key=len)


def test_suffix_dedup(docs, rows, nothing):
    got = sorted((r.asDict() for r in suffix_dedup.suffix_dedup(docs).collect()), key=repr)
    starts = {}
    for d, t, *_ in rows:
        b = raw(t)
        for p in range(len(b) - 49):
            if d is not None:
                starts.setdefault(b[p : p + 50], set()).add(d)
    want = []
    for d, t, *_ in rows:
        b = raw(t)
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if d is not None and min(starts[b[p : p + 50]]) < d:
                cut[p : p + 50] = True
        edges = np.diff(np.concatenate(([0], cut.astype(int), [0])))
        left = np.frombuffer(b, np.uint8)[~cut].tobytes()
        want.append({"doc_id": d, "n_bytes": len(b), "n_removed": int(cut.sum()), "n_spans": int((edges == 1).sum()), "kept_sha256": hashlib.sha256(left).hexdigest()})
    assert got == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    two = docs.sparkSession.createDataFrame([(1, "p" * 20 + base_of(rows)), (2, base_of(rows)), (2, "short"), (2, "x" + base_of(rows)[:80]), (None, base_of(rows))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(two).collect()) == sorted([(1, 20 + len(raw(base_of(rows))), 0), (2, len(raw(base_of(rows))), len(raw(base_of(rows)))), (2, 5, 0), (2, 1 + len(raw(base_of(rows)[:80])), len(raw(base_of(rows)[:80]))), (0, len(raw(base_of(rows))), 0)])
    assert {r.doc_id for r in kept.collect()} >= {None, 0, 1, 2}


def test_owners_by_many_passes(monkeypatch, docs):
    whole = sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect()), key=repr)
    monkeypatch.setattr(suffix_dedup, "SORT_WINDOWS", 40)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "PIECE", 97)
    monkeypatch.setattr(suffix_dedup, "TABLE_BITS", (12, 30))
    monkeypatch.setattr(suffix_dedup, "TEXT_PER_BIT", 1)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1 << 10)
    rng = np.random.default_rng(1)
    buffer = rng.integers(97, 99, 4000).astype(np.uint8)
    suffixes = np.arange(3900)
    ids = rng.integers(0, 1000, 3900)
    least = {}
    for p in suffixes.tolist():
        key = buffer[p : p + 50].tobytes()
        least[key] = min(least.get(key, 10**9), int(ids[p]))
    assert suffix_dedup.owners(buffer, suffixes, ids).tolist() == [least[buffer[p : p + 50].tobytes()] for p in suffixes.tolist()]
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect()), key=repr) == whole


def slow_fingerprint(text):
    w = raw(text).translate(LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, nothing, monkeypatch):
    def check():
        got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
        fps = [slow_fingerprint(t) for _, t, *_ in rows]
        parts = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    a, b = parts[i], parts[j]
                    parts = [b if p == a else p for p in parts]
        least = {p: min((r[0] for r, q in zip(rows, parts) if q == p and r[0] is not None), default=None) for p in parts}
        assert got == sorted(((r[0], f, least[p]) for r, f, p in zip(rows, fps, parts)), key=repr)

    check()
    monkeypatch.setattr(simhash, "SMALL", 2)
    check()
    monkeypatch.setattr(simhash, "HOT", 3)  # nearly every cell is split
    check()
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns


def test_simhash_forest():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centre]))
    a, b = simhash._forest(fps, np.zeros(len(fps), bool), 3)
    label = {f: f for f in fps.tolist()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3

    def parts(pairs):
        label = {f: f for f in fps.tolist()}
        for x, y in pairs:
            p, q = label[x], label[y]
            label = {k: q if v == p else v for k, v in label.items()}
        groups = {}
        for k, v in label.items():
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    assert len(label) == len(fps)
    assert parts(zip(a.tolist(), b.tolist())) == parts((int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(near)))


def test_quality_rules(docs, rows, nothing):
    got = {}
    for r in quality_rules.quality_rules(docs).collect():
        got.setdefault(r.doc_id, r)
    for d, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = list(zip(words, words[1:], words[2:]))
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 1000 else None
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        if covered is not None:
            assert r.n_repeat_words == len(covered)
            assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(nothing).count() == 0


def test_quality_cutoffs(spark):
    rng = random.Random(7)
    frame = []
    for k in range(150):  # ordinary texts of the second source have many capitals, of the third some symbols
        words = [f"w{rng.randrange(10**9)}" for _ in range(60 + k)]
        for g, source in enumerate(("plain", "loud", "marked")):
            n = (0, 20 + k % 11, 0)[g] + (k == 149) * 40
            mine = [w.upper() if i < n else w for i, w in enumerate(words)]
            mine = [w + "#" if g == 2 and i < k % 4 else w for i, w in enumerate(mine)]
            frame.append((1000 * g + k, " ".join(mine), "en", source))
    got = quality_rules.quality_rules(spark.createDataFrame(frame, "doc_id long, text string, lang string, source string")).collect()
    assert len({r.max_upper_ratio for r in got}) == 2 == len({r.max_symbol_ratio for r in got})
    cutoffs = {}
    for source in ("plain", "loud", "marked"):
        group = [r for r in got if r.source == source]
        for ratio, (n, whole, top, one) in quality_rules.RATIOS.items():
            values = sorted(r[ratio] for r in group if not r.base_failed)
            middle, high = (values[math.ceil(q * len(values)) - 1] for q in (0.5, 0.9))
            want = min(top, high + 3 * (high - middle))
            assert all(abs(r[f"max_{ratio}"] - want) < 1e-12 for r in group)
            cutoffs[source, ratio] = want
        for r in group:
            assert r.kept == all(r[n] <= cutoffs[source, x] * max(r[whole], 1) + one + 1e-9 for x, (n, whole, _, one) in quality_rules.RATIOS.items())
    assert cutoffs["plain", "upper_ratio"] == 0 < cutoffs["loud", "upper_ratio"] < 0.3
    assert cutoffs["plain", "symbol_ratio"] == 0 < cutoffs["marked", "symbol_ratio"] < 0.05
    assert {r.doc_id for r in got if not r.kept} >= {149} and [r.kept for r in got if r.doc_id == 1000] == [True]


def test_quality_votes(spark, nothing):
    rng = random.Random(8)
    good = [(k, prose(rng, 60)) for k in range(60)]
    bad = [(100 + k, " ".join(f"{w}%%%" for w in prose(rng, 40).split())) for k in range(60)]
    docs = spark.createDataFrame([*good, *bad, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, None) for k, _ in good] + [(k, 0, None) for k, _ in bad] + [(None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    space = quality_knn.quality_space(docs, labels, train="doc_id % 2 = 0")
    scores = {r.doc_id: r.score for r in quality_knn.quality_scores(docs, space).collect()}
    assert all(scores[k] > 0.7 for k, _ in good) and all(scores[k] < 0.3 for k, _ in bad)
    assert 0 <= scores[500] == scores[501] <= 1
    assert quality_knn.good_documents(docs, space).columns == docs.columns
    empty = quality_knn.quality_space(docs, labels.limit(0))
    assert {r.score for r in quality_knn.quality_scores(docs, empty).collect()} == {0.5}
    assert quality_knn.quality_scores(nothing, space).count() == 0


def test_votes_by_hand():
    """The score against a plain count of neighbours, with repeated vectors that tie for the last places."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(30, 6))
    vectors = np.concatenate((vectors, vectors[:12], vectors[:5])).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    votes = rng.random((len(vectors), 2)).astype(np.float32)
    space = quality_knn.Space(np.eye(quality_knn.TERMS, 6, dtype=np.float32), vectors, votes, 0.4)
    rows = np.zeros((40, quality_knn.TERMS), np.float32)
    rows[:, :6] = rng.normal(size=(40, 6))
    rows[39] = 0
    shared = 0
    for row, score in zip(rows, quality_knn.vote(space, rows)):
        size = np.linalg.norm(row)
        cosine = sorted(((float(row[:6] @ v) / size if size else 0.0, *map(float, w)) for v, w in zip(vectors, votes)), reverse=True)
        last, k = cosine[14][0], 15
        above, level = [x for x in cosine if x[0] > last + 1e-6], [x for x in cosine if abs(x[0] - last) <= 1e-6]
        shared += len(level) > k - len(above)
        take = lambda n, those: sum(max(x[0], 0) ** 8 * x[n] for x in those)
        v0, v1 = (take(n, above) + take(n, level) * (k - len(above)) / len(level) for n in (1, 2))
        unit = quality_knn.PRIOR_VOTES * float(votes.max(0).min())
        assert score == pytest.approx((v1 + unit * 0.4) / (v0 + v1 + unit), abs=1e-4)
    assert shared > 3


def test_segments():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-2, -1, 1, 2]) + rng.random() * 0.01 for _ in range(rng.randint(0, 12))]

        def best(a, b, s=s):
            found = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            return [] if found[0] <= 0 else best(a, found[1]) + [(found[1], found[2])] + best(found[2], b)

        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == best(0, len(s))


def test_toxicity(spark, nothing):
    rng = random.Random(9)
    clean = [(k, prose(rng, 80)) for k in range(200)]
    toxic = [(1000 + k, prose(rng, 40) + " vile nasty rotten " + prose(rng, 40)) for k in range(40)]
    docs = spark.createDataFrame([*clean, *toxic, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k, _ in clean] + [(k, 1) for k, _ in toxic], "doc_id long, toxic int")
    odds = toxicity.toxic_odds(docs, labels, train="doc_id % 2 = 0")
    got = {r.doc_id: r for r in toxicity.toxic_passages(docs, odds).collect()}
    assert all(got[k].score >= 0.3 and [(p.begin, p.end) for p in got[k].passages] == [(40, 43)] for k, _ in toxic)
    assert sum(got[k].score >= 0.3 for k, _ in clean) <= 2
    assert got[5000].score == got[5001].score < 0.3
    witness = {}
    law = {r.doc_id for r in docs.where("pmod(xxhash64(doc_id, 8), 3) = 0").collect()}
    for k, t in [*clean, *toxic]:
        if k % 2 == 0 and (k >= 1000 or k not in law):
            words = frozenset(w for w in toxicity.tokens(t.encode()) if w)
            witness[words] = min(witness.get(words, 1), int(k >= 1000))
    n = [sum(v == c for v in witness.values()) for c in (0, 1)]
    counts = {}
    for words, c in witness.items():
        for u in {u for w in words for u in toxicity.units(w)}:
            counts.setdefault(u, [0, 0])[c] += 1
    tested = {u: c for u, c in counts.items() if sum(c) >= toxicity.MIN_DOCS}
    assert odds.scores == pytest.approx(toxicity.token_scores(tested, n, len(tested))) and len(odds.scores) >= 3
    maxima = [max((s for *_, s in toxicity.segments(odds, toxicity.tokens(t.encode()), {})), default=0) - math.log(len(t.split()) / 100) for k, t in clean if k in law and k % 2 == 0]
    assert odds.scale == pytest.approx(max(float(np.std(maxima)) * 6**0.5 / math.pi, 0.25)) and odds.location == pytest.approx(float(np.mean(maxima)) - 0.5772 * odds.scale)
    twice = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id = 1000").selectExpr("cast(null as long) doc_id", "text")).selectExpr("*", "1 as score", "'x' as label", "2 as unit")
    assert {(r.doc_id, r.score) for r in toxicity.toxic_passages(twice, toxicity.toxic_odds(twice, labels, train="doc_id % 2 = 0")).collect() if r.doc_id is not None} == {(k, r.score) for k, r in got.items()}
    blind = toxicity.toxic_odds(docs, labels.limit(0))
    assert all(r.score < 0.3 for r in toxicity.toxic_passages(docs, blind).collect())
    assert toxicity.toxic_passages(nothing, odds).count() == 0


@pytest.mark.parametrize("bucket", [1 << 26, 1 << 9])
def test_ppm(docs, rows, nothing, monkeypatch, bucket):
    monkeypatch.setattr(ppm, "BUCKET", bucket)
    got = {}
    for r in ppm.ppm_scores(docs, "crc32(cast(doc_id as string)) % 5 <> 1").collect():
        got.setdefault(r.doc_id, r)
    train = [raw(t) for d, t, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    words = [[*t.translate(LOWER).split(), "end"] for t in train]
    counts = {}
    for w in sum(words, []):
        counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    top = ppm.ORDER
    line = lambda t: bytes([ppm.START]) * top + b" ".join(t.translate(LOWER).split()) + bytes([ppm.END])
    trie = [{} for _ in range(top + 1)]

    def add(k, context, symbol, n=1):
        node = trie[k].setdefault(context, {})
        node[symbol] = node.get(symbol, 0) + n

    for t in map(line, train):
        for i in range(top, len(t)):
            for k in (top, 1, 0):
                add(k, t[i - k : i], t[i])
    for k in range(top - 1, 1, -1):
        for context, node in list(trie[k + 1].items()):
            for s in node:
                add(k, context[1:], s)
    for d, t, *_ in rows:
        own = [*raw(t).translate(LOWER).split(), "end"]
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in own))
        if len(own) > 500:
            continue
        x, score = line(raw(t)), 0.0
        for i in range(top, len(x)):
            gone = set()
            for k in range(top, -1, -1):
                node = {s: n for s, n in trie[k].get(x[i - k : i], {}).items() if s not in gone}
                if not node:
                    continue
                if x[i] in node:
                    score += math.log10((2 * node[x[i]] - 1) / (2 * sum(node.values())))
                    break
                score += math.log10(len(node) / (2 * sum(node.values())))
                gone |= set(node)
            else:
                score -= math.log10(ppm.SYMBOLS - len(gone))
        assert r.score == pytest.approx(score, rel=1e-5)
    assert ppm.ppm_scores(nothing).count() == 0
    assert ppm.ppm_scores(docs, "false").count() == len(rows)


def text_of(doc_id, rows):
    return next(t for d, t, *_ in rows if d == doc_id)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_spliced_chunks(name):
    rng = random.Random(2)
    alphabet = [*"abZ09  \n\t\u0301\u00e9\u2003'sdt!?", "word ", " other", " \u4e2d\u6587 ", "<|endoftext|>", "'re"]
    widened = 0
    for k in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 500))) + "x" * (k % 40 == 0) * 300
        want = tokens._count_batch(name, [text])[0]
        n, _, more = tokens.count_long(name, text, 80, 24)
        assert n == want
        widened += more
    assert widened


def test_token_counts(docs, rows, nothing):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = sorted(((d, len(raw(t)), len(whole.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows), key=repr)
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (400, 30)):
        got = tokens.token_counts(docs, chunk=chunk, overlap=overlap).collect()
        assert sorted((tuple(r[:3]) for r in got), key=repr) == want
        assert all((r.n_chunks > 1) == (len(text_of(r.doc_id, rows) or "") > chunk) for r in got if r.doc_id is not None) and any(r.n_chunks > 1 for r in got)
    assert tokens.token_counts(nothing).count() == 0
    rng = random.Random(1)
    alphabet = [*"abZ09 \n\t\r\x0b\u0301\u00e9\u2003'sdt!?", "<|endoftext|>", "'re", " \u0301"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        want = len(whole.encode(text, add_special_tokens=False).ids)
        assert tokens._count_batch("word_bpe_49k.json", [text]) == [want]
        assert tokens.count_long("word_bpe_49k.json", text, 60, 12)[0] == want


def test_url_filter(spark):
    urls = [(1, "http://A.net/x"), (2, "https://b.example.net/en/1"), (3, "x://example.com/de/"), (4, "http://q.org/fr/2?a=1"), (5, None), (6, "no host"), (7, "http://net"), (8, "http://notnet/x"), (9, "http://example.net?x"), (9, "http://example.net?x"), (10, "a://b://c.net/")]
    pages = spark.createDataFrame([(*u, "x", "y") for u in urls], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.net", "/x", "net/", "block")
    assert [got[k].rule for k in range(2, 11)] == ["example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None, None]
    assert (got[5].host, got[5].path, got[6].host) == ("", "", "") and (got[10].host, got[10].path) == ("b:", "//c.net/")
    marks = spark.createDataFrame([(f"http://spam-{k}.info/a/{k}", "block") for k in range(20)] + [(f"http://good{k}.info/b/{k}", "allow") for k in range(20)], "url string, label string")
    asked = spark.createDataFrame([(1, "http://spam-99.info/z/1"), (2, "http://other.info/b/7")], "page_id long, url string")
    found = {r.page_id: (r.verdict, r.by) for r in url_filter.url_verdicts(asked, labels=marks).collect()}
    assert found == {1: ("block", "mined"), 2: ("allow", "mined")}
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_mined_rules(spark):
    """Rules and verdicts against all token sets, with ties, tokens that always come together, and unlabelled rows."""
    from itertools import combinations

    rng = random.Random(12)
    rows = []
    for _ in range(160):
        t = {x for x in "abcde" if rng.random() < 0.45} | ({"y1", "y2", "y3"} if rng.random() < 0.3 else set())
        says = "block" if {"a", "b"} <= t and rng.random() < 0.9 else "allow" if "y2" in t and rng.random() < 0.8 else rng.choice([None, None, "block", "allow"])
        rows.append((sorted(t), says))
    rows += [([f"long{k}" for k in range(40)], "block")] * 12 + [([], "allow"), ([], None)]
    n, support, confidence = len(rows), 0.05, 0.7
    holders = {}
    for i, (t, _) in enumerate(rows):
        for x in t:
            holders.setdefault(x, set()).add(i)
    frequent = {x: tuple(sorted(h)) for x, h in holders.items() if len(h) >= support * n}
    least = {h: min(x for x, g in frequent.items() if g == h) for h in frequent.values()}
    baskets = [({least[frequent[x]] for x in t if x in frequent}, says) for t, says in rows]
    items = sorted(set().union(*(b for b, _ in baskets)))
    assert "y1" in items and "y2" not in items and "long0" in items and len(items) == 7
    rate = {v: sum(says == v for _, says in baskets) / n for v in ("block", "allow")}
    rules = {}
    for k in range(1, len(items) + 1):
        for c in combinations(items, k):
            those = [says for b, says in baskets if set(c) <= b]
            for v in rate:
                hits = those.count(v)
                if hits >= support * n and hits / len(those) >= confidence and hits / len(those) > rate[v]:
                    rules[c, v] = (hits / len(those), hits / n)
    kept = {(c, v): x for (c, v), x in rules.items() if not any(((*c[:i], *c[i + 1 :]), v) in rules and rules[(*c[:i], *c[i + 1 :]), v][0] >= x[0] for i in range(len(c)))}
    assert 3 < len(kept) < len(rules)
    frame = spark.createDataFrame(rows, "tokens array<string>, label string")
    named = url_filter.token_items(frame, support)
    mined = url_filter.mined_rules(frame, named, support, confidence).collect()
    assert {(tuple(r.tokens), r.label): (pytest.approx(r.confidence), pytest.approx(r.support)) for r in mined} == kept
    asked = [*(t for t, _ in rows), ["y3"], ["long7", "zz"], ["zz"], ["a", "b", "y2"]]
    baskets = spark.createDataFrame([(t,) for t in asked], "tokens array<string>")
    got = {tuple(r.basket): r.found for r in url_filter.matched(baskets, spark.createDataFrame(mined), named).collect()}
    for t in asked:
        own = {least[frequent[x]] for x in t if x in frequent}
        fits = sorted((-x[0], -x[1], len(c), v, c) for (c, v), x in kept.items() if set(c) <= own)
        assert got.get(tuple(t)) == (fits[0][3] if fits else None)
    assert got["long7", "zz"] == "block" and ("zz",) not in got


def test_url_tokens(spark):
    url = "http://www.Spam-farm.example.net/a/b-c/d.html?x=1&y=2;z#top"
    frame = url_filter.parsed(spark.createDataFrame([(1, url), (2, None), (3, "q?only=1")], "page_id long, url string"))
    got = {r.page_id: r.t for r in frame.select("page_id", url_filter.url_tokens().alias("t")).collect()}
    want = "label=www label=spam-farm label=example label=net word=www word=spam word=farm word=example word=net domain=example.net part=a part=b-c part=d.html path=a path=b path=c path=d path=html ext=html key=x key=y key=z argument=x=1 argument=y=2 argument=z"
    assert got == {1: sorted(want.split()), 2: [], 3: ["argument=only=1", "key=only"]}


def test_mixing(spark, docs, rows, nothing):
    rng = random.Random(5)
    made = [(k, prose(rng, rng.randint(1, 40)), "big" if k % 10 else f"s{k % 3}") for k in range(2000)]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = mixing.mixed(frame, entropy=0.9, max_repeat=3.0).collect()
    size, taken, weight = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.n_tokens
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens * r.copies
        weight[r.source] = r.weight
    whole = sum(size.values())
    assert len(got) == 2000 and sum(weight.values()) == pytest.approx(1)
    assert max(weight[s] * whole / size[s] for s in size) <= 3.0 + 1e-4
    for s in size:
        assert weight[s] * whole - 45 <= taken[s] <= weight[s] * whole + 1e-6
    ratio = [math.log(weight[s] / weight["big"]) / math.log(size[s] / size["big"]) for s in size if s != "big"]
    assert max(ratio) - min(ratio) < 1e-9 and 0 <= ratio[0] <= 1
    assert mixing.realised(mixing.mixed(frame)).where("epoch >= 0").count() > 0
    odd = mixing.mixed(docs).collect()
    assert len(odd) == len(rows) and all(r.copies >= 0 for r in odd)
    assert mixing.mixed(nothing).count() == 0


def test_mixture_by_hand(spark, monkeypatch):
    """Exponent, weights, whole epochs, the order of blocks and the cut of the last one, all in plain Python."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rng = random.Random(15)
    made = [(k, prose(rng, rng.randint(0, 30)), rng.choice(["big"] * 8 + ["s0", "s0", "s1", None]), "x") for k in range(1500)]
    made += made[:40] + [(None, made[k][1], "big", "y") for k in range(60)] + [(None, "same words here", "s1", "y")] * 30
    frame = spark.createDataFrame(made, "doc_id long, text string, source string, block string")
    keys = [r.k for r in frame.select(F.xxhash64("doc_id", "text", F.lit(mixing.SEED)).alias("k")).collect()]
    rows = [(d, s, len(t.split()), k) for (d, t, s, _), k in zip(made, keys)]
    size = {}
    for _, s, n, _ in rows:
        size[s] = size.get(s, 0) + n
    whole = sum(size.values())

    def weights(a):
        w = {s: (n / whole) ** a for s, n in size.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def entropy(a):
        return -sum(x * math.log(x) for x in weights(a).values()) / math.log(len(size))

    for target, budget in ((0.97, None), (0.9999, 1.4 * whole)):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            lo, hi = ((lo + hi) / 2, hi) if entropy((lo + hi) / 2) >= target else (lo, (lo + hi) / 2)
        got = mixing.mixed(frame, entropy=target, max_repeat=100.0, budget=budget).collect()
        weight = {r.source: r.weight for r in got}
        assert 0 < lo < 1 and all(weight[s] == pytest.approx(x, rel=1e-6) for s, x in weights(lo).items())
        places = {(r.source, r.block): r.place for r in got}
        times = {s: weight[s] * (budget or whole) / n for s, n in size.items()}
        epochs = spark.createDataFrame([(k, int(times[s])) for _, s, _, k in rows], "key long, whole long")
        order = {(r.key, r.whole): r.h for r in epochs.withColumn("h", F.xxhash64("key", "whole")).collect()}
        want, partly = [], 0
        for s in size:
            own = [r for r in rows if r[1] == s]
            n_blocks, full = -(-len(own) // 16), int(times[s])
            rest, done = (times[s] - full) * size[s], 0
            blocks = {}
            for r in own:
                blocks.setdefault(r[3] % n_blocks, []).append(r)
            for b in sorted(blocks, key=lambda b: (places[s, b], b)):
                docs = sorted(blocks[b], key=lambda r: (order[r[3], full], r[3], r[2]))
                held, begun = 0, done
                done += sum(r[2] for r in docs)
                for d, _, n, _ in docs:
                    held += n
                    more = n > 0 and (done <= rest or begun < rest and begun + held <= rest)
                    want.append((d, s, n, full + more, b))
                partly += begun < rest < done
            assert rest - 40 <= sum((c - full) * n for _, t, n, c, _ in want if t == s) <= rest
        assert partly >= 3 and len({c for *_, c, _ in want}) > 1
        assert sorted(((r.doc_id, r.source, r.n_tokens, r.copies, r.block) for r in got), key=repr) == sorted(want, key=repr)


def test_flat_text():
    from quillgraph.llm.arrays import flat_text, packed, packed_keys, unpacked, unpacked_keys

    data, offsets = flat_text(pa.array(["x", None, "", "é"]).slice(1))
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 0, 2]
    keys = np.array([3, 9, 2**63], np.uint64)
    assert unpacked_keys(packed_keys(keys)).tolist() == keys.tolist()
    assert unpacked(packed(np.array([1, -5])), np.int64).tolist() == [1, -5]


def test_toxic_beginnings(spark):
    """Rare words of one family score by their common beginning, which no single word would reach."""
    rng = random.Random(8)
    family = [f"zarquon{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    clean = [(k, prose(rng, 80)) for k in range(200)]
    toxic = [(1000 + k, " ".join([prose(rng, 30), *rng.sample(family, 3), prose(rng, 30)])) for k in range(60)]
    docs = spark.createDataFrame([*clean, *toxic], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k, _ in clean] + [(k, 1) for k, _ in toxic], "doc_id long, toxic int")
    odds = toxicity.toxic_odds(docs, labels, train="doc_id % 2 = 0")
    assert b"zarquon\0" in odds.scores
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.toxic_passages(docs, odds).collect()}
    assert all(got[k] for k, _ in toxic) and not any(got[k] for k, _ in clean)
