"""Benchmark decontamination against an alignment by the whole table, one cell at a time."""

import random

import numpy as np
import pyarrow as pa

from quillgraph.llm import decontaminate as D

WORDS = [f"w{k}{c}" for k in range(60) for c in "ab\u00e9\u0416"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        text[rng.randrange(len(text))] = rng.choice(["q", "z", "j ", ""])
    return "".join(text)


def slow(pattern, text, most):
    """The region of least edits, then earliest end, then latest begin."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        new = [(i, 0)]
        for j, t in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (p != t), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    least = min(r[0] for r in row)
    end = [r[0] for r in row].index(least)
    return (least, -row[end][1], end) if least <= most else None


def all_regions(items, texts):
    out = []
    for d, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        line, _, where = D.fold(raw, np.array([0, len(raw)]))
        for item, own in items:
            for b, e, share in D.cuts(len(own)):
                most, _ = D.budget(e - b, D.EDITS * share)
                todo = [(0, len(line))]
                while todo:
                    x, y = todo.pop()
                    found = slow(own[b:e].tolist(), line[x:y].tolist(), most)
                    if found and found[2] > found[1]:
                        edits, p, q = found
                        out.append((d, item, int(where[x + p]), edits, e - b))
                        todo += [(x, x + p), (x + q, y)]
    return sorted(out)


def test_aligned():
    rng = random.Random(3)
    for _ in range(120):
        p, t = D.folded_item(prose(rng, 4)), D.folded_item(prose(rng, rng.randint(0, 9)))
        if rng.random() < 0.6:
            k = rng.randint(0, len(t))
            t = np.concatenate((t[:k], D.folded_item(edited(rng, "".join(map(chr, p)), rng.randint(0, 4))), t[k:]))
        for most in (0, 2, 5, len(p)):
            assert D.aligned(p, t, most) == slow(p.tolist(), t.tolist(), most)


def test_every_region():
    rng = random.Random(4)
    items = [(k, D.folded_item(prose(rng, 30))) for k in range(3)] + [(7, D.folded_item("kurz und gut"))]
    of = lambda k, a=0, b=None: "".join(map(chr, items[k][1][a:b]))
    texts = [prose(rng, 20), of(0), prose(rng, 5) + " " + edited(rng, of(1), 6) + " " + prose(rng, 4) + " " + edited(rng, of(1, 0, 90), 2), None, "", "Kurz, und GUT kurz und gut kurz und gut", of(2, 10, 95) + of(2, 0, 70), of(0).upper() + "\n" + of(0)]
    got = sorted((r, i, b, e, n) for r, i, b, _, e, n in D.leaks_in(D.index_of(items), pa.array(texts)))
    assert got == all_regions(items, texts) and len({r for r, *_ in got}) == 5


def test_regions_of_one_window():
    index = D.index_of([(1, D.folded_item("quick brown foxes"))])
    text = "quick brown foxes zz Quick BROWN f\u00f6xes \u00e9"
    assert sorted(D.leaks_in(index, pa.array([text]))) == [(0, 1, 0, 17, 0, 17), (0, 1, 21, 39, 0, 17)]


def test_other_scripts():
    item = "\u041f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440 \u0438 \u043b\u044e\u0434\u0438, \u043a\u0430\u043a \u0434\u0435\u043b\u0430 \u0443 \u0432\u0430\u0441"
    index = D.index_of([(1, D.folded_item(item))])
    assert list(D.leaks_in(index, pa.array([item.upper().replace(",", "!")]))) == [(0, 1, 0, len(item.encode()), 0, 32)]
    odd = "a\u0301\u00e9 \U0001f600\U00020000 \ud55c\uae00 \u0928\u092e\u0938\u094d\u0924\u0947".encode()
    line, rows, at = D.characters(np.frombuffer(odd, np.uint8), np.array([0, 3, len(odd)]))
    assert "".join(map(chr, line)) == odd.decode() and rows.tolist() == [0, len(odd[:3].decode()), len(odd.decode())]
    assert [odd[a:b].decode() for a, b in zip(at, [*at[1:], len(odd)])] == list(odd.decode())


def test_short_quotes():
    rng = random.Random(9)
    item = " ".join(f"v{rng.randrange(10**5)}" for _ in range(40))
    index = D.index_of([(5, D.folded_item(item))])
    found = lambda quote: {f[1] for f in D.leaks_in(index, pa.array([f"{prose(rng, 20)} {quote} {prose(rng, 20)}"]))}
    for at in range(len(item) - 80 + 1):
        assert found(item[at : at + 80]) == {5}
    assert found(item[-120:]) == found(item) == {5}
    assert found(item[50:80]) == set() == found("")


def test_tables(spark, monkeypatch):
    """Nulls, empty and long texts, repeated and ambiguous ids, clashing columns, empty tables, several blocks and pieces."""
    rng = random.Random(6)
    items = [(k, prose(rng, 30), k) for k in range(6)] + [(90, "tiny", None), (91, None, 1), (None, prose(rng, 30), 2), (0, prose(rng, 30), 3)]
    leaky = [(10, items[0][1].upper().replace(" ", "\n\n")), (11, prose(rng, 30) + " " + edited(rng, items[1][1], 4) + " " + prose(rng, 50)), (12, items[2][1][:130]), (13, prose(rng, 9000) + items[3][1]), (None, items[4][1]), (20, items[5][1]), (14, items[8][1])]
    clean = [(20, prose(rng, 100)), (21, None), (22, ""), (23, "tiny"), (None, prose(rng, 9)), (20, prose(rng, 60))]
    rows = [(d, t, 5, "x", 1.5) for d, t in [*leaky, *clean, leaky[0], clean[0]]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id int, leaked string, n_items double").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string, begin int")

    def check():
        got = {r.doc_id: r for r in D.contaminated(frame, bench).collect()}
        assert set(got) == {10, 11, 12, 13, 14, 20, None} and {k: got[k].item_id for k in (10, 11, 12, 13, 14, None)} == {10: 0, 11: 1, 12: 2, 13: 3, 14: None, None: 4}
        kept = D.without_leaks(frame, bench)
        assert kept.columns == frame.columns
        assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in frame.collect() if (r.doc_id, r.text) in set(clean))
        return sorted(map(repr, D.leaks(frame, bench).distinct().collect()))

    whole = check()
    monkeypatch.setattr(D, "MAX_CHARS", 400)
    assert check() == whole  # a block holds one or two items
    monkeypatch.setattr(D, "MAX_CHARS", 190)
    D.contaminated(frame, bench).collect()
    assert len(list(D._blocks(bench))) > 6
    assert D.contaminated(frame.limit(0), bench).count() == 0 == D.contaminated(frame, bench.limit(0)).count()
    assert D.without_leaks(frame.limit(0), bench).count() == 0 and D.without_leaks(frame, bench.limit(0)).count() == len(rows)
