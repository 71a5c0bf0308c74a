"""The pipeline's stages on the smallest table, and on one with nothing."""

import random

import numpy as np

import corpus_pipeline
from quillgraph.llm import near_copies
from quillgraph.llm.queries import queries
from quillgraph.llm.simhash import bits_of, segment_counts

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held, seen = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, DATA).persist()
        n = out.count()
        assert 0 < n <= seen
        if name != "mix":
            assert out.columns == docs.columns
        assert out.select("doc_id").exceptAll(held.select("doc_id")).isEmpty()
        held, seen = out, n
    assert corpus_pipeline.run(spark, DATA).count() == seen


def test_stages_on_nothing(spark):
    held = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, DATA)
        assert held.count() == 0


def test_names():
    assert [n.split("_")[0] for n in queries()] == [f"op{k}" for k in range(1, 11)]


def test_near_copies(spark):
    rng = random.Random(8)
    texts = []
    for k in range(60):  # an original and copies of which up to an eighth of the words is changed
        words = [f"w{rng.randrange(10**6)}" for _ in range(120 + k)]
        texts.append(words)
        for n in (1, 2, 3, 8, 15):
            at = rng.randrange(100)
            texts.append(words[:at] + [f"x{rng.randrange(10**6)}" for _ in range(n)] + words[at + n :])
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(d, " ".join(texts[k]), "x") for d, k in enumerate(order)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "one two", "x"), (1003, "One  two", "x"), (1004, "one three", "x"), (1005, rows[0][1].upper(), "x"), rows[5]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.near_duplicates(spark, frame, DATA)
    assert got.columns == frame.columns
    sets = {}
    for d, t, _ in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    near = {d: {e for e in sets if e != d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])} for d in sets}
    kept = {r.doc_id for r in got.collect()}
    assert not any(near[d] & kept for d in kept)
    least = {}
    for d in sorted(sets):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = least[d] if d in least else d
                todo += near[x]
    assert set(least.values()) == kept


def test_near_copies_in_blocks(spark, monkeypatch):
    test_near_copies(spark)
    monkeypatch.setattr(near_copies, "BLOCK_NODES", 2)
    monkeypatch.setattr(near_copies, "CELLS", 300)
    test_near_copies(spark)


def test_similar_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 90, np.uint64)
    sets = [np.unique(np.where(rng.random(90) < rng.choice([0, 0.02, 0.1, 0.3]), rng.integers(0, 1 << 60, 90, np.uint64), base)[: rng.integers(60, 91)]) for _ in range(80)]
    sets += [np.unique(rng.integers(0, 9, 5, np.uint64)) for _ in range(20)] + [np.empty(0, np.uint64)]
    fps = np.array([bits_of(s.astype(">u8").view(np.uint8).reshape(-1, 8)) if len(s) else 0 for s in sets], np.uint64)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i]) and len(sets[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert {p for p in zip(*near_copies.similar(sets, fps, 0.8).tolist()) if len(sets[p[0]])} == want
    few = sets[75:82]
    want = {(i - 75, j - 75) for i, j in want if 75 <= i and j < 82}
    assert set(zip(*near_copies.similar(few, fps[75:82], 0.8).tolist())) == want
    counts = segment_counts(fps).astype(int)
    assert all(np.abs(counts[i] - counts[j]).sum() <= int(fps[i] ^ fps[j]).bit_count() for i in range(30) for j in range(30))


def _least(n, pairs):
    """The smallest member that links reach, for each of n."""
    label = list(range(n))
    while True:
        new = list(label)
        for i, j in pairs:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new


def _prints(n):
    """Prints of which some are up to 100 bits from another, sizes, and the links to be found at 0.8."""
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 64, (n, near_copies.PRINTS), np.uint64)
    for k in range(1, n, 2):
        flips = np.zeros(64 * near_copies.PRINTS, np.uint8)
        flips[rng.choice(len(flips), rng.integers(0, 100), replace=False)] = 1
        prints[k] = prints[rng.integers(k)] ^ np.packbits(flips).view(np.uint64)
    sizes = rng.choice([1, 3, 4, 5, 60, 70, 72, 75, 76, 90, 95, 400], n)
    bits = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    return prints, sizes, bits


def test_counts_within_reach(spark, monkeypatch):
    """The pipeline's candidates are all pairs that the segment counts and prints leave within reach, whatever the cells and blocks."""
    n = 150
    prints, sizes, bits = _prints(n)
    counts = [segment_counts(prints[:, k]).astype(int) for k in range(near_copies.PRINTS)]
    codes = near_copies.unary(prints)
    manhattan = sum(np.abs(c[:, None] - c[None]).sum(2) for c in counts)
    assert (np.bitwise_count(codes[:, None] ^ codes[None]).sum(2) == manhattan).all() and (manhattan <= bits).all()
    allowed = np.minimum(sizes[:, None], sizes[None]) >= 0.8 * np.maximum(sizes[:, None], sizes[None])
    rows = np.arange(n)
    for tile, pending in (((64, 4096), 1 << 18), ((3, 8), 2)):
        monkeypatch.setattr(near_copies, "TILE", tile)
        monkeypatch.setattr(near_copies, "PENDING", pending)
        member, root = near_copies.near_prints(prints, sizes, [(rows, rows)], 72, 0.8)
        found = rows.copy()
        found[member] = root
        assert found.tolist() == _least(n, zip(*np.nonzero((bits <= 72) & allowed), strict=True))
    small, large = near_copies.reach(0.8, 4), near_copies.reach(0.8, near_copies.LARGE)
    # sets of another size may be in a class with those under LARGE, so it is the wider reach that counts for them
    use = (sizes < 50) | (sizes > 100)
    far = np.where(np.minimum(sizes[:, None], sizes[None]) < near_copies.LARGE, small, large)
    linked = (bits <= far) & allowed & use[:, None] & use[None] & (sizes[:, None] > 3) & (sizes[None] > 3)
    want = _least(n, zip(*np.nonzero(linked), strict=True))
    frame = spark.createDataFrame([(k, int(sizes[k]), *prints[k].view(np.int64).tolist()) for k in range(n) if use[k]], "node long, size long, " + ", ".join(f"fp{k} long" for k in range(near_copies.PRINTS)))
    for block in (8192, 10):
        monkeypatch.setattr(near_copies, "GRID_ROWS", block)
        monkeypatch.setattr(near_copies, "SPREAD", 4)
        links = [(r.src, r.dst) for r in near_copies.print_links(frame).collect()]
        assert _least(n, links) == want


def test_reach_of_similar_sets():
    """Pairs of similarity 0.8 exactly or more, of all sizes, have prints within reach; sets apart haven't."""
    rng = np.random.default_rng(6)
    assert near_copies.reach(0.8, 4) < 90
    for common, a, b in ((4, 0, 1), (8, 1, 1), (12, 0, 3), (60, 7, 8), (66, 0, 16), (200, 25, 25), (400, 0, 100)):
        far = near_copies.reach(0.8, near_copies.LARGE if common + a >= near_copies.LARGE else 4)
        seen = []
        for _ in range(40):
            x = rng.integers(0, 1 << 64, common + a + b, np.uint64)
            one, two = (np.array(near_copies.prints_of(np.sort(y)), np.uint64) for y in (x[: common + a], np.concatenate((x[:common], x[common + a :]))))
            seen.append(int(np.bitwise_count(one ^ two).sum()))
        assert max(seen) <= far
        assert abs(np.mean(seen) / (64 * near_copies.PRINTS) - near_copies._chance(a, b, common)) < 0.02
    assert near_copies.prints_of(x)[0] == bits_of(x.astype(">u8").view(np.uint8).reshape(-1, 8))


def test_one_pair_of_near_copies(spark):
    words = [f"w{k}" for k in range(100)]
    frame = spark.createDataFrame([(3, " ".join(words)), (2, " ".join([*words, "more"]))], "doc_id long, text string")
    assert [r.doc_id for r in near_copies.distinct_documents(frame).collect()] == [2]


def _generated(spark, job):
    """Rows that the Generate nodes of a job's plans put out."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        found = store.executionsList()
        return {found.apply(k).executionId() for k in range(found.size())}

    before = executions()
    job()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    rows = 0
    for one in executions() - before:
        values, each = {}, store.executionMetrics(one).iterator()
        while each.hasNext():
            pair = each.next()
            values[pair._1()] = pair._2()
        nodes = store.planGraph(one).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "Generate":
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                rows += sum(int(values.get(m.accumulatorId(), "0").replace(",", "")) for m in metrics if m.name() == "number of output rows")
    return rows


def test_rows_grow_with_the_table(spark, monkeypatch):
    """The pipeline's near_duplicates: unrelated documents of one size aren't dealt to blocks that all meet."""
    monkeypatch.setattr(near_copies, "GRID_ROWS", 50)
    rng = random.Random(9)
    rows = {}
    for n in (200, 800):
        frame = spark.createDataFrame([(d, " ".join(f"w{rng.randrange(10**6)}" for _ in range(75))) for d in range(n)], "doc_id long, text string")
        rows[n] = _generated(spark, lambda frame=frame: near_copies.similar_groups(frame))
    assert 0 < rows[200] and rows[800] < 5 * rows[200]


def test_similar_sets_share_cells():
    """Sets of similarity 0.8 share several cells, whatever their sizes and the scales between them; sets apart share none."""
    rng = np.random.default_rng(10)
    sizes = [(4, 0, 1), (8, 1, 1), (12, 0, 3), (13, 1, 2), (52, 13, 0), (51, 0, 12), (60, 7, 8), (102, 0, 25), (127, 16, 15), (103, 0, 25), (203, 51, 0), (204, 25, 26), (411, 0, 102), (1640, 200, 200)]
    for common, a, b in sizes:
        for _ in range(40):
            x = rng.integers(0, 1 << 64, common + a + b, np.uint64)
            one, two = (np.sort(y) for y in (x[: common + a], np.concatenate((x[:common], x[common + a :]))))
            shared = np.intersect1d(near_copies.portion_cells(one), near_copies.portion_cells(two))
            assert len(shared) >= 4
            other = near_copies.portion_cells(np.sort(rng.integers(0, 1 << 64, common + a, np.uint64)))
            assert not len(np.intersect1d(shared, other))
    assert not len(near_copies.portion_cells(x[:3])) and not len(near_copies.portion_cells(x[:0]))
    for scale in range(16):
        for similarity in (0.3, 0.5, 0.8, 0.95, 1):
            n, used = near_copies.portions(scale, similarity)
            assert 0 <= used <= n and n & (n - 1) == 0
    half = np.sort(rng.integers(0, 1 << 64, 300, np.uint64))
    assert len(np.intersect1d(near_copies.portion_cells(half[:200], 0.3), near_copies.portion_cells(half[100:], 0.3)))


def test_links_in_cells():
    """Within cells, small or large, sets are linked that the prints leave within reach and no others."""
    n = 150
    prints, sizes, bits = _prints(n)
    cell = np.sort(np.random.default_rng(7).choice([1, 2, 2, 2, 3, 4, 5, 5, 5, 5], n))
    small, large = near_copies.reach(0.8, 4), near_copies.reach(0.8, near_copies.LARGE)
    allowed = np.minimum(sizes[:, None], sizes[None]) >= 0.8 * np.maximum(sizes[:, None], sizes[None])
    for which, far in ((sizes < 50, small), (sizes > 100, large)):
        at = np.flatnonzero(which)
        linked = ((bits <= far) & allowed & (cell[:, None] == cell[None]))[np.ix_(at, at)]
        found = near_copies.near_in_cells(cell[at], prints[at], sizes[at], 0.8)
        assert _least(len(at), zip(*found, strict=True)) == _least(len(at), zip(*np.nonzero(linked), strict=True))


def test_near_copies_in_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "GRID_ROWS", 3)
    monkeypatch.setattr(near_copies, "SPREAD", 3)
    test_near_copies(spark)
