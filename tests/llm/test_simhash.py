import numpy as np
import xxhash

from quantloom.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(make, sample):
    assert got(simhash.near_duplicates(make(sample))) == brute(sample)


def test_edges(make):
    rows = [(5, None), (2, ""), (9, "one"), (7, "ONE"), (3, "a b"), (3, "a b"), (None, "one"), (11, "é É x y"), (12, "w " * 5000), (13, " \t w\n" * 5000)]
    assert got(simhash.near_duplicates(make(rows))) == brute(rows)
    assert got(simhash.near_duplicates(make([]))) == []


def test_pivots_discard_and_lose_nothing():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps[200:] = fps[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    table = np.bitwise_count(fps[:, None] ^ simhash.pivots()[None, :]).astype(np.int8)
    for n in (400, 9):
        a, b = np.triu_indices(n, 1)
        x, y = simhash.verified(fps, table, a, b)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= 3
        assert set(zip(x.tolist(), y.tolist())) == set(zip(a[near].tolist(), b[near].tolist()))
    far = np.zeros_like(table)
    far[::2] = 9  # a table that sets all even rows apart from the odd ones: its coordinates decide before any check
    x, y = simhash.verified(fps, far, np.array([0, 0]), np.array([200, 201]))
    assert y.tolist() == [200]


def test_links_survive_every_split():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 3000)]
    for _ in range(6):
        near = near ^ np.where(rng.random(3000) < 0.5, np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64), np.uint64(0))
    fps = np.unique(np.concatenate((base, near)))
    want = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    from quantloom.llm.graph import local_roots

    a, b = np.nonzero(np.triu(want, 1))
    expected = local_roots(len(fps), a, b)
    files, keys, all_fps = [], [], []
    for k, (i, j) in enumerate(simhash.BAND_PAIRS):
        files.append(np.full(len(fps), k))
        keys.append((fps & (simhash.BANDS[i] | simhash.BANDS[j])).view(np.int64))
        all_fps.append(fps)
    x, y = simhash.file_links(np.concatenate(files), np.concatenate(keys), np.concatenate(all_fps))
    at = {int(v): i for i, v in enumerate(fps)}
    root = local_roots(len(fps), np.array([at[int(v)] for v in x]), np.array([at[int(v)] for v in y]))
    assert (root == expected).all()
    # one file of everything, split by sub-bands because it is over the limit
    table = np.bitwise_count(fps[:, None] ^ simhash.pivots()[None, :]).astype(np.int8)
    edges = simhash.run_links(fps, table, np.arange(len(fps)), list(range(64)), most=100)
    root = local_roots(len(fps), np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
    assert (root == expected).all()


def test_stage_keeps_one_of_each_group(spark, make):
    rows = [(1, "a b c d"), (4, "a b c d"), (2, "q r s t u"), (None, "a b c d")]
    out = simhash.stage(spark, make(rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["1", "2", "None"]


def test_components_of_a_long_chain(spark):
    from quantloom.llm.graph import connected_components

    edges = [(i + 1, i) for i in range(200) if i != 120] + [(500, 500)]
    got_ = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got_[i] == (0 if i <= 120 else 121) for i in range(201) if i not in (0, 121))
