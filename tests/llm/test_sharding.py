import numpy as np
import pytest

from quantloom.llm import sharding


def test_every_slot_is_claimed_and_turns_are_even():
    t = sharding.lookup_table([f"s{i}" for i in range(10)], 1009)
    assert sorted(np.bincount(t)) in ([100] + [101] * 9, [100, *[101] * 9])
    w = sharding.lookup_table({"a": 3, "b": 1, "c": 0}, 1009)
    assert abs(np.bincount(w)[0] - 3 * np.bincount(w)[1]) <= 3


def test_brute_force_turns():
    import xxhash

    names, size = ["x", "y", "z"], 13
    owner = {}
    orders = {s: [(xxhash.xxh64_intdigest(s.encode(), 1) % size + k * (xxhash.xxh64_intdigest(s.encode(), 2) % (size - 1) + 1)) % size for k in range(size)] for s in names}
    while len(owner) < size:
        for s in names:
            free = [x for x in orders[s] if x not in owner]
            if free:
                owner[free[0]] = s
    assert [names[i] for i in sharding.lookup_table(names, size)] == [owner[i] for i in range(size)]


def test_losing_a_shard_moves_little():
    names = sorted(f"s{i}" for i in range(20))
    a = [names[i] for i in sharding.lookup_table(names)]
    rest = names[:7] + names[8:]
    b = [rest[i] for i in sharding.lookup_table(rest)]
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != names[7])
    assert moved < 0.05 * len(a)


def test_place(spark):
    df = spark.createDataFrame([(1, "p", 5), (1, "q", 6), (None, "r", 7), (3, "s", 8)], "doc_id long, shard string, slot int")
    out = sharding.place(df, "doc_id", ["a", "b"], 101).collect()
    assert len(out) == 4 and all(r["shard"] in "ab" for r in out)
    assert len({(r["slot"], r["shard"]) for r in out if r["doc_id"] == 1}) == 1
    assert sharding.place(df.limit(0), "doc_id").collect() == []


def test_a_key_gets_the_shard_of_its_slot_whatever_columns_are_named(spark):
    df = spark.createDataFrame([(i, "p", i, -i) for i in range(50)], "`a.b` long, _shard string, _slot int, x int")
    out = sharding.place(df, "a.b", ["s1", "s2"], 101)
    assert out.columns == ["a.b", "_shard", "_slot", "x", "slot", "shard"]
    owner = sharding.lookup_table(["s1", "s2"], 101)
    from pyspark.sql import functions as F

    want = {r["x"]: r["s"] for r in df.select("x", F.pmod(F.xxhash64(F.col("`a.b`").cast("string")), F.lit(101)).alias("s")).collect()}
    for r in out.collect():
        assert (r["_shard"], r["_slot"], r["slot"]) == ("p", -r["x"], want[r["x"]]) and r["shard"] == ["s1", "s2"][owner[r["slot"]]]


def test_bad_tables():
    for bad in ([], ["a"] * 0):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)
