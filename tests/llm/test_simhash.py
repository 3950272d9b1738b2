import random

from promptloom.llm import simhash
from promptloom.llm.shared import components

from .conftest import EDGE


def brute(rows):
    fps = [simhash.fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], f"{f:016x}", least.get(find(i))) for i, (r, f) in enumerate(zip(rows, fps))], key=str)


def test_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One TWO") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint("É a b") != simhash.fingerprint("é a b")


def test_edge_rows(edge, empty):
    got = simhash.near_dedup(edge).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == brute(EDGE)
    assert simhash.near_dedup(empty).count() == 0


def test_pairs_equal_brute_force(spark):
    rng = random.Random(0)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps):
        for n in (1, 2, 3):
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            fps.add(y)
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(r) for r in simhash.pigeonring_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_one_of_each_component_stays(edge):
    out = simhash.kept_documents(edge)
    assert out.columns == edge.columns
    assert out.count() == len({(r[2], r[2] is None and r[1]) for r in brute(EDGE)})
