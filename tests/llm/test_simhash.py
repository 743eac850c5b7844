import numpy as np
import pytest
import xxhash

from inkshard.llm import simhash as S
from inkshard.llm.simhash import components, fingerprint, fuzzy_keys, near_copies


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(prints, ids):
    """Smallest id reachable over links of at most 4 bits."""
    label = list(range(len(prints)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min([v for v in (least.get(find(i)), x) if v is not None], default=None)
    return [least[find(i)] for i in range(len(prints))]


def check(df, **limits):
    rows = near_copies(df, **limits).collect()
    source = df.collect()
    prints = [brute_print(r.text) for r in source]
    want = [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(source, prints, brute_components(prints, [r.doc_id for r in source]), strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in rows)


@pytest.mark.parametrize("hot_bucket", [S.HOT_BUCKET, 1])
def test_awkward_rows(awkward, nothing, hot_bucket):
    check(awkward, hot_bucket=hot_bucket)
    assert near_copies(nothing).collect() == []


@pytest.mark.parametrize("hot_bucket", [S.HOT_BUCKET, 2])
def test_given_documents(spark, hot_bucket):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), hot_bucket=hot_bucket)


def test_rendered_documents(documents):
    check(documents)


def test_golay_codewords():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 1 << 23, 5000)
    for n in (0, 1, 2):
        v = u.copy()
        for bits in rng.permuted(np.tile(np.arange(23), (5000, 1)), axis=1).T[:n]:
            v ^= 1 << bits
        both = S.codewords(u)[:, :, None] == S.codewords(v)[:, None, :]
        assert (both & (S.codewords(u)[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_prints_within_four_bits_share_a_key():
    rng = np.random.default_rng(2)
    u = rng.integers(-(2**63), 2**63, 3000)
    flips = np.bitwise_or.reduce(np.int64(1) << rng.permuted(np.tile(np.arange(64), (3000, 1)), axis=1)[:, :4], axis=1)
    keys = [{}, {}]
    for side, prints in zip(keys, (u, u ^ flips), strict=True):
        for k, r in zip(*fuzzy_keys(prints), strict=True):
            side.setdefault(int(r), set()).add(int(k))
    assert all(keys[0][i] & keys[1][i] for i in range(3000))


def test_crowded_buckets(spark):
    """Hundreds of fingerprints around one point, by pairs and by ball points."""
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 2**62))
    prints = sorted({center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(300)})
    prints = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    want = brute_components([p & (2**64 - 1) for p in prints], list(range(len(prints))))
    for limit in (S.HOT_BUCKET, 4):
        root = {r.node: r.root for r in components(S.print_links(df, limit)).collect()}
        mine = [root.get(p, p) for p in prints]
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7), (2000, 1999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 30)} | {2000: 1999}


def test_fingerprint_cases():
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0
    assert fingerprint("ONE Two") == fingerprint("one two") == fingerprint("one \t two") != 0
    assert fingerprint("É a b c d") != fingerprint("é a b c d")
