from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from plain import DOCUMENTS, classes, fingerprint, odd_documents, ordered

from parcelflow.llm.components import connected_components
from parcelflow.llm.golay import nearby_indices
from parcelflow.llm.op8_simhash_golay import fingerprint_edges, fingerprints, golay_keys, one_of_each, simhash_components


def test_words_two_bits_apart_share_a_codeword():
    # the code is linear, so one word of each remainder stands for all
    words = np.array([0] + [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in combinations(range(23), n)])
    own = nearby_indices(words)
    assert len(words) == 2048 and set((own >= 0).sum(axis=1)) == {1, 6}
    for n in (1, 2):
        for bits in combinations(range(23), n):
            other = nearby_indices(words ^ sum(1 << b for b in bits))
            assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_fingerprints():
    texts = [t for _, t, *_ in odd_documents()]
    assert [int(x) for x in fingerprints(pa.array(texts)).view(np.uint64)] == [fingerprint(t) for t in texts]


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(3)
    for fp in rng.integers(0, 2**63, 40, dtype=np.uint64):
        own = set(golay_keys(np.array([fp]).view(np.int64))[0].tolist())
        for a, b in combinations(range(64), 2):
            other = np.array([fp ^ np.uint64(1 << a) ^ np.uint64(1 << b)])
            assert own & set(golay_keys(other.view(np.int64))[0].tolist())


def _clustered(seed):
    rng = np.random.default_rng(seed)
    found = set()
    for centre in rng.integers(0, 2**63, 40, dtype=np.uint64).tolist():
        x = centre
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            found.add(x)
    # a dense group: every fingerprint within two bits of one
    found |= {7 ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    return sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 500])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    import parcelflow.llm.op8_simhash_golay as op

    monkeypatch.setattr(op, "_BLOCK", block)
    prints = _clustered(5)
    signed = [int(x) for x in np.array(prints, dtype=np.uint64).view(np.int64)]
    edges = fingerprint_edges(spark.createDataFrame([(x,) for x in signed], "fp long"))
    label = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    want = classes(prints)
    groups = {}
    for s, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def _want(rows):
    prints = [fingerprint(r[1]) for r in rows]
    of = classes(prints)
    least = {}
    for r, c in zip(rows, of, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return [(r[0], f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, of, strict=True)]


def test_rows_equal_definition(spark):
    rows = odd_documents()
    got = simhash_components(spark.createDataFrame(rows, DOCUMENTS), carry=["doc_id"])
    assert ordered(got.collect()) == ordered(_want(rows))
    assert simhash_components(spark.createDataFrame([], DOCUMENTS)).count() == 0
    clash = simhash_components(spark.createDataFrame([(*r, -1) for r in rows], DOCUMENTS + ", component_id int"))
    assert ordered(clash.select("doc_id", "fingerprint", "component_id").collect()) == ordered(_want(rows))


def test_one_of_each(spark):
    rows = odd_documents()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCUMENTS + ", fp int, __text_key int")
    got = one_of_each(docs)
    assert got.schema.names == docs.schema.names
    want = _want(rows)
    keep = {(d, rows[i][1]) for i, (d, _, c) in enumerate(want) if d == c}
    have = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(have) == len(set(have)) and set(have) == keep
