import os
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
from plain import DOCUMENTS, contamination, edited, near_copy_groups, odd_documents, prose, repeats
from tokenizers import Tokenizer

import corpus_pipeline
from parcelflow.llm.queries import ORACLE, QUERIES

ITEMS = [(1, "w1 w2 w3 w4"), (2, None)]


def _folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(3, " ".join(rows[12][1].split()[:14])), *ITEMS]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return items


def test_equals_plain_stages(spark, tmp_path):
    rows = list(dict.fromkeys(r for r in odd_documents() if r[0] is not None))
    rng = random.Random(9)
    story = prose(rng, 150, 5000)
    rows += [(700, story, "en", "s", 1), *((701 + k, edited(rng, story, 1 + k % 3), "en", "s", 1) for k in range(12))]
    items = _folder(spark, tmp_path, rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    groups = near_copy_groups(kept)
    assert any(len({r[1] for r in group}) > 5 for group in groups)
    kept = [min(group, key=lambda r: r[0]) for group in groups]
    kept = [(r[0], text if gone else r[1]) for r, (_, _, gone, text) in zip(kept, repeats(kept), strict=True)]
    kept = [r for r, (_, _, hit, _) in zip(kept, contamination(kept, items), strict=True) if not hit]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for d, t in kept}
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        piece = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids"] == piece.tolist() and r["ids_crc32"] == zlib.crc32(piece.tobytes())
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))


def test_stages_keep_the_columns(spark, tmp_path):
    rows = odd_documents()
    _folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.names == docs.schema.names, name
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = out


def test_workers_need_no_copy_of_the_package(sf):
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = f"""import sys; sys.path.insert(0, {repo!r})
from parcelflow.session import local_session
spark = local_session(2)
from parcelflow.llm.queries import QUERIES
print("ROWS", [QUERIES[n](spark, {sf!r}).count() for n in ("op1_substring_dedup", "op2_html_extraction", "op7_quality_ranking", "op8_simhash_golay")])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYSPARK")}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [200, 50, 200, 200]" in done.stdout, done.stderr[-2000:]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) < set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
