"""The pipeline's stages, one after another, on a small table with cases that each must catch."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline as cp

WORDS = "the and attion thanedble erine thnt reor oned stion therea blou heha wast nder ithe oning".split()


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return ". ".join(" ".join(rng.choice(WORDS) + rng.choice("abcdefgh") * (i % 3) for i in range(12)).capitalize() for _ in range(n // 12)) + "."


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    at = tmp_path_factory.mktemp("sf")
    good = [prose(i, 120) for i in range(60)]
    leak = prose(900, 24)
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100, good[0]), (101, good[1] + " one more"), (102, good[2][:50] + " " + leak + " " + good[3][:80]), (103, prose(7000, 60) + " Write to a.b@c.org now.")]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in good[i].split())) for i in range(8)] + [(300, None), (301, ""), (302, "  \n")]
    table = spark.createDataFrame([(i, t, "en", "src", len(t or ""), "mine") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    table.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        columns = docs.columns
        docs = stage(spark, docs, sf).cache()
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_duplicates":
            tops = brute.near(before, 5)
            assert kept[name] == {d for d, (_, top) in tops.items() if d == top}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert kept[name] == {d for d, t in before.items() if not brute.contaminated(t, items)[2]}
        if name == "personal_data":
            assert kept[name] == set(before)
            row = docs.where("doc_id = 103").first()
            assert "[EMAIL]" in row["text"] and row["n_chars"] == len(row["text"]) and row["score"] == "mine"
    assert not kept["quality"] & {*range(200, 208), 300, 301, 302} and set(range(60)) <= kept["quality"]
    assert 100 not in kept["near_duplicates"] and 101 not in kept["near_duplicates"] and 102 not in kept["decontamination"]
    assert {r["doc_id"] for r in cp.run(spark, sf).collect()} == kept["tokens"]


def test_empty(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = docs if "text" not in out.columns else out
