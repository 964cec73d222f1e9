"""The pipeline's stages against brute force on the smallest tables, and awkward rows through all of them."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from stockroom.llm.importance import resample
from tests.llm.test_dedup import brute, edited
from tests.llm.test_packing_pieces import check_packed
from tests.llm.test_quality import kept_by_hand, limits_by_hand


def test_stages(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "packing"] and cp.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = cp.scratch.save(cp.quality_rules(spark, docs, sf_dir), "t1")
    table = limits_by_hand([r["text"] for r in docs.collect()])
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect() if kept_by_hand(r["text"], table)} and one.columns == docs.columns
    two = cp.scratch.save(cp.quality_classifier(spark, one, sf_dir), "t2")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(r["doc_id"] for r in resample(one, labels).where("selected").collect()) and two.columns == docs.columns
    three = cp.scratch.save(cp.near_dedup(spark, two, sf_dir), "t3")
    groups = brute([(r["doc_id"], r["text"]) for r in two.collect()], 80)
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({*groups.values()}) and three.columns == docs.columns
    check_packed(cp.packing(spark, three, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in three.collect()])
    assert cp.run(spark, sf_dir).count() == cp.packing(spark, three, sf_dir).count()

def test_awkward(spark, awkward, nothing, sf_dir):
    for docs in (awkward, nothing):
        left = docs
        for _, stage in cp.STAGES[:-1]:
            left = cp.scratch.save(stage(spark, left, sf_dir), "awkward")
            assert left.columns == docs.columns
        check_packed(cp.packing(spark, left, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in left.collect()])
    kept = cp.near_dedup(spark, awkward, sf_dir).collect()
    groups = brute([(r["doc_id"], r["text"]) for r in awkward.where("doc_id is not null").collect()], 80)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({*groups.values()}) and 8 not in groups.values()
    assert sum(r["doc_id"] is None for r in kept) == 2
    left = cp.quality_classifier(spark, awkward, sf_dir).where("doc_id = 9").first()
    assert (left["rank"], left["row"], left["good"], left["noise"], left["group"], left["key"], left["quality"]) == (1, "r", True, 0.5, "g", "k", "q")
    clash = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("quality", F.lit("q")).withColumn("row", F.lit(1))
    assert {(r["quality"], r["row"]) for r in cp.quality_rules(spark, clash, sf_dir).collect()} == {("q", 1)}

def test_ids_with_several_texts_leave_the_same_row_in_any_order(spark, sf_dir):
    rnd = random.Random(8)
    a, b, c = (" ".join(f"w{rnd.randrange(900)}" for _ in range(90)) for _ in range(3))
    rows = [(2, a, "x", 1), (2, b, "y", 2), (2, b, "y", 1), (3, b, "z", 1), (4, c, None, 1), (4, c, "q", 0), (5, None, "n", 1), (5, "", "n", 1), (6, c + " more", "m", 1)]
    kept = [sorted(map(tuple, cp.near_dedup(spark, spark.createDataFrame(r, "doc_id long, text string, lang string, __twice long"), sf_dir).collect()), key=str) for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and sorted(r[0] for r in kept[0]) == [2, 4, 5, 5]


def test_near_copies_from_four_fifths_on_fall_away(spark, sf_dir):
    """Pairs at, just over and just under 0.8, and chains of edits, against brute force at 0.8."""
    rnd, texts = random.Random(3), []
    word = lambda: f"w{rnd.randrange(5000)}"
    for n in range(60, 140):  # the last `cut` words of the copy are others: (w - 4 - cut) of (w - 4 + cut) shingles are shared
        t = [word() for _ in range(n)]
        cut = round((n - 4) / 9) + rnd.randrange(-2, 2)
        texts += [t, t[:-cut] + [word() for _ in range(cut)]]
    for _ in range(5):
        t = [word() for _ in range(150)]
        for _ in range(8):
            texts.append(t)
            t = edited(rnd, t, rnd.randrange(1, 5))
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    up = list(range(len(sets)))
    between = exact = 0
    for i in range(len(sets)):
        for j in range(i):
            same, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            between, exact = between + (80 * all_ <= 100 * same < 85 * all_), exact + (10 * same == 8 * all_)
            if 100 * same >= 80 * all_ and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    assert between > 40 and exact > 3
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, sf_dir).collect()) == sorted({*up})
