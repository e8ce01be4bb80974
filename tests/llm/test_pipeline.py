import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import near_copies, quality_classifier, quality_rules, queries, simhash, stages


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    good = [(i, text(rng.randrange(80, 300))) for i in range(200)]
    copies = [(300 + i, good[i][1]) for i in range(20)]
    junk = [(400 + i, " ".join(w.upper() + "!!" for w in text(100).split())) for i in range(60)]
    short = [(500, None), (501, "a b"), (502, "same words here again now " * 20)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in good + copies + junk + short]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_follow_their_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "packing"]
    (_, rules), (_, classifier), (_, near), (_, pack) = corpus_pipeline.STAGES
    kept = rules(spark, docs, folder)
    assert kept.columns == columns and ids(kept) == ids(quality_rules.judge(docs).where("kept")) and not ids(kept) & {500, 501, 502}
    better = classifier(spark, kept, folder)
    scored = quality_classifier.classify(kept, spark.read.parquet(f"{folder}/labels.parquet"))
    assert better.columns == columns and ids(better) == ids(scored.where("predicted = 1")) and not any(400 <= i < 500 for i in ids(better))
    assert set(range(200)) <= ids(better)
    single = near(spark, better, folder)
    assert single.columns == columns and ids(single) == ids(simhash.near_duplicates(better).where("doc_id = component_id")) and not any(300 <= i < 400 for i in ids(single))
    whole = corpus_pipeline.run(spark, folder)
    assert ids(whole) == ids(single) and ids(pack(spark, single, folder)) == ids(single)


def test_near_copies_are_found_down_to_a_similarity_of_four_fifths(spark, monkeypatch):
    """Against all pairs; in one block a part, and dealt out over many."""
    rng = random.Random(9)
    sets, docs = {}, []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        docs.append((base, " ".join(words)))
        for k in range(3):
            edited = list(words)
            for _ in range(rng.randrange(1, 1 + len(words) // 30)):
                edited[rng.randrange(len(edited))] = f"new{rng.randrange(10**6)}"
            docs.append((100 + base * 3 + k, " ".join(edited)))
    docs += [(900, None), (901, " "), (902, "a b"), (903, "a  B"), (None, docs[0][1]), (None, "x y z"), (904, docs[5][1]), (904, "some other text of this id")]
    for i, (_, t) in enumerate(docs):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0
    near = 0
    for i in range(len(docs)):
        for j in range(i):
            if None not in (docs[i][0], docs[j][0]) and (docs[i][0] == docs[j][0] or alike(sets[i], sets[j])):
                near += sets[i] != sets[j] and len(sets[i] & sets[j]) < 0.95 * len(sets[i] | sets[j])
                root[top(i)] = top(j)
    assert near > 20
    want = set()
    for i, (d, _) in enumerate(docs):
        if d is not None:
            want.add((d, min(docs[j][0] for j in range(len(docs)) if docs[j][0] is not None and top(j) == top(i))))
    want |= {(None, 0), (None, None)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk in (near_copies.CHUNK, 2):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        assert {tuple(r) for r in near_copies.near_copies(frame).collect()} == want
    kept = {r["doc_id"] for r in stages.near_duplicates(spark, frame, "").collect()}
    assert kept == {d for d, c in want if d == c}
    assert near_copies.near_copies(frame.limit(0)).count() == 0


def test_a_large_chained_part_meets_by_bands(spark, monkeypatch):
    """Ninety texts, each near to the next alone, and as many that share no more than a passage: one component and many, however small the blocks."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(1200)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 150])) for i in range(90)]
    passage = " ".join(f"p{i}" for i in range(60))
    apart = [(1000 + i, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for i in range(90)]
    docs = spark.createDataFrame(chain + apart, "doc_id long, text string")
    want = {(i, 0) for i, _ in chain} | {(i, i) for i, _ in apart}
    for chunk in (4096, 16, 3):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        assert {tuple(r) for r in near_copies.near_copies(docs).collect()} == want


def test_candidates_come_through_the_trees(spark, monkeypatch):
    """Fingerprints are SimHashes, and those within the radius of each other, equal or not, are linked by op1's trees."""
    rng = random.Random(12)
    docs = []
    for base in range(30):
        words = [f"w{rng.randrange(9000)}" for _ in range(1500)]
        docs.append((base, " ".join(words)))
        words[rng.randrange(1500)] = "other"
        docs.append((100 + base, " ".join(words)))
    sets = [near_copies.shingles(t.encode(), near_copies.Hashes()) for _, t in docs]
    fps = near_copies.prints(sets)
    for found, fp in zip(sets[:4], fps, strict=False):
        plain = sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in found) * 2 > len(found))
        assert int(fp.view("u8")[0] ^ near_copies._KIND[0]).bit_count() == plain.bit_count()
    seen, real = [], near_copies.near_prints

    def watched(reps, radius, **more):
        found = real(reps, radius, **more)
        seen.append((radius, {(r["a"], r["b"]) for r in found.collect()}))
        return found

    monkeypatch.setattr(near_copies, "near_prints", watched)
    got = {tuple(r) for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(i, i % 100) for i, _ in docs}
    assert [r for r, _ in seen] == [near_copies.RADIUS, near_copies.SAMPLE_RADIUS]
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for k, (radius, links) in enumerate(seen):
        near = {(max(a, b), min(a, b)) for c in (range(1) if k == 0 else range(1, fps.shape[1])) for a in fps[:, c].tolist() for b in fps[:, c].tolist() if 0 < apart(a, b) <= radius}
        assert near == links
    assert len(seen[0][1]) > 10


def test_stages_take_odd_rows_and_clashing_columns(spark, folder):
    """Null ids, empty and very long texts, repeated rows, further columns under names that stages use, and no rows at all."""
    rng = random.Random(21)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))
    long = prose(40_000)
    rows = [(None, prose(80)), (None, None), (5007, ""), (5008, long), (5009, long), (5010, "x" * 50_000), (5011, None), (5012, prose(90)), (5012, prose(95))]
    names = ["_score", "score", "kept", "_kept", "text_", "component_id", "_level", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    columns, left, empty = docs.columns, docs, docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left, empty = stage(spark, left, folder), stage(spark, empty, folder)
        assert left.columns == columns == empty.columns and empty.count() == 0
        assert [left.select(n).distinct().collect() for n in names] == [[(k,)] for k in range(len(names))]
        left = spark.createDataFrame(left.collect(), docs.schema)
    kept = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert len(kept) > 100 and not {5009, 5007, 5010, 5011} & set(kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, folder)
    assert {r["doc_id"] for r in pieces.collect()} == set(kept) and corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0


def test_registry():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(found)
