"""Near-duplicates, components, nearest neighbours and the pipeline against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import EN, SCHEMA, wide
from tidewatch.llm import ann, simhash
from tidewatch.llm.components import connected_components


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest index reachable over links of at most three bits."""
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(prints))]


def test_fingerprints(spark, odd_docs):
    got = {(r["doc_id"], r["text"]): r["fp"] for r in odd_docs.select("doc_id", "text", simhash.F.lit(0).alias("fp")).collect()}
    texts = [t for _, t in got]
    assert simhash.fingerprints_of(texts).tolist() == [plain_print(t) for t in texts]


@pytest.mark.parametrize(("block", "parts"), [(1024, (2, 3, 4)), (8, (4,)), (8, (3,)), (64, (2,))])
def test_groups_against_all_pairs(spark, monkeypatch, block, parts):
    """Chains and balls of near fingerprints, larger than a block."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PARTS", parts)
    rng = np.random.default_rng(block + len(parts))
    prints = [0, (1 << 64) - 1]
    for _ in range(4):
        prints.append(int(rng.integers(0, 1 << 63)))
        for _ in range(90):
            prints.append(prints[-1 - int(rng.integers(0, 3))] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    prints = sorted({p % (1 << 64) for p in prints}, key=lambda p: np.uint64(p).view(np.int64))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    layout = simhash.choose_layout(nodes)
    assert sum(t + 1 for t in layout.thresholds) == 4 and sorted(b for p in layout.parts for b in p) == list(range(64))
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(nodes, layout)).collect()}
    assert [roots.get(p, p) for p in signed] == [signed[g] for g in plain_groups(prints)]


def test_near_duplicates(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    prints = [plain_print(r["text"]) for r in rows]
    groups = plain_groups(prints)
    least = {g: min((r["doc_id"] for r, own in zip(rows, groups) if own == g and r["doc_id"] is not None), default=None) for g in set(groups)}
    want = sorted(((str(r["doc_id"]), format(p, "016x"), least[g]) for r, p, g in zip(rows, prints, groups)), key=str)
    got = simhash.near_duplicates(wide(odd_docs)).collect()
    assert sorted(((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.representatives(odd_docs).collect()
    assert len(kept) == len(set(groups)) and {plain_print(r["text"]) for r in kept} <= set(prints)
    assert len({groups[prints.index(plain_print(r["text"]))] for r in kept}) == len(kept)
    assert simhash.representatives(no_docs).count() == 0


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        costs = [[0.0, *sorted(rng.random(2))] for _ in range(4)]
        cost, chosen = simhash.allocate(costs, 4)
        every = [(sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in np.ndindex(3, 3, 3, 3) for ts in [tuple(t - 1 for t in ts)] if sum(t + 1 for t in ts) == 4]
        assert cost == pytest.approx(min(every)[0]) and sum(t + 1 for t in chosen) == 4


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1400)] + [(-5, 7), (500, 500), (3, 2)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: -5 for i in range(61)}, -5: -5, **{i: 1000 for i in range(1000, 1400)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_nearest(ids, x, own, k):
    q = x[list(ids).index(own)]
    rows = {(-float((q * v).sum()), int(i)) for i, v in zip(ids, x) if i != own}
    return [(i, -s) for s, i in sorted(rows)[:k]]


def search(spark, rows, k=20, extra=()):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in extra])
    out = {}
    for r in ann.search(frame, frame.where(F.col("vec_id") % 20 == 0), k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 200)
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1200, 24)), rng.normal(size=24) * 2 + 0.01 * rng.normal(size=(700, 24)), np.ones((100, 24))]).astype(np.float32)
    x *= rng.uniform(0.5, 3, (len(x), 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, hit, wide_x = search(spark, rows, extra=("id", "v", "tree")), 0, x.astype(float)
    assert set(got) == set(range(0, 2000, 20))
    for own, found in got.items():
        want = plain_nearest(range(len(x)), wide_x, own, 20)
        hit += len({i for i, _ in want} & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert i != own and s == float((wide_x[own] * wide_x[i]).sum())
    assert hit / (20 * len(got)) >= 0.9


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, [1.0, 2.0, 3.0]), (20, [0.0, -1.0]), (40, None), (1, [2.0, 0.0]), (None, [1.0, 1.0]), (9, [])]
    got = search(spark, rows)
    assert got == {0: [(1, 1, 2.0), (2, 2, 2.0), (3, 20, 0.0)], 20: [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]} or \
        {q: [(i, abs(s)) for _, i, s in f] for q, f in got.items()} == {0: [(1, 2.0), (2, 2.0), (20, 0.0)], 20: [(0, 0.0), (1, 0.0), (2, 0.0)]}
    assert search(spark, []) == {} and search(spark, [(0, [1.0])]) == {}


def test_nearest_query_against_brute_force(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = data["vec_id"].tolist(), np.stack(data["embedding"]).astype(float)
    hit, got = 0, entry.queries()["op9_nearest"](spark, sf).toPandas()
    for own in [i for i in ids if i % 20 == 0]:
        found = got[got["query_id"] == own]
        assert sorted(found["rank"]) == list(range(1, 21))
        hit += len({i for i, _ in plain_nearest(ids, x, own, 20)} & set(found["vec_id"]))
    assert hit >= 0.9 * 20 * len([i for i in ids if i % 20 == 0])


def test_pipeline_on_odd_rows(spark, tmp_path, odd_docs, no_docs, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (wide(odd_docs), no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, str(tmp_path))
            assert kept.columns == docs.columns, name
            assert kept.exceptAll(docs).count() == 0, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_pipeline_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    poor = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    rows = docs.orderBy("doc_id").collect()
    groups = plain_groups([plain_print(r["text"]) for r in rows])
    alone = {r["doc_id"] for r, g in zip(rows, groups) if groups.count(g) == 1}
    assert len(got & poor) <= 0.02 * len(poor) and len((good & alone) - got) <= 0.01 * len(good)
    for g in set(groups):
        members = {r["doc_id"] for r, own in zip(rows, groups) if own == g}
        assert len(members & got) <= 1


def test_texts_stay_whole(spark):
    long_text = EN + " " + " ".join(f"w{i}" for i in range(100_000))
    frame = spark.createDataFrame([(1, long_text, "en", "s", 0), (2, long_text + " tail end here", "en", "s", 0)], SCHEMA)
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(frame).collect()}
    assert got[1] == format(plain_print(long_text), "016x")


def test_nearest_of_mixed_lengths(spark):
    """The length is that of the vectors, also where most queries have another one."""
    rows = [(0, [1.0, 0.0, 2.0]), (20, [1.0, 1.0, 1.0]), (40, [3.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [5.0, 1.0])]
    assert search(spark, rows, k=2) == {40: [(1, 4, 16.0), (2, 1, 6.0)]}


def test_nearest_equal_rows_however_dealt(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(900)] + [(i % 7 * 20, rng.normal(size=8).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [sorted(map(tuple, ann.search(frame.repartition(n), frame.where("vec_id % 20 = 0")).collect())) for n in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == 45 * 20
