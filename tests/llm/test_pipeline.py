"""The pipeline's stages, each held against brute force on its own input."""

import corpus_pipeline as P
from chunklake.llm import mixing, quality_rules
from chunklake.llm.common import keep, read
from tests.conftest import SF
from tests.llm.test_operators import docs_of, near_brute, split, substring_brute


def test_stages(spark):
    import hashlib

    from tokenizers import Tokenizer

    from chunklake.llm import quality_rules, registry

    docs = read(spark, SF, "documents")
    columns = docs.columns
    outs = [docs]
    for _, stage in P.STAGES:
        outs.append(keep(stage(spark, outs[-1], SF), "stage"))
    raw, good, single, cut, mixed, ids = outs
    assert [o.columns for o in outs[1:-1]] == [columns] * 4

    want = sorted(r["doc_id"] for r in quality_rules.judge(raw).where("kept").collect())
    assert sorted(i for i, _ in docs_of(good)) == want and 0 < len(want) < raw.count()

    least = dict(near_brute(docs_of(good), 5, 80))
    assert sorted(i for i, _ in docs_of(single)) == sorted(i for i, _ in docs_of(good) if least[str(i)] == i)

    brute = {r[0]: r for r in substring_brute(docs_of(single), 50)}
    assert {str(i): hashlib.sha256(" ".join(split(t)).encode()).hexdigest() for i, t in docs_of(cut)} == {i: r[3] for i, r in brute.items()}
    before = dict(docs_of(single))
    assert all(t == before[i] for i, t in docs_of(cut) if brute[str(i)][2] == 0)

    kept = {i for i, _ in docs_of(mixed)}
    labels = {r["doc_id"]: r for r in read(spark, SF, "labels").collect()}
    clean = [i for i, _ in docs_of(cut) if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0]
    assert clean and kept >= set(clean)
    assert set(docs_of(mixed)) <= set(docs_of(cut))

    library = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in docs_of(mixed))
    assert sorted((r["doc_id"], r["ids"]) for r in ids.collect()) == want
    assert ids.count() == P.run(spark, SF).count()


def test_every_clean_document_stays(spark):
    """Labels hold against a posterior that says otherwise, and without a label only a clear posterior drops a document."""
    good, bad = " ".join(f"fine{i}" for i in range(30)), " ".join(f"vile{i}" for i in range(30))
    half = " ".join(f"vile{i}" for i in range(2)) + " plain"
    texts = [f"{good} g{i}" for i in range(80)] + [f"{bad} b{i}" for i in range(80)] + [f"{bad} quoted", f"{bad} unlabelled", f"{good} unlabelled", half]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(80 <= i < 160)) for i in range(161)], "doc_id long, quality int, toxic int")
    kept = {i for i, _ in docs_of(mixing.resample(docs, labels, P.WEIGHTS, P.GROWTH, spared="good"))}
    assert kept >= {*range(80), 160, 162} and 161 not in kept and len(kept & set(range(80, 160))) < 80


def test_every_clean_document_of_a_larger_table_stays(spark):
    sf = "/root/testdata/sf0.01"
    docs = keep(P.quality(spark, read(spark, sf, "documents"), sf), "stage")
    labels = {r["doc_id"]: r for r in read(spark, sf, "labels").collect()}
    clean = {i for i, _ in docs_of(docs) if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0}
    assert clean and clean <= {i for i, _ in docs_of(P.mix(spark, docs, sf))}


def test_odd_tables(spark, odd, none, tmp_path):
    """Null, empty, repeated and very long rows, clashing names, no labels: every stage keeps the columns and gives what its docstring says."""
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (9, None, None), (10, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs, own in (("odd", odd, labels), ("none", none, labels), ("unlabelled", odd, labels.where("false"))):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        own.write.parquet(f"{sf}/labels.parquet")
        rows = read(spark, sf, "documents")
        for k, (_, stage) in enumerate(P.STAGES[:-1]):
            after = keep(stage(spark, rows, sf), "stage")
            assert after.columns == rows.columns
            if k == 0:
                assert sorted(str(r["doc_id"]) for r in after.collect()) == sorted(str(r["doc_id"]) for r in quality_rules.judge(rows).where("kept").collect())
            if k == 1:
                assert len({(r["doc_id"], r["text"]) for r in after.where("doc_id is not null").collect()}) == after.where("doc_id is not null").count()
            if k == 3 and name == "unlabelled":
                assert after.count() >= rows.count()
            rows = after
        assert P.run(spark, sf).count() == rows.count()
        assert P.run(spark, sf).columns == ["doc_id", "ids", "n_tokens"]


def test_scratch_leaves_nothing_behind(spark):
    import os

    from chunklake.llm import common

    folder = common.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    P.run(spark, SF).count()
    left = set(os.listdir(folder)) - before
    assert {n.rsplit("-", 1)[0] for n in left} == {"pipeline-3"}
