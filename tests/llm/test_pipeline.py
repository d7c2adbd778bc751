"""The pipeline, stage by stage, against plain Python."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import mixing, pieces, quality
from logloom.llm.common import staged
from test_operators import awkward_rows, brute_components, prose, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]

    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert good.columns == columns
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = quality.score_texts([r[1] for r in rows], model) >= corpus_pipeline.LEAST_QUALITY
    rows = [r for r, k in zip(rows, keep, strict=True) if k]
    assert sorted(map(tuple, good.collect())) == sorted(rows)

    exact = corpus_pipeline.drop_copies(spark, good, SF)
    largest = {}
    for r in rows:
        largest[r[1]] = max(largest.get(r[1], r), r)
    rows = sorted(largest.values())
    assert exact.columns == columns and sorted(map(tuple, exact.collect())) == rows

    near = corpus_pipeline.drop_near_copies(spark, exact, SF)
    roots = brute_components([shingles(r[1]) for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    assert near.columns == columns and sorted(map(tuple, near.collect())) == rows

    mixed = corpus_pipeline.mix_sources(spark, near, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    want = collections.Counter({r: copies[r[0]] for r in rows if copies[r[0]]})
    assert mixed.columns == columns and collections.Counter(map(tuple, mixed.collect())) == want

    done = corpus_pipeline.tokenize(spark, mixed, SF)
    library = pieces.PieceModel.of(pieces.read_model()).library
    assert done.columns == [*columns, "tokens"]
    assert all(r.tokens == library.encode(r.text) for r in done.collect())
    assert done.count() == sum(want.values()) == corpus_pipeline.run(spark, SF).count()


def test_near_copies_with_repeated_and_null_ids(spark):
    def pair(seed):
        text = prose(seed, 120)
        return text, text.replace(text.split()[60], "changed", 1)

    (a, a2), (b, b2), (c, c2), (d, d2), (e, e2) = (pair(i) for i in range(5))
    other, single, copy = prose(10, 60), prose(11, 60), prose(12, 60)
    groups = [[(3, a), (5, a2)], [(3, b), (6, b2)], [(7, c), (7, c2)], [(None, d), (None, d2)], [(9, e), (None, e2)], [(8, copy), (8, copy.upper())]]
    clean = [(5, other), (None, single), (5, " "), (None, ""), (6, "one")]
    rows = [r for g in groups for r in g] + clean
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    got = [(r.doc_id, r.text) for r in near.collect()]
    assert near.columns == docs.columns and len(got) == len(groups) + len(clean) and set(clean) <= set(got)
    assert [sum(r in got for r in g) for g in groups] == [1] * len(groups)
    assert {(3, a), (3, b), (9, e)} <= set(got)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeats, very long texts, and columns with dots and with names that stages use."""
    rows = awkward_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.withColumns({c: F.lit(7) for c in ["a.b", "tokens", "row", "own", "set", "spare", "lost_id", "turn", "key", "hit", "f1", "copies", "digest"]}).repartition(3)


def test_stages_on_odd_tables(spark, odd):
    docs, columns = odd, odd.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        counts.append(docs.count())
        assert docs.columns == columns, name
        assert docs.where("`a.b` != 7 or tokens != 7").count() == 0, name
    assert counts[0] >= counts[1] >= counts[2] > 0
    done = corpus_pipeline.tokenize(spark, docs, SF)
    assert done.columns == [*columns, "_tokens"] and done.count() == docs.count() and done.where("tokens != 7 or _tokens is null").count() == 0
    library = pieces.PieceModel.of(pieces.read_model()).library
    assert all(r._tokens == library.encode(r.text or "") for r in done.where("coalesce(length(text), 0) < 2000").select("text", "_tokens").collect())


def test_exact_and_near_stages_keep_clean_rows(spark, odd):
    exact = corpus_pipeline.drop_copies(spark, odd, SF)
    texts = [r[1] or "" for r in awkward_rows()]
    assert sorted(r.text or "" for r in exact.select("text").collect()) == sorted(set(texts))
    near = corpus_pipeline.drop_near_copies(spark, exact, SF)
    kept = {r.text or "" for r in near.select("text").collect()}
    roots = brute_components([shingles(t) for t in sorted(set(texts))])
    assert len(kept) == len(set(roots)) and {"", "x" * 100_000} <= kept


def test_stages_on_an_empty_table(spark, odd):
    docs = odd.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.count() == 0, name
