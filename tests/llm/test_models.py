"""Learned operators by held-out accuracy, and the pipeline stage by stage."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from llm_brute import common_subsequences

import corpus_pipeline
from webweave.llm import quality, toxicity
from webweave.llm.queries import ORACLES, QUERIES


def test_kernel_equals_its_definition():
    words = ["idiot", "id", "idxiot", "iidd", "éclair", "tooidi", "zzz", "aaaa"]
    marks = ["idiot", "aaa", "éclat", "zzzz"]
    found = toxicity.similarities(words, marks)
    for word, row in zip(words, found):
        for mark, value in zip(marks, row):
            k = [common_subsequences(a, b, toxicity.ORDER, toxicity.DECAY) for a, b in ((word, mark), (word, word), (mark, mark))]
            assert value == pytest.approx(k[0] / np.sqrt(k[1] * k[2]) if k[1] else 0, abs=1e-5)


def test_units_undo_disguises():
    assert "idiot" in [toxicity.letters(w) for w in toxicity.units("you I d i o t now")]
    assert [toxicity.letters(w) for w in ("I.D-iot!", "1d10t", "...", "x")] == ["IDiot", "idiot", "", "x"]


@pytest.fixture(scope="module")
def marked(prose):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        words = prose(i, rng.randint(20, 120)).split()
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["muckling", "grobian", "snollgoster"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_held_out(spark, docs_of, marked):
    docs = docs_of([(i, t) for i, t, _ in marked] + [(None, "ok"), (5_000, None), (5_001, ""), (5_002, "gro-bian"), (5_003, "g r o b i a n"), (5_004, "x" * 50_000), (5_004, "x")])
    labels = spark.createDataFrame([(i, int(k), 9) for i, _, k in marked] + [(None, 1, 9), (9_999, 1, 9), (1, None, 9)], "doc_id long, toxic int, text int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(marked) + 7
    by_id = {r.doc_id: r for r in rows}
    truth = {i: k for i, _, k in marked}
    for i, k in truth.items():
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert all((by_id[i].predicted == 1) == k for i, k in truth.items() if by_id[i].held_out)
    assert [by_id[i].predicted for i in (None, 5_000, 5_001, 5_002, 5_003, 5_004)] == [0, 0, 0, 1, 1, 0]
    assert all(0 <= r.score <= 1 for r in rows)
    # labels of held-out rows are not used
    other = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, other).collect()}
    assert all(again[i] == pytest.approx(by_id[i].score) for i in truth)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.0}


@pytest.fixture(scope="module")
def graded(spark, prose):
    """(doc_id, text, lang, source, n_chars), good: site 'bad' holds mostly junk; a third is labelled."""
    rng = random.Random(10)
    rows = []
    for i in range(600):
        site = "bad" if i % 3 == 0 else "good"
        good = rng.random() < (0.2 if site == "bad" else 0.95)
        text = prose(i, rng.randint(30, 90)).capitalize() + "."
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w for w in text.split() for _ in range(5))])
        rows.append((i, text, rng.choice(["en", None]), site, len(text), good))
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_held_out(spark, graded):
    extra = [(700, None, None, None, None), (701, "", "en", "lone", 0), (None, "A good line of text, as they come.", "en", "good", 1)]
    docs = spark.createDataFrame([r[:5] for r in graded] + extra, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[5]), 1) for r in graded if r[0] % 3 == 1 or r[0] % 5 == 0] + [(None, 1, 1), (9_999, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(graded) + 3
    truth = {r[0]: r[5] for r in graded}
    right = [r.kept == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert sum(right) >= 0.98 * len(right)
    rates = {r[3]: next(x.host_rate for x in rows if x.doc_id == r[0]) for r in graded[:3]}
    assert rates["bad"] < 0.4 < 0.8 < rates["good"]
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.evidence for r in quality.quality_scores(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def test_rates_of_sparse_sites_are_drawn_to_their_prior(spark):
    groups = spark.createDataFrame([("a", 1, 0.0, 0.5), ("b", 10_000, 0.0, 0.5)], "g string, n long, mean double, prior double")
    small, large = (r.x for r in groups.select(quality._shrunk(0.01).alias("x")).collect())
    assert 0.45 < small < 0.5 and large < 0.01
    same = spark.createDataFrame([(n, 0.5, 0.5) for n in (10, 20, 30)], "n long, mean double, prior double")
    assert quality._spread(same) == 0.0


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and after and set(after) <= ids
        if name == "exact dedup":
            last = {}
            for i, t in before.items():
                last[t] = max(i, last.get(t, i))
            assert set(after) == set(last.values())
        elif name == "substring dedup":
            assert all(len(t) <= len(before[i]) for i, t in after.items())
        assert name == "substring dedup" or all(before[i] == t for i, t in after.items())
    lengths = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in lengths) <= 4096
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    first = {r.doc_id for r in spark.read.parquet(str(tmp_path / "0")).collect()}
    assert len(good & first) >= 0.98 * len(good & ids)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    from oracle import difference, duck

    ours = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(ours, duck(sf_dir).execute(ORACLES[name]).df()) is None
