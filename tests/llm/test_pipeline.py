import re
from collections import Counter

import pytest

import corpus_pipeline
from conftest_llm import rows
from panelwarn.llm import common
from test_packing import check as check_packing
from test_pii import PATTERNS, passes
from test_quality import brute as brute_quality
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.read(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.saved(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "personal_data", "source_mixing", "best_fit_packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in common.read(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    wrong = 0
    for r in stages[0].collect():
        failed = brute_quality(r["text"] or "")[-1]
        assert not (failed and r["doc_id"] in kept)
        if not failed and r["doc_id"] in labels:
            wrong += (r["doc_id"] in kept) != (labels[r["doc_id"]] == 1)
    assert wrong <= 2


def test_near_duplicates(stages):
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in stages[1].collect()}
    top = brute_components(set(prints.values()), 4)
    least = {}
    for d, f in prints.items():
        least[top[f]] = min(d, least.get(top[f], d))
    assert {r["doc_id"] for r in stages[2].collect()} == set(least.values())
    assert stages[2].count() == len(least)


def masked(text):
    spans = [(*m.span(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]
    spans = sorted(spans + [(*m.span(), "secret") for m in re.finditer('(?<=token = ")[0-9a-f]{40}(?=")', text)])
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_personal_data(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    for r in stages[3].collect():
        assert r["text"] == masked(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])


def test_mixing(stages):
    sizes, taken = Counter(), Counter()
    for df, c in ((stages[3], sizes), (stages[4], taken)):
        for r in df.collect():
            c[r["source"]] += len(r["text"].encode().split())
    weights = dict(zip(sorted(sizes), [5, 2, 1] * len(sizes)))
    total = sum(taken.values())
    assert abs(total - 1.5 * sum(sizes.values())) < 64 * len(sizes)  # a block for each source
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)
    open_ = [s for s in sizes if taken[s] < 1.9 * sizes[s]]
    shares = [taken[s] / weights[s] for s in open_]
    assert not shares or max(shares) - min(shares) < 200


def test_packing(stages):
    check_packing(stages[4])


def test_run_gives_the_same(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(got, *columns) == rows(stages[5], *columns)


def test_empty_table(empty_docs, spark):
    docs = empty_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, SF), f"test-{name}")
    assert docs.count() == 0


def test_odd_rows(odd_docs, clashing_docs, spark):
    for start in (odd_docs, clashing_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = common.saved(stage(spark, docs, SF), f"test-{name}")
            if name != "best_fit_packing":
                assert docs.columns == start.columns
        assert docs.count() > 0


def test_stages_leave_each_other_alone(spark):
    """A stage's result can be read after another stage and after a whole run, and two runs give the same rows."""
    docs = common.read(spark, SF, "documents")
    late = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    first = corpus_pipeline.run(spark, SF)
    masked = corpus_pipeline.personal_data(spark, docs, SF)
    second = corpus_pipeline.run(spark, SF)
    assert 0 < late.count() <= docs.count() == masked.count()
    assert rows(first, *first.columns) == rows(second, *second.columns)
