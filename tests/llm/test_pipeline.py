"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from docprov.llm import mixing, secrets
from docprov.llm.common import LIVE, table
from tests.llm.cases import ROWS, WORDS, empty, frame, near_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = table(spark, sf, "documents").cache(), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        out.append((docs, after))
        docs = after
    return out


def test_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "secrets", "mixing", "packing"]
    assert all(after.columns == COLUMNS for _, after in steps[:-1])


def test_toxic_documents_go_and_the_rest_stays_as_it_is(steps):
    before, after = ({tuple(r) for r in d.collect()} for d in steps[0])
    assert after <= before and len(after) >= 0.7 * len(before)


def test_one_of_each_group_stays(steps):
    before, after = steps[1]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(near_groups(rows)[1]))


def test_no_secret_is_left(steps):
    before, after = ({r.doc_id: r for r in d.collect()} for d in steps[2])
    assert before.keys() == after.keys()
    for i, r in after.items():
        found = any(secrets.find(before[i].text, k) for k in secrets.RULES)
        assert found == (r.text != before[i].text) and r.n_chars == len(r.text)
        assert not any(secrets.find(r.text, k) for k in secrets.RULES)


def test_sources_come_to_their_targets(steps):
    before, after = (d.collect() for d in steps[3])
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += len(WORDS.findall(r.text))
    for r in after:
        taken[r.source] += len(WORDS.findall(r.text))
    names = sorted(size)
    for name, target in zip(names, mixing.targets([size[n] for n in names]), strict=True):
        assert abs(taken[name] - target) <= 128


def test_every_token_is_packed(steps):
    from docprov.llm.packing import encode

    before, after = (d.collect() for d in steps[4])
    assert Counter(r.doc_id for r in before).keys() == {k for r in after for k in r["keys"]}
    assert sum(r.n_tokens for r in after) == sum(len(encode(r.text)) for r in before)
    assert Counter(i for r in after for i in r.ids) == Counter(i for r in before for i in encode(r.text).tolist())
    assert all(len(r.ids) <= 1024 for r in after)


def test_run(spark, sf, steps):
    before = set(LIVE)
    out = corpus_pipeline.run(spark, sf)
    assert LIVE - before == {out.staged_at}
    assert out.count() == steps[-1][1].count()


def test_odd_rows_and_empty_tables(spark, sf):
    """Nulls in every column, white space, ties, repeated rows, a very long text, clashing column names."""
    docs = frame(spark)
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        rows = after.collect()
        if name != "packing":
            assert after.columns == docs.columns, name
        if name == "toxicity":
            assert len(rows) >= 0.7 * len(ROWS)
        elif name == "near duplicates":
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and {1, 2, 3, 4, 6, 8, 11} <= set(ids) and not {5, 7} & set(ids) and sum(r.doc_id is None for r in rows) == 1
        elif name == "secrets":
            assert {r.doc_id: r.text for r in rows}[1] is None
        elif name == "mixing":
            assert all(WORDS.search(r.text) for r in rows) and {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()}
        else:
            assert sum(len(r["keys"]) for r in rows) >= before.count()
        before = after
    before = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, sf)
        assert before.collect() == [], name
