"""The pipeline, stage by stage against the contracts stated plainly, and what is registered."""

import random
import re

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from hourmark.llm import quality
from hourmark.llm.registered import QUERIES
from tests.llm import brute, cases
from tests.llm.cases import frame, ordered, rows_of

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    docs = [d for d in cases.documents() if len(d[1] or "") < 5000]
    sources = ["a", "b", None]
    docs += [(200 + k, f"{cases.prose(rng, 30)} {ITEMS[0][1]} {cases.prose(rng, 30)}", "en", sources[k % 3], None) for k in range(3)]
    docs += [(210 + k, f"{cases.prose(rng, 40)} write a{k}@mail.example.com or +1 (375) 555-439{k} {cases.prose(rng, 9)}", "en", "b", None) for k in range(4)]
    docs += [(230 + k, " ".join(f"zq{j}%%% ##{j}" for j in range(k, k + 60)), "en", "a", None) for k in range(30)]
    frame(spark, docs, cases.DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in [*range(40), *range(200, 214)]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_do_what_they_say(spark, sf_dir, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "simhash", "benchmark", "personal", "mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if number < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(number)))
        kept.append((docs, out := spark.read.parquet(str(tmp_path / str(number)))))
        docs = out

    (before, after) = kept[0]
    verdicts = quality.judge(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    assert rows_of(after, "doc_id") == rows_of(verdicts, "doc_id")
    assert all(not brute.quality(r.text)[-1] for r in after.collect())
    assert not {i for (i,) in rows_of(after, "doc_id") if i is not None and 230 <= i < 260}

    (before, after) = kept[1]
    rows = before.collect()
    classes = brute.components([(k, brute.fingerprint(r.text)) for k, r in enumerate(rows)])
    least = {}
    for c, r in zip(classes, rows):
        least[c] = min(least.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert rows_of(after, "doc_id") == ordered([(None if none else i,) for none, i in least.values()])

    (before, after) = kept[2]
    clean = [(r.doc_id, r.text) for r in before.collect() if not brute.contamination(r.text, ITEMS)[-1]]
    assert rows_of(after, "doc_id", "text") == ordered(clean) and len(clean) < before.count()

    (before, after) = kept[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert rows_of(after, "doc_id") == rows_of(before, "doc_id")
    for r in after.collect():
        assert not brute.base_spans(r.text) and r.n_chars == len(r.text)
        parts, at = [], 0
        for kind, start, end in brute.base_spans(texts[r.doc_id]):
            parts, at = [*parts, texts[r.doc_id][at:start], f"[{kind.upper()}]"], end
        assert r.text == "".join(parts) + texts[r.doc_id][at:]

    (before, after) = kept[4]
    sizes, texts_left = {}, {r.doc_id: r.text for r in before.collect()}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.BLANK_WORD.findall(r.text))
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in after.collect():
        assert len(brute.BLANK_WORD.findall(r.text)) == r.after - r["first"] > 0 and r.text in texts_left[r.doc_id]
        taken[r.source] += r.after - r["first"]
    assert all(abs(taken[s] - want[s]) <= max(1, 0.02 * want[s]) for s in sizes)

    whole = corpus_pipeline.run(spark, sf_dir)
    assert rows_of(whole, *after.columns) == rows_of(after, *after.columns)


def test_pipeline_over_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries())
