"""The pipeline, stage by stage, against plain versions of its decisions."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import decontaminate, mixing, near_dup, toxicity
from tablewright.llm.common import small_batches, staged, table
from test_near_dup import brute


def words(t):
    return (t or "").encode().lower().split()


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    seen = [docs]
    for _, f in corpus_pipeline.STAGES:
        seen.append(staged(f(spark, seen[-1], sf), "test"))
    rows = [[tuple(r) for r in d.collect()] for d in seen]
    for d in seen[:-1]:
        assert d.columns == docs.columns
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    scores = model.scores([r[1] for r in rows[0]])
    assert sorted(rows[1]) == sorted(r for r, s in zip(rows[0], scores) if s < 0.5)
    kept = {d for d, _, c in brute([(r[0], r[1]) for r in rows[1]], 5, 80) if d == c}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r[0] in kept)
    items = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (words(r["text"]) for r in table(spark, sf, "benchmark").collect())]
    holds = lambda t: any(len(s & {tuple(w[i:i + 5]) for i in range(len(w) - 4)}) >= 0.8 * len(s) for w in [words(t)] for s in items)
    assert sorted(rows[3]) == sorted(r for r in rows[2] if not holds(r[1])) and len(rows[3]) < len(rows[2])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3]).collect()}
    assert Counter(r[0] for r in rows[4]) == Counter({k: v for k, v in copies.items() if v})
    assert sorted(r[0] for r in rows[5]) == sorted(r[0] for r in rows[4])
    last = seen[5].orderBy("start").collect()
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(last, last[1:])) and last[0]["start"] == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(rows[5])


def test_stages_on_odd_rows(spark, docs_of, edge, sf):
    docs = docs_of([*edge, *[(100 + i, "some words that are all " + f"other{i} " * (9 + i), None) for i in range(20)], (100, "some words that are all " + "other0 " * 9, None)])
    one = near_dup.unique(docs)
    got = Counter(r["doc_id"] for r in one.collect())
    assert got[4] == 1 and got[100] == 1 and got[5] + got[6] == 1 and got[1] == got[2] == got[3] == got[None] == 1
    assert one.columns == docs.columns
    m = mixing.mixed(docs)
    assert m.columns == docs.columns
    want = mixing.mix(docs).groupBy("doc_id").sum("copies").collect()
    assert Counter(r["doc_id"] for r in m.collect()) == Counter({r[0]: r[1] for r in want if r[1]})
    for _, f in corpus_pipeline.STAGES[1:]:
        assert f(spark, docs.limit(0), sf).count() == 0
    assert toxicity.clean(docs.limit(0), toxicity.learn(["a b"], ["c d"])).count() == 0
    assert np.isfinite(toxicity.learn([], []).scores(["x"])).all()


def test_filters_judge_rows_not_ids(spark, docs_of):
    """Null and repeated ids: a dropped text takes no other text of its id with it, and no two classes become one."""
    a, b, c, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abce")
    rows = [(1, a), (None, a + " more"), (None, b), (None, c), (None, " "), (None, None), (2, a), (2, e), (2, e.upper()), (2, ""), (2, "\t")]
    left = Counter((r["doc_id"], r["text"]) for r in near_dup.unique(docs_of(rows)).collect())
    one = left.pop((2, e), 0) + left.pop((2, e.upper()), 0)
    assert one == 1 and left == Counter([(1, a), (None, b), (None, c), (None, " "), (None, None), (2, ""), (2, "\t")])
    assert Counter(r["text"] for r in near_dup.unique(docs_of([(None, b), (None, b), (3, c), (3, c), (3, a)])).collect()) == Counter([b, c, a])
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    left = Counter((r["doc_id"], r["text"]) for r in decontaminate.clean(docs_of(rows), items).collect())
    assert left == Counter(r for r in rows if not (r[1] or "").startswith(a))
    model = toxicity.learn([a + " " + b] * 30, [c + " " + e] * 60)
    rows = [(None, a + " " + b), (None, c + " " + e), (5, a + " " + b), (5, c + " " + e)]
    assert Counter((r["doc_id"], r["text"]) for r in toxicity.clean(docs_of(rows), model).collect()) == Counter(rows[1::2])


def test_texts_are_scored_few_at_a_time(spark, monkeypatch):
    """A partition with 26 MB of text comes to the tasks in small Arrow batches, under both callers."""

    class Fine:
        def scores(self, texts):
            return np.zeros(len(texts))

    def few(batch, column, size):
        assert batch.nbytes < 8 << 20, batch.nbytes
        yield batch

    monkeypatch.setattr(toxicity, "parts", few)
    n = 2 * spark.sparkContext.defaultParallelism
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 1000) AS text").repartition(n, F.lit(0))
    assert toxicity.clean(docs, Fine()).count() == 3000
    assert len(toxicity.score(docs, Fine()).collect()) == 3000


def test_clean_judges_texts(spark, docs_of):
    """Of equal texts all rows go or stay, null and empty texts alike; all columns stay as they are."""

    class Bad:
        def scores(self, texts):
            return np.array([0.5 if (t or "") in ("", "bad") else 0.4 for t in texts])

    docs = docs_of([(1, "bad"), (1, "bad"), (1, "good"), (None, "bad"), (None, "good"), (2, None), (3, ""), (4, " "), (4, " ")])
    left = toxicity.clean(docs, Bad())
    assert left.schema == docs.schema
    assert sorted(map(repr, left.collect())) == sorted(repr(r) for r in docs.collect() if r["text"] in ("good", " "))


def test_python_tasks_get_small_batches(spark):
    """Texts and sets travel to Python tasks in Arrow batches of about 1 MB, so an executor's native memory holds little of them."""
    with small_batches(spark):
        docs = spark.range(1000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 1000) AS text").repartition(1)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) > 4 << 20 and max(r["n"] for r in sizes) < 2 << 20
