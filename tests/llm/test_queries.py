"""The registered queries of the subpackage and the pipeline on the smallest tables."""

import pytest

from tests.conftest import SMALL, rows_of
from tidewarden.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = llm.queries()[name](spark, SMALL)
    expected = duck.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, expected.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))


def test_pipeline_keeps_columns_and_decides(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL).cache()
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        counts.append(out.select("doc_id").distinct().count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_with_repeated_null_and_shared_ids(spark, tmp_path):
    import glob
    import random
    from collections import Counter

    import corpus_pipeline as P
    from tidewarden.llm import exchange

    r = random.Random(4)
    words = "the river carried small boats past old houses where people spoke about winter bread music and distant roads under quiet trees".split()
    text = lambda n=90: " ".join(r.choice(words) + r.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))
    a, near, leak = text(), text(), text(12)
    passage = text(40)
    rows = [(1, a), (1, a), (2, a), (None, a), (3, text()), (3, text()), (3, text()), (None, text()), (None, text()), (4, text(20)), (5, None)]
    rows += [(9, near), (8, near + " more"), (None, near + " words"), (6, f"{text(60)} {passage}"), (6, f"{passage} {text(60)}"), (None, f"{text(60)} {leak} {text(60)}"), (None, text()), (7, text())]
    rows += [(10, text())] * 3
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], kinds).repartition(3)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # brute force
    left = [(i, t) for i, t in rows if t and len(t.split()) >= 50]
    grams = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in left]
    classes: list[list[int]] = []
    for k, g in enumerate(grams):
        near_ones = [c for c in classes if any(len(g & grams[m]) >= 0.8 * len(g | grams[m]) for m in c)]
        classes = [c for c in classes if c not in near_ones] + [[k, *(m for c in near_ones for m in c)]]
    left = [min((left[m] for m in c), key=lambda x: (x[0] is None, x[0] or 0)) for c in classes]
    seen = Counter(tuple(t.split()[k : k + 35]) for _, t in left for k in range(len(t.split()) - 34))
    cut = []
    for i, t in left:
        w = t.split()
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        cut.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    expected = sorted(((i, t) for i, t in cut if t and leak not in t), key=str)

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(glob.glob(f"{exchange.ensure_checkpoint_dir(spark)}/pipeline-*".removeprefix("file:")))
    packed = P.run(spark, str(tmp_path)).where("piece = 0").collect()
    (folder,) = set(glob.glob(f"{exchange.ensure_checkpoint_dir(spark)}/pipeline-*".removeprefix("file:"))) - before
    got = spark.read.parquet(f"{folder}/{len(P.STAGES) - 2}").collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == expected
    assert all(x.n_chars == len(x.text) for x in got)
    assert [t for i, t in expected].count(a) == 1 and len(expected) == 12
    assert sorted((x.doc_id for x in packed), key=str) == sorted((i for i, _ in expected), key=str)


def test_pipeline_keeps_columns_of_any_name_and_kind(spark):
    import corpus_pipeline as P

    words = " ".join(f"word{k} and" for k in range(40))
    rows = [(k, f"{words} {' '.join(f'own{k}x{j}' for j in range(40))}", "en", "s", 1, f"kept{k}", {"a": k}) for k in range(5)] + [(9, None, "en", "s", None, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row_key string, more map<string,int>")
    for _, stage in P.STAGES[:3]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and {(r.doc_id, r._row_key, (r.more or {}).get("a")) for r in out.collect()} <= {(k, f"kept{k}", k) for k in range(5)} | {(9, "none", None)}
    assert P.quality(spark, docs, SMALL).count() == 5


def test_near_dedup_of_many_rounds_keeps_plans_small(spark, monkeypatch):
    """Texts that are near to the next one alone take rounds of joins to one class; the driver's estimate of the tables' sizes doesn't grow with the rounds."""
    import corpus_pipeline as P
    from tidewarden.llm import dartminhash, exchange

    digits, settle = [], exchange.settle

    def settled(df, *each):
        out = settle(df, *each)
        digits.append(len(str(out[0]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return out

    for module in (exchange, dartminhash):
        monkeypatch.setattr(module, "settle", settled)
    words = [f"w{k}" for k in range(700)]
    chain = [(k, " ".join(words[8 * k : 8 * k + 200])) for k in range(60)]  # 192 of 200 words are the next one's too
    rows = [(i, t, "en", "s", len(t)) for i, t in [*chain, (90, "another text that is near to none of the others")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, SMALL).collect()) == [0, 90]
    assert len(digits) > 15 and max(digits) < 20
