"""The pipeline's rows against its stages redone by brute force."""

import random

import pytest

pytest.importorskip("chronoweave.llm")

from chronoweave.llm.bpe import default_path  # noqa: E402
from chronoweave.llm.quality import RULES, Page, keeps  # noqa: E402


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(12)
    vocabulary = [a + b for a in "th re on st an ing".split() for b in "e or ea is un ly".split()]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", "too short", "!! " * 90, "| a | b " * 60]
    for _ in range(25):
        base = text(rng.randint(60, 200))
        texts += [base] + [base] * rng.randint(0, 2) + [base + " more words here"] * rng.randint(0, 1)
    secret = ' password = "hunter2222" '
    texts += [text(80) + secret + text(5) for _ in range(3)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if r[1] and keeps(Page(r[1]), RULES)]
    sets = {r[0]: shingle_set(r[1]) for r in kept}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    stay = {r[0]: r for r in kept if label[r[0]] == r[0]}
    clean = {d: r[1].replace('password = "hunter2222', "[SECRET]") for d, r in stay.items()}
    assert [d for d in clean if "[SECRET]" in clean[d]]

    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= set(stay) and max(times.values()) <= 2
    total = sum(len(t.split()) for t in clean.values())
    taken = sum(len(clean[d].split()) * n for d, n in times.items())
    assert abs(taken - 1.5 * total) < 3 * 110  # half a document in each source
    tok = Tokenizer.from_file(default_path())
    for r in got:
        assert r.ids == tok.encode(clean[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(13)
    text = lambda k: " ".join(f"{k}{rng.randint(0, 999)}" for _ in range(60))
    a, b, c, d, e = (text(k) for k in "abcde")
    rows = [(5, a), (5, a), (None, a), (3, b + " end"), (None, b), (None, c), (None, d), (None, d), (7, c.upper() + " x"), (5, e), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    want = [(5, a), (3, b + " end"), (7, c.upper() + " x"), (None, d), (5, e), (8, None), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_mixing_keeps_rows_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [(None if i % 3 else i // 2, f"w{i} " * (1 + i % 7), "en", ["a", "b"][i % 2], 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.mixing(spark, docs, "").collect()
    times = {}
    for r in got:
        times[r.text] = times.get(r.text, 0) + 1
    assert max(times.values()) <= 2 and {r.doc_id for r in got} >= {None}
    total = sum(len(t.split()) for _, t, *_ in rows)
    taken = sum(len(r.text.split()) for r in got)
    assert abs(taken - 1.5 * total) <= 2 * 7


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(80)), "en", "s", 500)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_delete_the_tables_of_results_that_are_gone(spark):
    import os
    import time

    import corpus_pipeline

    rows = [(i, " ".join(f"w{i % 4}x{j}" for j in range(60)), "en", "s", 300) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    folders = {os.path.dirname(f.removeprefix("file://")) for f in found.inputFiles()}
    later = found.where("doc_id >= 0")
    del found
    corpus_pipeline.secrets(spark, docs, "")
    assert folders and all(map(os.path.exists, folders))  # as another DataFrame reads them
    assert sorted(r.doc_id for r in later.collect()) == [0, 1, 2, 3]
    del later
    for _ in range(2):
        corpus_pipeline.secrets(spark, docs, "")
        time.sleep(2)  # Python tells the driver's JVM a second later
    corpus_pipeline.secrets(spark, docs, "")
    assert not any(map(os.path.exists, folders))


def test_stages_keep_the_tables_that_an_rdd_or_iterator_reads(spark):
    import time

    import corpus_pipeline
    from chronoweave.shared import save

    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    rows = save(spark.range(0, 40000, 1, 8)).rdd
    each = save(spark.range(0, 40000, 1, 8)).toLocalIterator()
    next(each)
    for _ in range(2):
        time.sleep(2)  # Python tells the driver's JVM a second later
        corpus_pipeline.secrets(spark, docs, "")
    assert rows.count() == 40000 and sum(1 for _ in each) == 39999
