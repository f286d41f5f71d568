import random
import zlib

import numpy as np

from annalist.llm.toxicity import CHANCE, correlations, fit, posterior, score_of, scores, toxicity


def made(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(words, k=r.randint(10, 60))
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "glorpish", "zzbadly", "zzbaded"]))
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic) if r.random() > 0.02 else 1 - int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made(1200, 1)
    rows += [(5000, None), (5001, ""), (5002, "x " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, marked).collect()}
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[5000].score == got[5001].score < 0.5


def test_held_out_labels_have_no_influence(spark):
    rows, labels = made(600, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a == b


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity(docs, none).collect()}
    assert got == {1: 1, 2: 0}
    assert scores(docs.limit(0), fit(docs, none)).count() == 0


def test_label_model_outvotes_wrong_labels():
    r = np.random.default_rng(0)
    y = r.random(3000) < 0.3
    fires = np.column_stack([(r.random(3000) < np.where(y, 0.8, 0.05)) for _ in range(6)])
    given = np.where(r.random(3000) < 0.1, ~y, y).astype(float)
    q = posterior(fires, given)
    assert ((q > 0.5) == y).mean() > (given == y).mean() + 0.05


def plain_posterior(fires, y, rounds, every):
    """The label model by plain loops."""
    import math

    n, rows = len(fires[0]) + 1, [[*map(float, f), float(t)] for f, t in zip(fires, y, strict=True)]
    q, share = [0.05 + 0.9 * t for t in y], [1.0] * n
    for i in range(1, rounds + 1):
        prior = min(max(sum(q) / len(q), 1e-4), 1 - 1e-4)
        yes = [(sum(p * r[j] for p, r in zip(q, rows, strict=True)) + 0.05) / (sum(q) + 1) for j in range(n)]
        no = [(sum((1 - p) * r[j] for p, r in zip(q, rows, strict=True)) + 0.005) / (sum(1 - p for p in q) + 1) for j in range(n)]
        q = []
        for r in rows:
            odds = math.log(prior / (1 - prior)) + sum(share[j] * (math.log(yes[j] / no[j]) if r[j] else math.log((1 - yes[j]) / (1 - no[j]))) for j in range(n))
            q.append(1 / (1 + math.exp(-min(max(odds, -30), 30))))
        if i % every == 0 and i < rounds:
            cov = [[0.0] * n for _ in range(n)]
            for w in (q, [1 - p for p in q]):
                mean = [sum(p * r[j] for p, r in zip(w, rows, strict=True)) / sum(w) for j in range(n)]
                for a in range(n):
                    for b in range(n):
                        cov[a][b] += sum(p * (r[a] - mean[a]) * (r[b] - mean[b]) for p, r in zip(w, rows, strict=True))
            share = [1 / (1 + sum(c for b in range(n) if a != b and (c := cov[a][b] / math.sqrt(cov[a][a] * cov[b][b])) >= CHANCE)) for a in range(n)]
    return q


def test_label_model_equals_plain_loops():
    r = random.Random(8)
    y = [r.random() < 0.3 for _ in range(90)]
    first = [r.random() < (0.7 if t else 0.1) for t in y]
    fires = [[f, f if r.random() < 0.9 else not f, r.random() < (0.6 if t else 0.05), r.random() < 0.3] for f, t in zip(first, y, strict=True)]
    got = posterior(np.array(fires), np.array(y, dtype=float), 12, 4)
    assert np.allclose(got, plain_posterior(fires, y, 12, 4), atol=1e-9)
    r = correlations(np.array(fires, dtype=float), got)
    assert r[0, 1] > 0.5 > r[0, 3] and np.allclose(np.diag(r), 0)


def test_scores_of_odd_rows_equal_plain_ones(spark):
    rows, labels = made(500, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = [(None, "you idiot idiot"), (None, None), (4, "IDIOT!!!"), (4, "IDIOT!!!"), (4, "fine"), (5, "a vermin nobody has labelled"), (6, "glorpish " * 30_000)]
    frame = spark.createDataFrame([(*x, 0.5, "p") for x in odd], "doc_id long, text string, score double, predicted string")
    got = sorted((r.doc_id or 0, round(r.score, 12), r.predicted, r.n_votes) for r in scores(frame, model).collect())
    want = []
    for i, t in odd:
        s, n = score_of(t or "", model)
        want.append((i or 0, round(s, 12), int(s >= 0.5), n))
    assert got == sorted(want)
    by_text = {t: score_of(t or "", model)[0] for _, t in odd}
    assert by_text["a vermin nobody has labelled"] > by_text["fine"]  # by the list as a whole


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_quality import CLEAN, TEXTS

    item = "Which of the seven bridges over the wide river was first to be crossed by a train of coal wagons?"
    unique = ["\n".join(" ".join(f"{w}{d}x{i}q{k}" for k, w in enumerate("abcdefghijkl")) + "." for i in range(8)) for d in "mnopq"]
    texts = [*TEXTS, unique[0], unique[0], unique[1], unique[1] + " tail", unique[2] + "\n" + item, unique[3], unique[4] + "\nHome | News | About | Us"]
    docs = [(i, t, "en", "s", len(t) if t else None, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    n = len(TEXTS)
    assert CLEAN is not None and got >= {n, n + 2, n + 5, n + 6} and not got & {n + 1, n + 3, n + 4, 0, 1, 2, 3, 5, 6, 9, 10}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns, name
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, lines int, _made string, row long, cuts string"
    unique = [" ".join(f"{w}{'xyz'[i]}{k}" for k, w in enumerate("abcdefghijklmnopqrstuvwxyz" * 3)) + "." for i in range(3)]
    rows = [(None, unique[0]), (1, unique[1]), (1, unique[2]), (None, None), (2, "")]
    for name, data in (("odd", rows), ("none", [])):
        spark.createDataFrame([(*x, "en", 1, "m", 2, "c") for x in data], schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, "an item that nobody has")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = sorted((r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect())
        assert got == ([0, 1, 1] if data else [])
