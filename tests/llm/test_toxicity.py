"""Weak supervision: the label model against planted accuracies, scores against planted toxic texts, and the awkward inputs."""

import random
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, score string, votes int"
BAD = ["zorgle", "blenkish", "idiot"]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(n=600):
    """Clean texts of invented words, a fifth of them with bad words (bare, upper-case or with an ending); some in many near copies."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["er", "tion", "the", "an", "o", "ri"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    copied = [word() for _ in range(60)] + ["zorgle", "zorgles"]
    for i in range(n):
        toxic = i % 5 == 0
        w = [word() for _ in range(r.randint(5, 80))]
        if toxic and i % 10 == 0:
            w = list(copied)
            w[r.randrange(60)] = word()
        elif toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "", "ous", "."]))
        text = " ".join(w)
        docs.append((i, text.upper() + "!!!!" if i % 7 == 0 else text, None, "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    odd = [(9001, None, None, None, None), (9002, "", None, None, None), (9003, " \n ", None, None, None), (9004, "word " * 50_000 + "zorgle idiot", None, None, None), (None, "zorgle and blenkish", None, None, None), docs[0], docs[0]]
    return spark.createDataFrame(docs + odd, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_toxic_texts_are_found(tables):
    from tidewatch.llm.toxicity import toxicity_report

    docs, labels = tables
    out = toxicity_report(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    wrong = [i for i, y in truth.items() if held(i) and by[i].predicted != y]
    assert len(wrong) <= 0.02 * sum(map(held, truth))
    assert [by[i].predicted for i in (9001, 9002, 9003, None)] == [0, 0, 0, 1]
    assert len([r for r in rows if r.doc_id == 0]) == 3


def test_held_out_labels_are_not_read(spark, tables):
    from pyspark.sql import functions as F

    from tidewatch.llm.toxicity import held_out, toxicity_report

    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(key, toxicity_report(docs, labels).collect())) == sorted(map(key, toxicity_report(docs, turned).collect()))


def test_words_of_copies_do_not_become_a_lexicon(tables):
    from tidewatch.llm.toxicity import fit_detector

    docs, labels = tables
    detector, _ = fit_detector(docs, labels)
    assert {"zorg*", "blen*", "idio*"} <= set(detector.lexicon.learned)
    assert len(detector.lexicon.learned) <= 6
    names = [name for name, *_ in detector.voters()]
    assert len(names) == len(set(names)) and any(on == "shouting" or name == "shouting" and on for name, _, on, _ in detector.voters())


def test_without_labels_or_documents(spark, tables):
    from tidewatch.llm.toxicity import toxicity_report

    docs, labels = tables
    assert toxicity_report(docs.limit(0), labels).collect() == []
    rows = toxicity_report(docs, labels.limit(0)).collect()
    assert len(rows) == docs.count() and {r.predicted for r in rows} <= {0, 1}


def test_label_model_recovers_accuracies_and_a_correlated_pair():
    from tidewatch.llm.toxicity import VOTERS, fit_label_model

    r = np.random.default_rng(3)
    n, v = 40_000, len(VOTERS)
    y = r.random(n) < 0.2
    hit, noise = r.uniform(0.5, 0.8, v), r.uniform(0.01, 0.05, v)
    votes = r.random((n, v)) < np.where(y[:, None], hit, noise)
    votes[:, v - 1] = np.where(r.random(n) < 0.9, votes[:, v - 2], votes[:, v - 1])  # copies its neighbour, in both classes
    rows, at = np.unique(votes, axis=0, return_inverse=True)
    labelled = r.random(n) < 0.05
    known = np.stack([np.bincount(at[labelled & (y == bool(c))], minlength=len(rows)) for c in (0, 1)], 1)
    model = fit_label_model(rows, np.bincount(at[~labelled], minlength=len(rows)).astype(float), known.astype(float))
    assert abs(model.prior - 0.2) < 0.01
    assert model.parent[v - 1] == v - 2 or model.parent[v - 2] == v - 1
    assert model.correlation[v - 1, v - 2] > 0.8
    accuracy = np.where(y[:, None], votes, ~votes).mean(0)
    assert np.abs(model.accuracy - accuracy).max() < 0.01
    assert ((model.posterior(rows)[at] >= 0.5) == y).mean() > 0.99
