"""Held-out accuracy on planted classes, and the edges of the three classifiers."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seqengine.llm import toxicity
from seqengine.llm.langid import identify_languages, language_report, train_languages
from seqengine.llm.linear import dual_coordinate_descent, logistic_of_margins
from seqengine.llm.quality import drop_low_quality, score_quality, train_quality
from seqengine.llm.toxicity import LabelModel, score_toxicity, train_toxicity

from .conftest import invented


def test_dual_coordinate_descent_separates():
    rows = [np.array([i % 5, 5 + i % 3, 8 + (i % 2)]) for i in range(60)]
    y = np.array([1 if i % 2 else -1 for i in range(60)])
    w, b = dual_coordinate_descent(rows, y, np.ones(10), 1.0, 20)
    assert all(np.sign(w[r].sum() + b) == s for r, s in zip(rows, y, strict=True))
    a, _ = logistic_of_margins(np.array([-2.0, -1, 1, 2]), np.array([-1, -1, 1, 1]))
    assert a > 0


def labelled(docs_of, spark, rng, n=400):
    rows, labels = [], []
    for i in range(n):
        text, quality, toxic = invented(rng, rng.randint(20, 80)), 1, 0
        if i % 6 == 0:
            quality, text = 0, " ".join(w + "***" for w in text.split()) if i % 12 else " ".join([text.split()[0]] * 40)
        if i % 5 == 1:
            toxic, w = 1, text.split()
            w.insert(rng.randrange(len(w)), rng.choice(["zzgrub", "zzgrubel", "kwobby", "moron"]))
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, quality, toxic))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_quality(docs_of, spark, rng, empty):
    docs, labels, truth = labelled(docs_of, spark, rng)
    model = train_quality(docs, labels)
    found = score_quality(docs.withColumn("score", F.lit("x")), model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)
    edge = score_quality(docs_of([(None, None), (1, ""), (2, "word " * 50_000)]), model).collect()
    assert all(0 <= r.score <= 1 for r in edge) and edge[0].held_out is False
    left = drop_low_quality(docs, model)
    assert left.columns == docs.columns and 300 < left.count() < 400
    assert score_quality(empty, model).isEmpty()
    nothing = train_quality(docs, labels.limit(0))
    assert {r.score for r in score_quality(docs.limit(3), nothing).collect()} == {0.5}


def test_toxicity(docs_of, spark, rng, empty):
    docs, labels, truth = labelled(docs_of, spark, rng)
    model = train_toxicity(docs, labels)
    found = score_toxicity(docs, model).collect()
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.95 * len(held)
    new = score_toxicity(docs_of([(1, "a zzgrubish thing"), (2, "a nice thing"), (3, None), (4, "")]), model).collect()
    assert [r.predicted for r in sorted(new, key=lambda r: r.doc_id)] == [1, 0, 0, 0]
    by_lexicon = train_toxicity(docs, labels.limit(0))
    assert [r.predicted for r in score_toxicity(docs_of([(1, "what a moron"), (2, "what a day")]), by_lexicon).orderBy("doc_id").collect()] == [1, 0]
    assert score_toxicity(empty, model).isEmpty()


def planted_votes(n=8000):
    """Two toxic types with their own voters, one of which is copied with noise, and a pattern that fires in clean rows only."""
    rng = np.random.default_rng(1)
    kind = rng.choice(3, n, p=[0.8, 0.13, 0.07])
    fires = lambda rates: rng.uniform(size=n) < np.choose(kind, rates)
    rates = [(0.01, 0.6, 0.01), (0.02, 0.5, 0.02), (0.01, 0.4, 0.01), (0.01, 0.02, 0.7), (0.01, 0.01, 0.5), (0.02, 0.02, 0.4), (0.06, 0.0, 0.0)]
    votes = np.column_stack([fires(r) for r in rates]).astype(float)
    copy = np.where(rng.uniform(size=n) < 0.9, votes[:, 0], rng.uniform(size=n) < 0.1)
    return np.column_stack([votes, copy]), kind, (kind > 0).astype(int), rates


def test_label_model_estimates_accuracies_from_votes():
    """The rates and correlations that were planted are found from the votes; labels of some rows only say which types are toxic."""
    votes, kind, y, rates = planted_votes()
    model = LabelModel(votes, y[:400])
    true_fires, true_misfires = votes[y == 1].mean(axis=0), votes[y == 0].mean(axis=0)
    assert np.abs(model.fires - true_fires).max() < 0.1 and np.abs(model.misfires - true_misfires).max() < 0.03
    assert abs(model.prior - y.mean()) < 0.03 and model.precisions[6] < 0.1 < 0.6 < model.precisions[0]
    sizes = sorted(model.types[1:][model.toxic[1:] > 0.5])
    assert np.allclose(sizes, [(kind == 2).mean(), (kind == 1).mean()], atol=0.03)
    assert {0, 7} in [{j, p} for j, p in enumerate(model.parents) if p >= 0]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.915
    # what labels there are don't move the rates: only shares of types depend on them
    few = LabelModel(votes, y[:40])
    assert np.allclose(few.rates, model.rates) and np.allclose(few.types, model.types)


def test_label_model_without_labels():
    votes, _, y, _ = planted_votes()
    model = LabelModel(np.delete(votes, 6, axis=1), y[:0])
    assert ((model.posterior(np.delete(votes, 6, axis=1)) > 0.5) == y).mean() > 0.915


def test_posterior_like_the_plain_product():
    """The chance of each type is its share times the rates of all votes, each given its parent's vote."""
    votes, _, y, _ = planted_votes()
    model = LabelModel(votes[:400], y[:40])
    for row in votes[:25]:
        chances = []
        for t, share in enumerate(model.types):
            p = share
            for j, vote in enumerate(row):
                above = int(row[model.parents[j]]) if model.parents[j] >= 0 else 0
                rate = min(max(model.rates[j, t, above], 1e-5), 1 - 1e-5)
                p *= rate if vote else 1 - rate
            chances.append(p)
        expected = sum(c * share for c, share in zip(chances, model.toxic, strict=True)) / sum(chances)
        assert abs(model.posterior(row[None, :])[0] - expected) < 1e-9


def test_repeated_beginnings():
    words = toxicity.words_of(b"abcdx abcdy " + b"zz " * 198)
    assert {"abcd-", "abcd-2", "abcd-often", "abcdx", "abcdx-", "zz"} <= toxicity.parts_in(words) and "abcdx-2" not in toxicity.parts_in(words)
    assert "abcd-often" not in toxicity.parts_in(toxicity.words_of(b"abcdx abcdy " + b"zz " * 199))
    model = toxicity.Toxicity({"abcd-2": 3.0, "abcdx": 1.0, "wxyz-often": 5.0}, -2.0)
    scores = [round(float(np.log(s / (1 - s))), 6) for s in map(model.score, (b"", b"abcdx", b"abcdy abcdz", b"abcdx abcdx", b"wxyz1 wxyza"))]
    assert scores == [-2.0, -1.0, 1.0, 2.0, 3.0]


def test_toxicity_edges(docs_of, spark, rng):
    """Repeated ids teach once, clashing columns are ignored, a lexicon without a hit still counts, long texts are read to their end."""
    docs, labels, _ = labelled(docs_of, spark, rng)
    model = train_toxicity(docs.unionByName(docs), labels.unionByName(labels))
    assert {k: round(v, 6) for k, v in model.weights.items()} == {k: round(v, 6) for k, v in train_toxicity(docs, labels).weights.items()}
    edge = docs_of([(1, "calm " * 60_000 + "zzgrub"), (1, "calm " * 60_000), (2, "tu es un connard"), (None, "moron"), (2, "tu es un connard")])
    found = score_toxicity(edge.selectExpr("*", "'x' as score", "'y' as held_out", "0 as predicted"), model).collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in found) == [(0, 1), (1, 0), (1, 1), (2, 1), (2, 1)]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


def test_languages_like_brute_force(docs_of, rng):
    """Nearest centroid by the plain definition, n-gram by n-gram."""
    letters = {"xx": "abcdefg", "yy": "defghi", "zz": "ghijklm"}
    rows = [(i, invented(rng, rng.randint(2, 40), list(letters.values())[i % 3])) for i in range(120)] + [(500, " ".join(["abc"] * 30_000)), (7, "ghi"), (7, "ghi")]
    docs = docs_of(rows).withColumn("lang", F.element_at(F.array(*map(F.lit, letters)), (F.col("doc_id") % 3 + 1).cast("int")))
    model = train_languages(docs.filter("doc_id < 120"), clusters=2)

    def grams(text):
        b = f" {text} ".encode()
        for i in range(len(b)):
            yield b[i] * 64
            if i + 2 <= len(b):
                yield ((b[i] | b[i + 1] << 8) * 2654435761 & 0xFFFFFFFF) >> 18
            if i + 3 <= len(b):
                yield ((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2246822519 & 0xFFFFFFFF) >> 18

    def answer(text):
        counts = Counter(grams(" ".join(text.split())))
        weights = {g: (1 + math.log(n)) * model.idf[g] for g, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * c[g] for g, w in weights.items()) / norm for c in model.centroids]
        return model.langs[int(np.argmax(cosines))], max(cosines)

    found = sorted((r.doc_id, r.lang_pred, r.score) for r in identify_languages(docs.selectExpr("*", "1 as lang_pred", "2 as rejected"), model).collect())
    for (i, lang, score), (j, text) in zip(found, sorted(rows), strict=True):
        assert i == j and lang == answer(text)[0] and abs(score - answer(text)[1]) < 1e-4


def test_languages_of_copies(docs_of):
    """A language that is one row many times still teaches; its copies fill no task."""
    docs = docs_of([(4, "zzz zzzz zz")] * 3000 + [(i, "abc abd") for i in range(5, 50)]).withColumn("lang", F.when(F.col("doc_id") == 4, "zz").otherwise("ab"))
    model = train_languages(docs, sample=10)
    assert set(model.langs) == {"ab", "zz"}


def test_languages(docs_of, spark, rng, empty):
    letters = {"xx": "abcdefg", "yy": "hijklmé", "zz": "nopqrsß"}
    rows = [(i, invented(rng, rng.randint(5, 60), letters[name])) for i in range(300) for name in [list(letters)[i % 3]]]
    docs = docs_of(rows).withColumn("lang", F.element_at(F.array(*map(F.lit, letters)), (F.col("doc_id") % 3 + 1).cast("int")))
    found = language_report(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(r.lang_pred == list(letters)[r.doc_id % 3] and 0 <= r.score <= 1 for r in found)
    model = train_languages(docs)
    edge = identify_languages(docs_of([(1, None), (2, "12 34 !!"), (3, "日本語"), (4, "abc gfe"), (None, "")]), model).collect()
    assert [r.lang_pred for r in edge][:2] == ["und", "und"] and edge[3].lang_pred == "xx" and edge[2].lang_pred in letters and edge[2].rejected
    assert identify_languages(empty, model).isEmpty()
    # letters are letters of any script; digits, fractions and signs are not
    signs = identify_languages(docs_of([(1, "½ ² ① Ⅷ 7"), (2, "½ ᾳ")]), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in signs] == [True, False] and signs[0].score == 0
    assert train_languages(empty) is None and {r.lang_pred for r in identify_languages(docs, None).collect()} == {"und"}
