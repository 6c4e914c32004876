import itertools
import random
import zlib

import numpy as np
import pytest

from tabloom.llm import quality

WORDS = "the of and river mountain slowly carried stones along its bed until winter came".split()


def good(rng):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 20))).capitalize() + "." for _ in range(rng.randint(1, 9)))


def bad(rng):
    return good(rng).upper().replace(" ", "!! ")


def tables(spark, n=400):
    rng = random.Random(1)
    rows = [(i, (good if i % 3 else bad)(rng), "l", "s") for i in range(n)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(n) if i % 5]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=5), rng.normal(size=(2, 2)))
    doc = np.repeat([0, 1, 2, 3], [1, 2, 6, 3])
    x = rng.normal(size=(len(doc), 5))
    p, pair = quality.marginals(model, x, doc)
    for d in range(4):
        at = np.flatnonzero(doc == d)
        weight = {}
        for y in itertools.product((0, 1), repeat=len(at)):
            e = sum(float(x[i] @ model.weights) * v for i, v in zip(at, y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:]))
            weight[y] = np.exp(e)
        z = sum(weight.values())
        for k, i in enumerate(at):
            assert p[i] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / z)
            for a, b in itertools.product((0, 1), repeat=2):
                want = sum(w for y, w in weight.items() if k and (y[k - 1], y[k]) == (a, b)) / z
                assert pair[i, a, b] == pytest.approx(want)


def test_line_features_do_not_depend_on_neighbouring_texts():
    texts = [b"One two two.\n\nTHREE!!", b"", b"\n", "é | 7\n".encode(), b"x" * 5000]
    x, size, doc = quality.line_features(texts)
    assert list(np.bincount(doc)) == [3, 1, 2, 2, 1] and list(size) == [12, 0, 7, 0, 0, 0, 6, 0, 5000]
    for i, t in enumerate(texts):
        assert np.allclose(quality.line_features([t])[0], x[doc == i])


def test_chunks_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))
    texts = [good(random.Random(i)).encode() for i in range(40)] + [b"", b"a\n" * 3000]
    whole = quality.text_scores(model, texts)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 300)
    assert np.allclose(quality.text_scores(model, texts), whole, atol=1e-12)
    assert whole[-1] == pytest.approx(quality.text_scores(model, [texts[-1]])[0])


def test_held_out_accuracy_and_columns(spark):
    docs, labels = tables(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.lang == "l" for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97


def test_held_out_labels_and_other_columns_are_never_used(spark):
    docs, labels = tables(spark, 120)
    score = lambda d, l: sorted((r.doc_id, r.score) for r in quality.classify(d, l).collect())
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 1 - quality, quality) quality", "1 toxic")
    assert score(docs, labels) == score(docs.selectExpr("doc_id", "text", "'x' lang", "'y' source"), flipped)


def test_nulls_empty_repeats_and_empty_tables(spark):
    docs, labels = tables(spark, 60)
    odd = spark.createDataFrame([(None, None, None, None), (1000, None, "", ""), (1001, "", "", ""), (1002, "a", "", ""), (1002, "a", "", "")], docs.schema)
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (2, None, 0), (3, 0, 0), (3, 1, 0)], labels.schema))
    rows = quality.classify(docs.union(odd), labels).collect()
    by = {r.doc_id: r.score for r in rows}
    assert len(rows) == 65 and by[1000] == by[1001] == by[None]
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
