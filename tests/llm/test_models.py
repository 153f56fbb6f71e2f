import itertools
import math

import numpy as np
import pytest
from helpers import ODD, docs_of
from pyspark.sql import functions as F

from kipmart.llm import common, textvec
from kipmart.llm import op2_toxicity as op2
from kipmart.llm import op4_language_id as op4
from kipmart.llm import op9_quality_classifier as op9
from kipmart.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def scored(spark, name, label):
    labels = common.read(spark, SF, "labels").where(F.col(label).isNotNull())
    rows = QUERIES[name](spark, SF).join(labels.select("doc_id", label), "doc_id").toPandas()
    return rows, rows[rows.held_out]


def test_toxicity_on_held_out_documents(spark):
    every, held = scored(spark, "op2_toxicity", "toxic")
    assert len(held) > 500 and every.score.between(0, 1).all()
    assert (held.predicted == held.toxic).mean() > 0.97
    assert (every[every.toxic == 0].predicted == 0).mean() > 0.99
    hit = every[every.predicted == 1].iloc[0]
    text = common.read(spark, SF, "documents").where(F.col("doc_id") == int(hit.doc_id)).first().text.encode()
    spans = [text[a:z].decode() for a, z in zip(hit.starts, hit.ends)]
    assert spans and all(s.strip() == s and s for s in spans)


def test_quality_on_held_out_documents(spark):
    every, held = scored(spark, "op9_quality_classifier", "quality")
    assert len(held) > 500 and every.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.98
    assert (every.predicted == (every.score >= 0.7)).all()


def test_language_on_held_out_documents(spark):
    docs = common.read(spark, SF, "documents").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, SF).join(docs, "doc_id").toPandas()
    assert (rows[rows.held_out].lang_pred == rows[rows.held_out].lang).mean() > 0.99
    assert rows.score.between(0, 1).all()


def test_labels_and_languages_of_held_out_rows_change_nothing(spark):
    docs, labels = common.read(spark, SF, "documents").limit(3000), common.read(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(op9.learn_rows(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (op9.train(docs, x, op9.learn_rows(), bound=300) for x in (labels, turned))
    assert np.array_equal(a.linear, b.linear) and a.bias == b.bias
    other = docs.withColumn("lang", F.when(op4.learn_rows(), F.col("lang")).otherwise(F.lit("xx")))
    a, b = (op4.train(x, op4.learn_rows(), per_language=60) for x in (docs, other))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_marginals_like_enumeration():
    rng = np.random.RandomState(0)
    for sizes in ([3, 1, 5], [0, 4], [7]):
        first = np.concatenate([[0], np.cumsum(sizes)])
        e, move = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
        p, both = op2.marginals(e, first, move)
        for a, z in zip(first, first[1:]):
            total, one, pair = 0.0, np.zeros(z - a), np.zeros((max(z - a - 1, 0), 4))
            for y in itertools.product((0, 1), repeat=z - a):
                w = np.exp(sum(e[a + i] * y[i] for i in range(z - a)) + sum(move[y[i], y[i + 1]] for i in range(z - a - 1)))
                total += w
                one += w * np.array(y)
                for i in range(z - a - 1):
                    pair[i, 2 * y[i] + y[i + 1]] += w
            if z > a:
                assert np.allclose(p[a:z], one / total)
                assert np.allclose(both[a:z - 1], pair / total)


def test_marginals_of_long_chains_agree_with_short_scans():
    rng = np.random.RandomState(1)
    e, first, move = rng.normal(-2, 3, 20_000), np.array([0, 13_000, 20_000]), rng.normal(size=(2, 2))
    p, _ = op2.marginals(e, first, move)
    alpha, m = np.zeros((len(e), 2)), np.exp(move)
    for t in range(len(e)):
        alpha[t] = (alpha[t - 1] @ m if t not in (0, 13_000) else 1.0) * np.array([1, np.exp(e[t])])
        alpha[t] /= alpha[t].sum()
    beta = np.ones((len(e), 2))
    for t in range(len(e) - 2, -1, -1):
        if t + 1 != 13_000:
            beta[t] = m @ (beta[t + 1] * np.array([1, np.exp(e[t + 1])]))
            beta[t] /= beta[t].sum()
    want = alpha * beta
    assert np.allclose(p, (want / want.sum(1, keepdims=True))[:, 1])


def test_interactions_by_the_identity():
    rng = np.random.RandomState(3)
    dim = (1 << op9.BITS) + len(op9.STATISTICS)
    k = len(op9.STATISTICS)
    m = op9.FactorisationMachine(np.zeros(k), np.ones(k), 0.3, rng.normal(size=dim), rng.normal(size=(dim, op9.FACTORS)))
    ids, counts, stats = np.array([5, 9, 700]), np.array([1, 2, 2]), rng.normal(size=(1, k))
    x = np.concatenate([counts / 3.0, stats[0]])
    at = np.concatenate([ids, (1 << op9.BITS) + np.arange(k)])
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert np.isclose(m.margin(1, np.zeros(3, int), ids, counts, stats)[0], 0.3 + m.linear[at] @ x + pairs)


@pytest.mark.parametrize("labels", [[], [(4, 1)], [(i, i % 2) for i in range(4, 10)]])
def test_odd_texts_and_labels(spark, labels):
    docs = docs_of(spark, ODD)
    frame = spark.createDataFrame([(i, v, v) for i, v in labels] + [(7, None, None), (None, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    every = F.lit(True)
    tox = op2.tag(docs, op2.train(docs, frame, every)).collect()
    good = op9.score(docs, op9.train(docs, frame, every)).collect()
    for rows in (tox, good):
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert op9.keep_good(docs, op9.train(docs, frame, every), 0.0).count() == len(ODD)


def test_languages_of_odd_texts(spark):
    docs = docs_of(spark, ODD).withColumn("lang", F.when(F.col("doc_id") < 8, F.lit("fr")).otherwise(F.lit("ja")))
    model = op4.train(docs, F.lit(True))
    rows = op4.predict(docs, model).collect()
    by = {r.id: r for r in rows}
    assert len(rows) == len(ODD) and {by[i].lang_pred for i in (1, 2, 3)} == {"und"} and by[1].score == 0
    assert by[5].lang_pred == "fr" and by[8].lang_pred == "ja"
    none = op4.predict(docs, op4.train(docs.limit(0), F.lit(True))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    kept = op4.keep_known(docs, model, 0.0)
    assert kept.columns == docs.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_words_of_a_block():
    texts = ["Ab c", "", "c ab", "é-E"]
    data = "".join(texts).encode()
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = textvec.words(np.frombuffer(data, np.uint8), offs)
    assert [data[a:z].decode() for a, z in zip(w.start, w.end)] == ["Ab", "c", "c", "ab", "é", "E"]
    assert w.counts.tolist() == [2, 0, 2, 2] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2]


def language_by_hand(model, text):
    """Votes and margins of one text by plain loops."""
    data = text.encode()
    total = [0.0] * len(model.slopes)
    for g in op4._groups(np.frombuffer(data, np.uint8), np.array([0, len(data)])):
        for place in range(len(data)):
            for k in range(len(total)):
                total[k] += float(model.weights[g[place], k])
    p = [1 / (1 + math.exp(-min(max(t / max(len(data), 1) * s, -30), 30))) for t, s in zip(total, model.slopes)]
    nf = len(model.families)
    family = max(range(nf), key=lambda f: (total[f], -f))
    own = [x for x in model.languages if op4.family_of(x) == model.families[family]]
    votes, sure = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
    for (a, b), q in zip(model.pairs, p[nf:]):
        if a in own:
            votes[a if q >= 0.5 else b] += 1
            sure[a] += q / (len(own) - 1)
            sure[b] += (1 - q) / (len(own) - 1)
    if len(own) == 1:
        sure[own[0]] = 1.0
    best = max(own, key=lambda x: (votes[x] + 1e-3 * sure[x], -own.index(x)))
    return best, p[family] / max(sum(p[:nf]), 1e-12) * sure[best]


@pytest.mark.parametrize("tied", [False, True])
def test_language_votes_like_plain_loops(tied):
    rng = np.random.RandomState(5)
    languages = ["de", "en", "es", "fr", "it", "nl", "xx"]
    families = sorted({op4.family_of(x) for x in languages})
    pairs = [(a, b) for a, b in itertools.combinations(languages, 2) if op4.family_of(a) == op4.family_of(b)]
    n = len(families) + len(pairs)
    weights = (np.zeros if tied else lambda s: rng.randn(*s))(((1 << op4.BITS) + 1, n)).astype(np.float32)
    weights[-1] = 0
    model = op4.LanguageModel(languages, families, pairs, weights, rng.rand(n) * 3 + 0.1)
    texts = ["".join(rng.choice(list("abc éñ日 X"), rng.randint(1, 60))) for _ in range(60)] + ["", "a", "ab", "x" * 3000]
    buffer = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    lang, score = model.predict(buffer, offsets)
    for t, i, s in zip(texts, lang, score):
        want, sure = language_by_hand(model, t)
        assert languages[i] == want and abs(s - sure) < 1e-6, t
