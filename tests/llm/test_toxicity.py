import math
import random
import zlib

from filelode.llm import toxicity


def test_pairs_decide_where_single_words_do_not(spark):
    rng = random.Random(3)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(8)]
    rows, labels = [], []
    for i in range(1600):
        kind = i % 4  # neither, insult alone, group alone, both
        words = rng.choices(filler, k=25) + ["insult"] * (kind in (1, 3)) + ["group"] * (kind in (2, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == 3)))
    rows += [(5000, None), (5001, ""), (5002, "insult GROUP " * 20000), (None, "insult group")]
    labels += [(5000, None), (5001, 0), (7, labels[7][1]), (None, 1), (99999, 1)]
    docs = spark.createDataFrame([(i, t, 9, 9.0) for i, t in rows], "doc_id long, text string, y int, score double")
    marks = spark.createDataFrame([(i, y, 1) for i, y in labels], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    truth = dict(labels[:1600])
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by_id[i].held_out for i in held) and sum(r.held_out or False for r in got if r.doc_id in truth) == len(held)
    assert sum(by_id[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert by_id[5000].score == by_id[5001].score and by_id[5002].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.toxicity(docs.limit(0), marks).collect() == []
    assert {r.score <= 0.01 for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {True}


def test_the_same_rows_give_the_same_model(spark):
    docs = spark.createDataFrame([(i, f"ab cd{'xyz'[i % 3] * 3} {'bad' * (i % 2)}") for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    a = sorted(map(tuple, toxicity.toxicity(docs, marks).collect()))
    b = sorted(map(tuple, toxicity.toxicity(docs.repartition(7), marks.repartition(3)).collect()))
    assert a == b


def test_scores_are_the_sum_over_all_pairs(spark):
    """Every score against the model written out: bias, weights of the terms, and the product of each pair of them."""
    rng = random.Random(5)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(6)]
    rows = [(i, " ".join(rng.choices(words, k=30) + ["insult"] * (i % 2) + ["group"] * (i // 2 % 2))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 3)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert len(model.terms)
    place = {int(t): i for i, t in enumerate(model.terms)}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text in rows:
        terms = set()
        for word in toxicity.WORD.findall(text.lower()):
            terms |= {zlib.crc32(x.encode()) % toxicity.BUCKETS for x in [word, *(word[:k] + "^" for k in (5, 6) if len(word) > k)]}
        at = sorted(place[t] for t in terms if t in place)
        logit = model.bias + sum(float(model.weights[a]) for a in at)
        logit += sum(float(sum(x * y for x, y in zip(model.factors[a].astype(float), model.factors[b].astype(float)))) for n, a in enumerate(at) for b in at[:n])
        want = 1 / (1 + math.exp(-min(max(logit, -30.0), 30.0)))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(want >= 0.3)


def test_repeated_rows_and_ties_score_alike(spark):
    rows = [(n % 50, f"same words {'insult' * (n % 2)} again") for n in range(300)] + [(n, "same words  again") for n in range(50, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(n, n % 2) for n in range(50)] * 2, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id % 2 if r.doc_id < 50 else "other", set()).add((r.score, r.predicted))
    assert all(len(scores) == 1 for scores in by_text.values()) and min(by_text[1])[0] > max(by_text[0])[0]
