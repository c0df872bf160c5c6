"""The toxicity grammar clause by clause, the lexicon, and held-out accuracy."""

import random
import zlib

import pytest

from chargeaudit.llm import toxicity as t

SCHEMA = "doc_id long, text string, toxic string, held_out string, s0 string"
LEXICON = t.Lexicon({"zorg": 4.0, "blim*": 3.0})


def _matched(text):
    return {i: round(v, 3) for i, v in enumerate(t.pattern_sums(text, LEXICON)) if v}


PLAIN, NEGATED, REPORTED = range(3)


@pytest.mark.parametrize(
    ("text", "kind", "aimed", "mark"),
    [
        ("What a moron.", False, False, PLAIN),
        ("You are a moron.", False, True, PLAIN),
        ("A moron, you see", False, True, PLAIN),
        ("You are not a moron.", False, True, NEGATED),
        ("You are not, moron.", False, True, PLAIN),
        ("Not at all in any way a moron.", False, False, PLAIN),
        ("He said you are a moron.", False, True, REPORTED),
        ('It reads "moron" here.', False, False, REPORTED),
        ('"One. Two moron." Three', False, False, REPORTED),
        ("I will kill you!", True, True, PLAIN),
        ("Nobody shall kill.", True, False, PLAIN),
        ("never kill them", True, True, NEGATED),
        ("She said moron. You idiot", None, None, None),
        ("ein Dummkopf", False, False, PLAIN),
        ("ZORG!", False, False, PLAIN),
        ("the blimmer", False, False, PLAIN),
    ],
)
def test_patterns_of_clauses(text, kind, aimed, mark):
    found = _matched(text)
    if kind is None:
        assert set(found) == {t.pattern(False, True, REPORTED), t.pattern(False, True, PLAIN)}
    else:
        assert set(found) == {t.pattern(kind, aimed, mark)}


def test_weights_and_words_without_a_match():
    assert _matched("zorg. blimmer") == {0: 7.0}
    assert _matched("zorg moron blimmer") == {0: 4.0}
    assert _matched("") == _matched("blim you not said. , \"") == _matched("you are kind") == {}


def test_composition_equals_running_the_machines_in_turn():
    rng = random.Random(4)
    nexts, outs, starts = t.grammar()
    for _ in range(400):
        symbols = [rng.randrange(t.SYMBOLS) for _ in range(rng.randrange(1, 30))]
        states = [0, (False, False), (-1, 0, False)]
        at = starts[0]
        for symbol in symbols:
            out = symbol
            for i, step in enumerate((t._negation, t._reported, t._matcher)):
                states[i], out = step(states[i], out)
            assert outs[at][symbol] == out
            at = nexts[at][symbol]


def _corpus(n, seed):
    rng = random.Random(seed)
    plain = ["the", "house", "stands", "near", "a", "river", "and", "people", "walk", "there", "often", "in", "spring"]
    mean = ["vorkel", "vorkling", "vorkish", "grumtz"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(mean))
        rows.append((i, " ".join(words).replace("people", "people."), int(toxic)))
    return rows


def test_learned_words_and_held_out_accuracy(spark):
    rows = _corpus(900, 8)
    odd = [(5000, None), (5001, ""), (None, "You vorkel!"), (3, rows[3][1]), (5002, "word " * 200_000), (5003, "vorkel. " * 30_000), (5004, "«" * 50 + "moron " * 20_000)]
    docs = spark.createDataFrame([(*r[:2], "own", "own", "own") for r in rows] + [(*r, "own", "own", "own") for r in odd], SCHEMA)
    labels = spark.createDataFrame(
        [(i, x, "own") for i, _, x in rows] + [(0, rows[0][2], "own"), (None, 1, "own"), (1, None, "own")], "doc_id long, toxic int, text string"
    )
    model = t.train(docs, labels)
    assert {"vork*", "grumtz"} <= set(model.lexicon)
    assert not {"the", "house", "river", "people"} & set(model.lexicon)
    ours = t.toxicity(docs, model).collect()
    assert len(ours) == len(rows) + len(odd)
    truth = {i: x for i, _, x in rows}
    held = [r for r in ours if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ours)
    assert sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) >= 0.97 * sum(r.doc_id in truth for r in held)
    score = {r.doc_id: r.score for r in ours}
    assert all(0 <= s <= 1 for s in score.values())
    assert score[5000] == score[5001] == score[5002] < t.THRESHOLD < score[None] and score[5003] > 0.9
    assert t.toxicity(docs.where("false"), model).count() == 0
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr(
        "doc_id", f"if(crc32(cast(cast(doc_id as string) as binary)) % {t.FOLDS} = {t.HELD_OUT}, 1 - toxic, toxic) as toxic"
    )
    again = t.train(docs, flipped)
    assert again.lexicon == model.lexicon and again.weights == pytest.approx(model.weights) and again.bias == pytest.approx(model.bias)


def test_without_labels_the_fixed_weights_score(spark):
    docs = spark.createDataFrame([(1, "You are a moron."), (2, "You are not a moron."), (3, "A fine day.")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.train(docs, empty)
    assert model.lexicon == {} and model.weights == t.FIXED_WEIGHTS
    score = {r.doc_id: r.score for r in t.toxicity(docs, model).collect()}
    assert score[1] > score[2] > score[3]
    only = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert t.train(docs, only).weights == t.FIXED_WEIGHTS


def test_sample_of_labels_is_bounded(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert 1_500 < t.training_labels(labels, 2_000).count() < 2_500
    assert t.training_labels(labels).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20_000))


def test_query_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = t.op13_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
