"""Spelling variants against comparing all words, one pair after the other."""

import random
import re
import zlib
from collections import Counter

import pytest

from chargeaudit.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, state string"


def _near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def _brute(docs):
    counts = Counter()
    for doc, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _expected(words):
    rows, forms = {}, {}
    for w, n in words.items():
        near = [v for v in words if _near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        rows[w] = [forms[w], None, n, len(near), words[forms[w]] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        rows[w][1] = root
    return rows


def _ours(df):
    return {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in df.collect()}


def _words(seed, n, alphabet, most):
    rng = random.Random(seed)
    found = {}
    for _ in range(n):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most)))
        found[word] = rng.randrange(1, 40)
    return found


def test_acceptor_holds_the_words_and_is_minimal():
    words = sorted(_words(1, 400, "abc", 8))
    acceptor = spelling.Acceptor(words)

    def language(state):
        own = [""] if acceptor.final[state] else []
        return own + [c + rest for c, after in acceptor.arcs[state].items() for rest in language(after)]

    assert sorted(language(acceptor.start)) == words
    languages = [frozenset(language(s)) for s in range(len(acceptor.arcs))]
    assert len(set(languages)) == len(languages)
    empty = spelling.Acceptor([])
    assert empty.arcs == [{}] and empty.final == [False]


def test_state_pairs_equal_comparing_all():
    tails = ["a" * 400, "a" * 401, "a" * 399 + "b", "b" + "a" * 400, "a" * 149, "a" * 150, "a" * 151, "a" * 152]
    for words in (list(_words(2, 300, "abé", 7)), tails, [], ["x"]):
        words = ["pre" + w for w in words]
        found = {frozenset(p) for p in spelling.state_pairs(words, 3)}
        assert found == {frozenset((u, v)) for u in words for v in words if _near(u, v)}


@pytest.mark.parametrize("state_words", [3, 2_000])
def test_variants_equal_brute_force(spark, state_words):
    words = _words(3, 350, "abcé", 7) | {"a" * 9 + c: 3 + i for i, c in enumerate("bcdefg")} | {"aaaaaa": 9, "aaaaa": 4, "aaaab": 9}
    frame = spark.createDataFrame([(w, n, "own") for w, n in words.items()], "word string, n long, other string")
    assert _ours(spelling.variants(frame, state_words)) == _expected(words)


def test_counts_of_texts(spark):
    rng = random.Random(5)
    names = ["Über", "straße", "RECEIVE", "recieve", "ÉCOLE", "naïve", "colour", "color", "x1y"]
    docs = [(i, " ".join(rng.choice(names) for _ in range(60))) for i in range(120)]
    docs += [(None, "colour colour"), (7, None), (8, ""), (9, "colour " * 30_000), (3, "same words here"), (3, "same words here"), (3, "same words here")]
    frame = spark.createDataFrame([(*d, "own", "own", "own") for d in docs], SCHEMA)
    words = _brute(docs)
    assert {r.word: r.n for r in spelling.vocabulary(frame).collect()} == words
    assert _ours(spelling.variants(spelling.vocabulary(frame))) == _expected(words)
    assert spelling.variants(spelling.vocabulary(frame.where("false"))).count() == 0


def test_spelling_of_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert _ours(spelling.op11_spelling_variants(spark, folder)) == _expected(_brute(docs))
