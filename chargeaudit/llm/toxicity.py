"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers are composed into one: the lexicon names words as insults, threats, targets,
negations or verbs of speech; the negation transducer marks the words in a negation's scope;
the reported-speech transducer marks what is quoted or told of others; the insult and threat
matcher with its target looks for an insult or a threat and, in the same clause, somebody it
is aimed at. Read a clause, and the machine ends in one matched pattern, such as a threat with
a target that is negated. A text is scored by the patterns of its clauses, never by isolated
words.

Weights are learned. The lexicon's fixed seeds are joined by words and word beginnings that
stand in toxic rows far more often than in others; each weighs its smoothed log odds. The
patterns get their weights from a logistic regression on their sums over a text. Training
rows are the labelled ones outside the held-out fold, and of those a sample of about
``TRAIN_ROWS`` chosen by a hash of the id, so both the lexicon and the regression are bounded.

Defined results: null and empty texts hold no clauses and get the score of a text without a
match; rows of a table with the same id share a label, the largest of those given; rows
without id or label train nothing; without labels of both kinds the seeds and fixed weights
score alone; repeated rows each have their score; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeaudit.llm.common import table, text_or_empty, written

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
TRAIN_ROWS = 30_000

# The seeds of the lexicon, in English, German, French and Spanish.
INSULTS = """
idiot idiots moron morons imbecile stupid dumb scum loser losers trash worthless pathetic disgusting
idioten dummkopf blöd blödmann abschaum arschloch versager
imbécile crétin abruti connard ordure minable
idiota imbécil estúpido estúpida basura escoria
""".split()
THREATS = """
kill hurt beat destroy shoot stab strangle hunt töten umbringen verprügeln schlagen erschießen
tuer frapper détruire massacrer matar golpear destruir
""".split()
TARGETS = """
you your yours yourself he she they him her them his their people everyone ye
du dich dir dein deine ihr euch euer sie er ihnen
tu toi te ton ta vous votre vos il elle ils elles eux
tú usted ustedes vosotros él ella ellos ellas os
""".split()
NEGATIONS = """
not no never neither nor none without isn't aren't don't doesn't didn't won't cannot can't wasn't
nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun nunca jamás sin ningún tampoco
""".split()
REPORTS = """
said says say told tells claimed claims wrote writes reported quoted called alleged
sagte sagt behauptete schrieb erzählte dit disait écrit raconte affirme dijo dice escribió afirmó contó
""".split()

# Symbols that the lexicon transducer writes.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, COMMA, END = range(9)
SYMBOLS = 9
# Marks that the two scope transducers add to a symbol.
NEGATED, REPORTED = 16, 32
SCOPE = 3  # words that a negation reaches
# Patterns: kind (insult, threat), aimed at somebody or not, and plain, negated or reported.
PATTERNS = 12
# The weights of the patterns where labels can't give them, and those of no match.
FIXED_WEIGHTS = [1.6, 0.2, 0.5, 2.0, 0.3, 0.6, 0.8, 0.1, 0.2, 2.4, 0.3, 0.7]
FIXED_BIAS = -3.0

# What is learned: beginnings of these lengths and whole words, with at least so many distinct
# contexts in toxic rows and about ``CHANCES`` features expected whose label has nothing to do with them.
STEMS = (4, 5, 6)
LEAST_LETTERS = 3
LEAST_CONTEXTS = 3
CHANCES = 1.0
LEXICON_ROWS = 4_000
SEED_WEIGHT = 2.0
FEATURE_ROWS = 200_000
WHOLE_ROW = -1

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]|[.!?;:\n…]|,")


# ---------------------------------------------------------------- transducers


class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state and what is written."""

    def __init__(self, start, step):
        self.start = start
        self.step = step

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other machine reads what this one writes."""

        def step(state, symbol):
            mine, theirs = state
            mine, middle = self.step(mine, symbol)
            theirs, out = other.step(theirs, middle)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: range) -> tuple[list[list[int]], list[list[int]]]:
        """Next states and outputs of all states that can be reached, as lists by state and symbol."""
        places = {self.start: 0}
        order = [self.start]
        nexts: list[list[int]] = []
        outs: list[list[int]] = []
        for state in order:
            row, written_ = [], []
            for symbol in symbols:
                after, out = self.step(state, symbol)
                if after not in places:
                    places[after] = len(order)
                    order.append(after)
                row.append(places[after])
                written_.append(out)
            nexts.append(row)
            outs.append(written_)
        return nexts, outs


def _negation(left: int, symbol: int):
    """Insults and threats among the next few words after a negation are marked."""
    if symbol == NEGATION:
        return SCOPE, symbol
    if symbol in (COMMA, END):
        return 0, symbol
    marked = symbol | NEGATED if left and symbol in (INSULT, THREAT) else symbol
    return (left if symbol == QUOTE else max(0, left - 1)), marked


def _reported(state: tuple[bool, bool], symbol: int):
    """Insults and threats in quotation marks, or behind a verb of speech in its clause, are marked."""
    quoted, told = state
    base = symbol & ~NEGATED
    if base == QUOTE:
        return (not quoted, told), symbol
    if base == REPORT:
        return (quoted, True), symbol
    if base == END:
        return (quoted, False), symbol
    return state, symbol | REPORTED if (quoted or told) and base in (INSULT, THREAT) else symbol


def pattern(threat: bool, aimed: bool, mark: int) -> int:
    return 6 * threat + 3 * aimed + mark


def _matcher(state: tuple[int, int, bool], symbol: int):
    """Remembers the clearest insult or threat of a clause and whether it is aimed; writes the pattern at its end.

    Writes -1 elsewhere, and a number of ``PATTERNS`` or -1 at the end of a clause. Plain
    matches win over reported ones, those over negated ones, and threats over insults.
    """
    kind, mark, aimed = state
    base = symbol & 15
    if base == END:
        return (-1, 0, False), (pattern(kind == 1, aimed, mark) if kind >= 0 else -1)
    if base == TARGET:
        return (kind, mark, True), -1
    if base in (INSULT, THREAT):
        # 0 plain, 1 negated, 2 reported; a negation inside of reported speech counts as negated.
        own = 1 if symbol & NEGATED else 2 if symbol & REPORTED else 0
        clear = {0: 2, 2: 1, 1: 0}
        better = kind < 0 or (clear[own], base == THREAT) > (clear[mark], kind == 1)
        return ((int(base == THREAT), own, aimed) if better else state), -1
    return state, -1


@lru_cache(maxsize=1)
def grammar() -> tuple[list[list[int]], list[list[int]], list[int]]:
    """The composed machine behind the lexicon: next states, outputs, and the start in and out of quotes."""
    whole = Transducer(0, _negation).then(Transducer((False, False), _reported)).then(Transducer((-1, 0, False), _matcher))
    nexts, outs = whole.table(range(SYMBOLS))
    return nexts, outs, [0, nexts[0][QUOTE]]


class Lexicon(dict):
    """The lexicon transducer: (symbol, weight) of a token; remembers tokens up to a bound.

    ``learned`` gives weights of lower-case words and, with a star, of word beginnings. A whole
    word wins over a beginning, a longer beginning over a shorter one.
    """

    def __init__(self, learned: dict[str, float], most: int = 500_000):
        super().__init__()
        self.most = most
        self.learned = learned
        self.fixed = {w: (THREAT, SEED_WEIGHT) for w in THREATS}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            self.fixed |= {w: (symbol, 0.0) for w in words}
        self.seeds = set(INSULTS)

    def __missing__(self, token: str) -> tuple[int, float]:
        found = self._found(token)
        if len(self) >= self.most:
            self.clear()
        self[token] = found
        return found

    def _found(self, token: str) -> tuple[int, float]:
        first = token[0]
        if first == ",":
            return COMMA, 0.0
        if not first.isalpha():
            return (QUOTE if first in "\"“”„«»" else END), 0.0
        word = token.lower().replace("’", "'")
        if word in self.fixed:
            return self.fixed[word]
        if word in self.learned:
            return INSULT, self.learned[word]
        if word in self.seeds:
            return INSULT, SEED_WEIGHT
        for length in sorted(STEMS, reverse=True):
            if len(word) > length and (weight := self.learned.get(word[:length] + "*")) is not None:
                return INSULT, weight
        return OTHER, 0.0


def pattern_sums(text: str, lexicon: Lexicon) -> list[float]:
    """For each pattern, the weights of the clauses that match it, summed over a text.

    Only clauses with an insult or a threat can match, so the machine reads those alone. A
    clause weighs as much as its heaviest word. Quotation marks pair up within a line.
    """
    sums = [0.0] * PATTERNS
    tokens = TOKEN.findall(text)
    found = list(map(lexicon.__getitem__, tokens))
    symbols = bytes([s for s, _ in found])
    hits = [i for i, s in enumerate(symbols) if s == INSULT or s == THREAT]
    if not hits:
        return sums
    nexts, outs, starts = grammar()
    quotes = [i for i, s in enumerate(symbols) if s == QUOTE]
    lines = [i for i, t in enumerate(tokens) if t == "\n"] if quotes else []
    end = -1
    for at in hits:
        if at < end:
            continue
        begin = symbols.rfind(END, 0, at) + 1
        end = symbols.find(END, at)
        end = len(symbols) if end < 0 else end
        before = bisect_left(lines, begin)
        line = lines[before - 1] if before else 0
        state = starts[(bisect_left(quotes, begin) - bisect_left(quotes, line)) % 2]
        for symbol in symbols[begin:end]:
            state = nexts[state][symbol]
        sums[outs[state][END]] += max(w for _, w in found[begin:end])
    return sums


# ---------------------------------------------------------------- training


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def training_labels(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic) of about ``rows`` labelled ids outside the held-out fold; bounded by ``rows``."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold() != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = rows / max(rows, known.count())
    spread = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return known.where(spread < share)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, context) of rows (text, toxic): words and beginnings, once for each row and context.

    Contexts, hashes of the two words beside a word, are told apart in toxic rows only; each
    such row has one more with the context ``WHOLE_ROW``.
    """

    def batch() -> pa.RecordBatch:
        columns = [pa.array(features, pa.string()), pa.array(toxic, pa.int32()), pa.array(contexts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "context"])

    features: list[str] = []
    toxic: list[int] = []
    contexts: list[int] = []
    for rows in batches:
        for text, label in zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
            words = [t.lower() for t in TOKEN.findall(text) if t[0].isalpha()]
            own: set[tuple[str, int]] = set()
            for i, word in enumerate(words if label else set(words)):
                if len(word) < LEAST_LETTERS:
                    continue
                context = zlib.crc32(" ".join((words[i - 1] if i else "", *words[i + 1 : i + 2])).encode()) if label else 0
                own.add((word, context))
                own.update((word[:n] + "*", context) for n in STEMS if len(word) > n)
            if label:  # the row itself, beside its contexts
                own.update([(f, WHOLE_ROW) for f in {f for f, _ in own}])
            features += [f for f, _ in own]
            contexts += [c for _, c in own]
            toxic += [label] * len(own)
            if len(features) >= FEATURE_ROWS:
                yield batch()
                features, toxic, contexts = [], [], []
    yield batch()


def learned_lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of the words and beginnings that mark toxic rows among the training ``rows`` (text, toxic).

    Copies of a toxic row repeat contexts, so a word counts once for each context. A feature
    is taken if its counts would hardly come about by chance; the rows are bounded, and so
    is the number of features that reach the driver.
    """
    totals = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    n_toxic, n_other = totals[0], totals[1]
    if not n_toxic or not n_other:
        return {}
    raw = rows.mapInArrow(_features, "feature string, toxic int, context long")
    counted = (
        raw.groupBy("feature", "toxic", "context")
        .agg(F.count("*").alias("rows"))
        .groupBy("feature")
        .agg(
            F.count_if((F.col("toxic") == 1) & (F.col("context") != WHOLE_ROW)).alias("contexts"),
            F.max(F.when((F.col("toxic") == 1) & (F.col("context") == WHOLE_ROW), F.col("rows"))).alias("toxic_rows"),
            F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("rows"))), F.lit(0)).alias("b"),
        )
        .withColumn("a", F.least("contexts", "toxic_rows"))
        .where(F.col("a") >= LEAST_CONTEXTS)
    )
    # The chance of at least a toxic ones among a + b rows, bounded by relative entropy.
    base = n_toxic / (n_toxic + n_other)
    share = F.col("a") / (F.col("a") + F.col("b"))
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = (F.col("a") + F.col("b")) * (share * F.log(share / base) + other)
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / (n_other + 1.0))
    counted = written(counted.select("feature", "a", "b", evidence.alias("evidence"), odds.alias("odds"), share.alias("share")), "toxic-features")
    bar = float(np.log(max(1, counted.count()) / CHANCES))
    marked = counted.where((F.col("share") >= 0.9) & (F.col("evidence") >= bar))
    best = marked.orderBy(F.desc("evidence"), "feature").limit(LEXICON_ROWS).select("feature", "odds").collect()
    return {r.feature: float(r.odds) for r in best}


def with_sums(documents: DataFrame, lexicon: dict[str, float], keep: str) -> DataFrame:
    """Rows (columns of ``keep``, text) with their pattern sums in place of the text."""
    names = [f"s{i}" for i in range(PATTERNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(lexicon)
        for batch in batches:
            sums = np.array([pattern_sums(t, words) for t in batch.column("text").to_pylist()]).reshape(-1, PATTERNS)
            kept = [n for n in batch.schema.names if n != "text"]
            columns = [batch.column(n) for n in kept] + [pa.array(np.log1p(sums[:, i])) for i in range(PATTERNS)]
            yield pa.RecordBatch.from_arrays(columns, kept + names)

    return documents.mapInArrow(run, f"{keep}, " + ", ".join(f"{n} double" for n in names))


def pattern_weights(rows: DataFrame) -> tuple[list[float], float]:
    """Weights of the patterns and of no match, by logistic regression on rows (toxic, s0, s1, ...)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    kinds = {r.toxic for r in rows.select("toxic").distinct().collect()}
    if kinds != {0, 1}:
        return FIXED_WEIGHTS, FIXED_BIAS
    vectors = VectorAssembler(inputCols=[f"s{i}" for i in range(PATTERNS)], outputCol="features").transform(rows)
    model = LogisticRegression(labelCol="toxic", regParam=0.002, standardization=False, maxIter=60).fit(vectors)
    # A pattern speaks for toxicity or not at all.
    return [max(0.0, float(w)) for w in model.coefficients], float(model.intercept)


class Model:
    """Lexicon, pattern weights and bias: all that scoring needs."""

    def __init__(self, lexicon: dict[str, float], weights: list[float], bias: float):
        self.lexicon = lexicon
        self.weights = weights
        self.bias = bias


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled rows of ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    chosen = F.broadcast(training_labels(labels, rows))  # at most about ``rows`` pairs of numbers
    texts = documents.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id").select("text", "toxic")
    texts = written(texts, "toxic-training")
    lexicon = learned_lexicon(texts)
    weights, bias = pattern_weights(written(with_sums(texts, lexicon, "toxic int"), "toxic-sums"))
    return Model(lexicon, weights, bias)


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text)."""
    rows = documents.select(
        "doc_id", F.coalesce(_fold() == HELD_OUT, F.lit(False)).alias("held_out"), text_or_empty().alias("text")
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    summed = with_sums(rows, model.lexicon, f"doc_id {kind}, held_out boolean")
    logit = sum((F.col(f"s{i}") * w for i, w in enumerate(model.weights)), F.lit(model.bias))
    score = 1.0 / (1.0 + F.exp(-logit))
    return summed.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from ``labels``."""
    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, train(documents, table(spark, sf_dir, "labels")))
