"""Spelling variants by finite-state composition, one partition for each initial state.

The vocabulary is an acceptor; composed with a transducer that makes exactly one edit, and
with the acceptor again, it accepts the pairs of near words. A state of the composition is a
pair of acceptor states with the number of edits so far, and every accepted pair of words
first walks the same prefix on both sides. So the words are dealt by initial state, the one
their prefix leads to. A state with more than ``STATE_WORDS`` words is opened: its edit arcs
are taken here and now, and its words go on one character deeper. Behind an edit arc both
sides must read the same rest of the word, so the arcs of an open state are a join on (state,
rest), whose keys hold a word for each character of the alphabet at most. A closed state is
one group: its task builds the minimised acceptor of the rests of its words, composes it with
the edit transducer and the acceptor, and enumerates the accepted pairs.

Defined results: null and empty texts have no words; a null id is spelled as empty text in
the hash that chooses typing slips; repeated rows count each time; ties between near words
go to the smaller word in code-point order; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeaudit.llm.common import beside, table, text_or_empty, written

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
SLIP_ONE_IN = 97
STATE_WORDS = 2_000
PAIR_ROWS = 100_000
LONG = 150


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) of all texts of (doc_id, text): runs of letters in lower case, some with a slip.

    A run whose hash with the document's id is divisible by ``SLIP_ONE_IN`` loses the character
    that the hash points at.
    """
    lower = F.translate(text_or_empty(), string.ascii_uppercase, string.ascii_lowercase)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = documents.select(name.alias("doc"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP_ONE_IN == 0, slipped).otherwise(F.col("run"))
    return hashed.groupBy(word.alias("word")).agg(F.count("*").alias("n"))


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    return word_counts(documents).where((F.length("word") >= least_length) & (F.col("n") >= least_count))


class Acceptor:
    """Minimised acceptor of sorted distinct words: one state for each set of rests.

    ``arcs[s]`` maps characters to states, ``final[s]`` says whether a word may end in ``s``.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        # The path of the last word: arcs and end marks of states that may still grow.
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        last = ""
        for word in words:
            shared = 0
            while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                shared += 1
            self._fold(path, last, shared)
            path.extend(({}, [False]) for _ in word[shared:])
            path[-1][1][0] = True
            last = word
        self._fold(path, last, 0)
        self.start = self._state(*path[0])

    def _fold(self, path: list, last: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(*path.pop())
            path[-1][0][last[len(path) - 1]] = state

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        key = (final[0], *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final[0])
        return self._known[key]


class OneEdit:
    """Acceptor, one-edit transducer and acceptor, composed while walking.

    A state (p, q, e) pairs two acceptor states with the edits made. Results are kept for each
    state and shared by all paths that lead there, as far as ``most`` entries go.
    """

    def __init__(self, acceptor: Acceptor, most: int = 200_000):
        self.a = acceptor
        self.most = most
        self._rests: dict[tuple[int, int], list[str]] = {}
        self._pairs: dict[int, list[tuple[str, str]]] = {}

    def rests(self, p: int, q: int) -> list[str]:
        """What can be read from both states to an end: all that (p, q, 1) accepts."""
        if (p, q) in self._rests:
            return self._rests[p, q]
        arcs, others = self.a.arcs[p], self.a.arcs[q]
        found = [""] if self.a.final[p] and self.a.final[q] else []
        for c in arcs.keys() & others.keys():
            found += [c + rest for rest in self.rests(arcs[c], others[c])]
        if len(self._rests) >= self.most:
            self._rests.clear()
        self._rests[p, q] = found
        return found

    def edits(self, p: int) -> Iterator[tuple[str, str]]:
        """Pairs whose first characters are edited: arcs from (p, p, 0) to an edited state."""
        arcs = sorted(self.a.arcs[p].items())
        for i, (c, after) in enumerate(arcs):
            for rest in self.rests(after, p):  # c is deleted
                yield c + rest, rest
            for d, other in arcs[i + 1 :]:  # c is replaced
                for rest in self.rests(after, other):
                    yield c + rest, d + rest

    def pairs(self, p: int) -> list[tuple[str, str]]:
        """All that (p, p, 0) accepts, each pair once for every way to make its edit."""
        if p not in self._pairs:
            found = list(self.edits(p))
            for c, after in self.a.arcs[p].items():
                found += [(c + u, c + v) for u, v in self.pairs(after)]
            if len(self._pairs) >= self.most:
                self._pairs.clear()
            self._pairs[p] = found
        return self._pairs[p]

    def walk(self) -> Iterator[tuple[str, str]]:
        """The pairs from the start; below it by way of the arcs, so that they leave in parts."""
        a = self.a
        yield from self.edits(a.start)
        for c, after in sorted(a.arcs[a.start].items()):
            for u, v in self.pairs(after):
                yield c + u, c + v


def one_edit(u: str, v: str) -> bool:
    """Whether two words differ by exactly one edit."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    same = len(commonprefix([u, v]))
    return u[same + (len(u) == len(v)) :] == v[same + 1 :]


def state_pairs(words: list[str], depth: int) -> Iterator[tuple[str, str]]:
    """Near pairs among words that share their first ``depth`` characters, with an edit behind them.

    Rests of more than ``LONG`` characters, whose chains of states would cost the square of
    their length, are compared with the rests of about their length in the same state.
    """
    rests = sorted({w[depth:] for w in words})
    prefix = words[0][:depth] if words else ""
    for u, v in OneEdit(Acceptor([r for r in rests if len(r) <= LONG])).walk():
        yield prefix + u, prefix + v
    by_length: dict[int, list[str]] = {}
    for rest in rests:
        if len(rest) >= LONG:
            by_length.setdefault(len(rest), []).append(rest)
    for length, longer in by_length.items():
        if length > LONG:
            for i, u in enumerate(longer):
                for v in chain(longer[:i], by_length.get(length - 1, [])):
                    if one_edit(u, v):
                        yield prefix + u, prefix + v


def _opened(words: DataFrame, depth: int) -> DataFrame:
    """Pairs that edit the character behind the state's ``depth`` characters: both rests are equal.

    A word in which the character is deleted meets the word that reads the same without the
    deletion; words that differ in the character meet each other. Keys are (state, rest), and
    the state is a prefix, so a key holds a word for each character that can stand there.
    """
    state, rest = F.substr("word", F.lit(1), F.lit(depth)), F.substr("word", F.lit(depth + 1), F.length("word"))
    without = words.where(F.length("word") > depth).select(
        F.concat(state, F.lit("\n"), F.substr("word", F.lit(depth + 2), F.length("word"))).alias("key"), "word"
    )
    whole = words.where(F.length("word") >= depth).select(F.concat(state, F.lit("\n"), rest).alias("key"), F.col("word").alias("other"))
    deleted = without.join(whole, "key").select("word", "other")
    replaced = without.join(without.select("key", F.col("word").alias("other")), "key").where("word < other")
    return deleted.unionByName(replaced.select("word", "other"))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each closed state; rows (state, depth, word) come sorted by state."""

    def batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["word", "other"]
        )

    def rows() -> Iterator[tuple[str, int, str]]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("state", "depth", "word")), strict=True)

    held: list[tuple[str, str]] = []
    for (_, depth), group in groupby(rows(), key=lambda r: r[:2]):
        for pair in state_pairs([r[2] for r in group], depth):
            held.append(pair)
            if len(held) >= PAIR_ROWS:
                yield batch(held)
                held = []
    yield batch(held)


def near_pairs(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """(word, other): distinct pairs of (word) rows that differ by exactly one edit, in both orders.

    There are as many rounds as the longest prefix that more than ``state_words`` words share
    has characters, and one more.
    """
    left = written(words.select("word").distinct(), "spelling-open")
    # The start state is always opened, so the work is dealt however few the words are.
    found = [_opened(left, 0)]
    closed = []
    depth = 1
    while not left.isEmpty():
        keyed = left.select(F.substr("word", F.lit(1), F.lit(depth)).alias("state"), F.lit(depth).alias("depth"), "word")
        sizes = keyed.groupBy("state").agg(F.count("*").alias("size"))
        large = written(sizes.where(F.col("size") > state_words).select("state"), "spelling-states")
        closed.append(beside(keyed, large, ["state"], "left_anti").select("state", "depth", "word"))
        left = written(beside(keyed, large, ["state"], "left_semi").select("word"), "spelling-open")
        found.append(_opened(left, depth))
        depth += 1
    if closed:
        states = reduce(DataFrame.unionByName, closed).repartition("state").sortWithinPartitions("state", "word")
        found.append(states.mapInArrow(_composed, "word string, other string"))
    pairs = reduce(DataFrame.unionByName, found)
    turned = F.struct(F.col("other").alias("word"), F.col("word").alias("other"))
    both = pairs.select(F.explode(F.array(F.struct("word", "other"), turned)).alias("p"))
    return both.select("p.word", "p.other").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each step doubles the way, until none leads on.

    Forms at least double the count, so ways are short and free of circles.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = written(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        roots = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """Form and root of every word of (word, n), and the number of its near words.

    The form of a word is its most frequent near word if that has at least twice its count;
    the root is where the forms lead.
    """
    words = written(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words, state_words)
    counted = pairs.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    # The struct's order is count first, then the smaller word: the negated count's minimum.
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    )
    near = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.minus") >= 2 * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.minus") >= 2 * F.col("n"), -F.col("best.minus")).alias("form_n"),
    )
    near = written(near, "spelling-near")
    roots = _roots(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the words of all documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))


# Near words meet in the word itself or in what is left when one of their characters is gone.
OP11_SQL = """
with recursive steps(i, k, v) as (
    select cast(i as bigint), 0, cast(i as bigint) from range(256) r(i)
    union all
    select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from steps where k < 8
),
crc_table as (select list(v order by i) as t from steps where k = 8),
runs as (
    select doc_id, run, count(*) as times from (
        select doc_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
        from documents)
    group by doc_id, run
),
hashed as (
    select run, times, xor(4294967295, list_reduce(
        list_prepend(cast(4294967295 as bigint), list_transform(
            regexp_extract_all(hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)), '..'),
            lambda x: cast(strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17 as bigint))),
        lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) as h
    from runs, crc_table
),
words as (
    select case when h % 97 = 0 then run[: h % length(run)] || run[h % length(run) + 2 :] else run end as word,
        cast(sum(times) as bigint) as n
    from hashed group by 1 having length(word) >= 5 and n >= 3
),
gone as (
    select word, n, cast(i as bigint) as i, word[: i] || word[i + 2 :] as rest from words, unnest(range(length(word))) u(i)
),
pairs as (
    select a.word, b.word as other, b.n as other_n from gone a join gone b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union
    select a.word, b.word, b.n from gone a join words b on a.rest = b.word
    union
    select b.word, a.word, a.n from gone a join words b on a.rest = b.word
),
best as (
    select word, count(*) as n_near, max(other_n) as form_n, arg_min(other, (-other_n, encode(other))) as form from pairs group by word
),
near as (
    select w.word, w.n, coalesce(b.n_near, 0) as n_near,
        case when b.form_n >= 2 * w.n then b.form end as form, case when b.form_n >= 2 * w.n then b.form_n end as form_n
    from words w left join best b on b.word = w.word
),
ways as (
    select word, word as at, form as onward from near
    union all
    select y.word, y.onward, x.form from ways y join near x on x.word = y.onward
)
select x.word, x.form, y.at as root, x.n, x.n_near, x.form_n
from near x join ways y on y.word = x.word and y.onward is null
"""
