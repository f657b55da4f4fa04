"""Toxicity by a weighted finite-state grammar whose clauses, not single words, are scored.

Two levels of weighted transducers (states, arcs with an input, an output, a weight and a next state; final states). The lexicon reads
letters and gives a word's class: insult (stems with weights, learned from labels), threat, target, negation or reported speech
(closed word lists of four languages). Three transducers read the classes of a clause, word by word:

* reported speech: after a word of saying, insults and threats of the clause are quoted;
* negation: it reaches over the next `SCOPE` words, in which insults and threats are denied;
* target: an insult or threat is aimed if a target stands within `REACH` words before it, or follows within as many; the latter is a
  guess that the path has to make good, so the transducer is not deterministic.

They are composed into one, whose best path through a clause says what each insult or threat is: plain, aimed, denied or quoted. The
arcs of the best path add the lexicon's weights to these patterns. A text's patterns and the share of its matched clauses are weighed by a
logistic model, fitted on the same labels.

Learning reads `most_rows` labelled documents and `most_chars` code points of them at most (the documented bounds: those with the least
hash of doc_id); the caller names the column that marks rows to learn from. A stem counts once for each distinct text.

Defined results: a null or empty text has the score of a text without matches. Without labels, or with one label only,
the score is the smoothed rate of label 1 for every text. Repeated rows have equal scores. Labels that contradict each
other for one doc_id count as 1. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import chunks, clean_documents, materialise

#: Classes of words, and the letter that stands for each in the clause transducers ("o": any other word).
INSULT, THREAT, TARGET, NEGATION, REPORT = 1, 2, 3, 4, 5
LETTER = {INSULT: "i", THREAT: "h", TARGET: "t", NEGATION: "n", REPORT: "r"}
SCOPE, REACH = 4, 4

#: Closed classes in English, German, French and Spanish.
WORDS = {
    THREAT: "kill hurt destroy beat stab shoot burn punish crush murder töten umbringen schlagen verletzen vernichten tuer frapper blesser détruire matar golpear herir destruir",
    TARGET: "you your you're yours yourself he she they them their these those this people du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos ils elles tú ti usted ustedes tus vosotros ellos ellas",
    NEGATION: "not never no none neither nor isn't aren't wasn't don't doesn't didn't nobody nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna tampoco",
    REPORT: "said says saying called calls told quoted quote claimed claims reported wrote writes sagte sagt nannte nennt schrieb behauptete dit disait appelé appelle écrit affirmé dijo dice llamó llama escribió afirmó",
}
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSES = re.compile(r"[.!?;:,|\n]+")
#: Patterns of the clause transducer: (insult or threat) x (plain, aimed, denied, quoted).
PLAIN, AIMED, DENIED, QUOTED = range(4)
N_PATTERNS = 8
MATCHED, N_FEATURES = N_PATTERNS, N_PATTERNS + 1
#: Cached words of a worker process; beyond it the cache starts anew.
CACHED_WORDS = 300_000


class Transducer:
    """A weighted finite-state transducer; state 0 is the first. arcs: (state, input) to a list of (output, weight, next state)."""

    def __init__(self):
        self.arcs: dict[tuple[int, str], list[tuple[object, float, int]]] = {}
        self.final: dict[int, float] = {}

    def arc(self, state: int, label: str, output: object, weight: float, to: int) -> None:
        self.arcs.setdefault((state, label), []).append((output, weight, to))

    def compose(self, other: Transducer) -> Transducer:
        """This one's outputs read by the other: pairs of states that are reached from (0, 0)."""
        number, todo, out = {(0, 0): 0}, [(0, 0)], Transducer()
        labels = {label for _, label in self.arcs}
        while todo:
            pair = todo.pop()
            if pair[0] in self.final and pair[1] in other.final:
                out.final[number[pair]] = self.final[pair[0]] + other.final[pair[1]]
            for label in sorted(labels):
                for middle, w, a in self.arcs.get((pair[0], label), ()):
                    for output, x, b in other.arcs.get((pair[1], middle), ()):
                        if (a, b) not in number:
                            number[(a, b)] = len(number)
                            todo.append((a, b))
                        out.arc(number[pair], label, output, w + x, number[(a, b)])
        return out

    def best_path(self, labels: list[str]) -> tuple[float, list] | None:
        """The greatest weight of a path that reads the labels and ends finally, and its outputs; the first found of equal ones."""
        best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for label in labels:
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (weight, path) in best.items():
                for output, w, to in self.arcs.get((state, label), ()):
                    if to not in new or weight + w > new[to][0]:
                        new[to] = (weight + w, (path, output))
            best = new
        ends = [(weight + self.final[state], path) for state, (weight, path) in best.items() if state in self.final]
        if not ends:
            return None
        weight, path = max(ends, key=lambda e: e[0])
        outputs = []
        while path is not None:
            path, output = path
            outputs.append(output)
        return weight, outputs[::-1]


def lexicon(words: list[tuple[str, tuple, bool]]) -> Transducer:
    """Letters to an output: each word (or stem, which any letters may follow) with its output, on the arc of its last letter."""
    out, used = Transducer(), 1
    for word, output, stem in words:
        state = 0
        for c in word:
            there = out.arcs.get((state, c))
            if there is None:
                out.arc(state, c, None, 0.0, used)
                there, used = out.arcs[(state, c)], used + 1
            state = there[0][2]
        out.final.setdefault(state, 0.0)
        out.arc(state, "stem" if stem else "word", output, output[1], state)
    return out


def look_up(words: Transducer, word: str) -> tuple | None:
    """The output of the longest entry that the word is, or (a stem) that it starts with."""
    state, best = 0, None
    for c in word:
        there = words.arcs.get((state, c))
        if there is None:
            return best
        state = there[0][2]
        best = words.arcs.get((state, "stem"), [(best,)])[-1][0]
    return words.arcs.get((state, "word"), [(best,)])[-1][0]


def report_transducer() -> Transducer:
    t = Transducer()
    for state in (0, 1):
        t.final[state] = 0.0
        t.arc(state, "r", "o", 0.0, 1)
        for label in "tno":
            t.arc(state, label, label, 0.0, state)
        for label in "ih":
            t.arc(state, label, label + "q" * state, -0.5 * state, state)
    return t


def negation_transducer(scope: int = SCOPE) -> Transducer:
    """State: how many words the last negation still reaches."""
    t = Transducer()
    for state in range(scope + 1):
        t.final[state] = 0.0
        t.arc(state, "n", "o", 0.0, scope)
        for label in ("t", "o", "iq", "hq"):
            t.arc(state, label, label, 0.0, max(state - 1, 0))
        for label in "ih":
            t.arc(state, label, label + "d" * (state > 0), -0.5 * (state > 0), max(state - 1, 0))
    return t


def target_transducer(reach: int = REACH) -> Transducer:
    """States 0 to reach: for how many words the last target still counts; above: in how many words a target has to come."""
    t = Transducer()
    for state in range(reach + 1):
        t.final[state] = 0.0
        rest = max(state - 1, 0)
        t.arc(state, "t", "o", 0.0, reach)
        for label in ("o", "iq", "hq", "id", "hd"):
            t.arc(state, label, label, 0.0, rest)
        for label in "ih":
            if state:
                t.arc(state, label, label + "a", 1.0, rest)
            else:
                t.arc(state, label, label, 0.0, 0)
                t.arc(state, label, label + "a", 1.0, 2 * reach)
    for state in range(reach + 1, 2 * reach + 1):  # not final: the guess is still open
        t.arc(state, "t", "o", 0.0, reach)
        if state > reach + 1:
            for label in ("o", "iq", "hq", "id", "hd"):
                t.arc(state, label, label, 0.0, state - 1)
            for label in "ih":
                t.arc(state, label, label + "a", 1.0, state - 1)
    return t


#: Reads the letters of a clause's words; gives "o", or an insult's or threat's letter with its pattern.
CLAUSE = report_transducer().compose(negation_transducer()).compose(target_transducer())
PATTERN = {label + mark: 4 * kind + k for kind, label in enumerate("ih") for k, mark in enumerate(("", "a", "d", "q"))}


@dataclass
class Grammar:
    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    bias: float = 0.0

    def __post_init__(self):
        closed = [(w, (cls, 1.0), False) for cls, text in WORDS.items() for w in text.split()]
        self.words = lexicon(closed + [(s, (INSULT, w), True) for s, w in self.stems.items()])
        self.cache: dict[str, tuple] = {}

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def classes(self, word: str) -> tuple:
        """(class, weight) of each word in what is written between two spaces; (0, 0.0) of words without a class."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            got = self.cache[word] = tuple(look_up(self.words, w) or (0, 0.0) for w in LETTERS.findall(word.lower()))
        return got

    def clause(self, text: str) -> list[tuple[int, float]]:
        """(pattern, weight) of each insult and threat on the best path through a clause."""
        read = [c for word in text.split() for c in self.classes(word)]
        if not any(0 < cls <= THREAT for cls, _ in read):
            return []  # the path's outputs are all "o"
        _, outputs = CLAUSE.best_path([LETTER.get(cls, "o") for cls, _ in read])
        return [(PATTERN[o], weight) for o, (_, weight) in zip(outputs, read, strict=True) if o != "o"]

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(N_FEATURES)
        if not any(0 < cls <= THREAT for w in set(text.split()) for cls, _ in self.classes(w)):
            return out  # no clause can match
        clauses = [c for c in CLAUSES.split(text) if c.strip()]
        matched = 0
        for clause in clauses:
            found = self.clause(clause)
            matched += bool(found)
            for pattern, weight in found:
                out[pattern] += weight
        out[MATCHED] = 100 * matched / (len(clauses) + 5)
        return np.log1p(out)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def log_odds(ones: int, zeros: int, n: list[int]) -> float:
    return math.log((ones + 0.5) / (n[1] + 1)) - math.log((zeros + 0.5) / (n[0] + 1))


def learn_stems(texts: list[str], labels: list[int], shortest: int = 4, longest: int = 7, least_share: float = 0.01, least_odds: float = 1.5, least_repeated: float = 3.0) -> dict[str, float]:
    """Stems with the log odds of the texts that have them.

    A stem is repeated in at least least_share of the texts of label 1 (and 3 of them), and texts that repeat it have log
    odds of least_repeated: an invented insult may by chance start an innocent word, which then seldom comes twice.
    """
    once, twice, n = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for text, y in {t: y for t, y in zip(texts, labels, strict=True)}.items():
        stems = Counter(w[:k] for w in LETTERS.findall(text.lower()) for k in range(shortest, min(longest, len(w)) + 1))
        once[y].update(stems.keys())
        twice[y].update(s for s, c in stems.items() if c > 1)
        n[y] += 1
    odds = {}
    for s, c in twice[1].items():
        if c >= max(3, least_share * n[1]) and log_odds(c, twice[0][s], n) >= least_repeated:
            o = log_odds(once[1][s], once[0][s], n)
            if o >= least_odds:
                odds[s] = min(o, 8.0)
    # a longer stem only where it says more than the shorter one it starts with
    return {s: o for s, o in odds.items() if not any(odds.get(s[:k], -1) >= o - 0.5 for k in range(shortest, len(s)))}


def fit(texts: list[str], labels: list[int], ridge: float = 1e-2, steps: int = 30) -> Grammar:
    n, ones = len(labels), sum(labels)
    if not 0 < ones < n:
        rate = (ones + 1) / (n + 2) if n else 0.1
        return Grammar({}, bias=math.log(rate / (1 - rate)))
    g = Grammar(learn_stems(texts, labels))
    x = np.array([g.features(t) for t in texts])
    x1, y = np.c_[x, np.ones(n)], np.array(labels, float)
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6]) * n / 10
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    g.weights, g.bias = w[:-1], float(w[-1])
    return g


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 8000, most_chars: int = 64_000_000) -> Grammar:
    """A grammar from the labelled documents that are not held out, most_rows and most_chars at most; of a repeated doc_id the least text."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("y"))
    known = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = clean_documents(docs).join(F.broadcast(known), F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts = materialise(texts.withColumn("chars", F.length("text")), "labelled")
    so_far, picked = 0, []
    for r in texts.select("doc_id", "chars").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # most_rows at most
        so_far += r.chars
        if so_far <= most_chars or not picked:
            picked.append((r.doc_id,))
    if not picked:
        return fit([], [])
    own = docs.sparkSession.createDataFrame(picked, "doc_id long")
    rows = texts.join(F.broadcast(own), "doc_id").select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [int(r.y) for r in rows])


def score(docs: DataFrame, grammar: Grammar, cut: float = 0.7) -> DataFrame:
    """doc_id, score, predicted; one row for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = model.value
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                s = g.scores(np.array([g.features(t) for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return clean_documents(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar, cut: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores below cut, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(grammar)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = model.value
        at = names.index("text")
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                s = g.scores(np.array([g.features(t or "") for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(s < cut))

    return docs.mapInArrow(run, docs.schema)
