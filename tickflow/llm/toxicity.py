"""Operator 10: toxicity from a learned lexicon, matched by Levenshtein automata, and the windows around hits."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hand_back_memory

from .langid import held_out, training_rows

WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that can be lexicon entries (shorter ones begin harmless words too), and the least length of a term that is matched with an edit.
STEMS, FUZZY = (5, 6, 7, 8), 5
#: Evidence of a hit with an edit and of one in quotation, as parts of that of an exact hit in plain use.
EDITED, QUOTED = 0.9, 0.1
#: Words on either side of a hit that make its window.
WINDOW = 6
# Words by which a hit counts as reported speech, in English, German, French and Spanish, and quotation marks.
REPORTING = frozenset(
    "said says quote quoted quoting called wrote written word words term slur meaning example reported cites citing "
    "sagte sagt zitat zitiert nannte genannt schrieb wort wörter begriff bedeutung beispiel berichtete "
    "dit disait cite cité citation appelé écrit mot mots terme insulte exemple rapporte "
    "dijo dice cita citó citado llamó llamado escribió palabra palabras término insulto ejemplo informó".split()
)
QUOTES = "\"“”«»„‟"
#: Distinct words that a worker remembers the lexicon entry of.
REMEMBERED = 100_000


@dataclass
class Lexicon:
    """Terms and beginnings with their weights, as a trie; ``match`` gives a word's entry, exact or one edit away.

    A beginning stands for longer words only.  ``plain`` are words one edit from a term that other texts use too:
    they are words of their own, no misspelt terms.
    """

    terms: dict[str, float]
    stems: dict[str, float]
    plain: frozenset[str] = frozenset()
    trie: dict = field(default_factory=dict)
    known: dict[str, tuple[float, bool] | None] = field(default_factory=dict)

    def __post_init__(self):
        self.heads, self.tails = set(), set()
        for term in self.terms:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            if len(term) >= FUZZY:
                half = len(term) // 2
                self.heads.add(term[:half])
                self.tails.add(term[half:])
        self.sizes = {k: sorted({len(x) for x in part}) for k, part in (("heads", self.heads), ("tails", self.tails))}

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of the entry that the word matches, None if it matches none."""
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = self._match(word)
        return self.known[word]

    def _match(self, word: str) -> tuple[float, bool] | None:
        found = [self.stems[word[:k]] for k in STEMS if len(word) > k and word[:k] in self.stems]
        if word in self.terms:
            found.append(self.terms[word])
        if found:
            return max(found), True
        # one edit leaves one half of a term whole, at the word's beginning or end
        if word not in self.plain and len(word) >= FUZZY - 1 and (any(word[:k] in self.heads for k in self.sizes["heads"]) or any(word[-k:] in self.tails for k in self.sizes["tails"])):
            near = [t for t in within_one_edit(word, self.trie) if len(t) >= FUZZY]
            if near:
                return max(self.terms[t] for t in near), False
        return None


def within_one_edit(word: str, trie: dict) -> list[str]:
    """Terms of the trie that the Levenshtein automaton of the word, for one edit, accepts.

    The automaton is kept as two sets of places in the word, as bits: those reached without an edit and
    those reached with one.  The trie is walked only along letters that leave a place.
    """
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << i
    end, full = 1 << len(word), (1 << len(word) + 1) - 1
    found, walk = [], [(trie, 1, 2 & full)]
    while walk:
        node, exact, edited = walk.pop()
        for c, below in node.items():
            if c == "":
                if (exact | edited) & end:
                    found.append(below)
                continue
            same = at.get(c, 0)
            go = (exact & same) << 1
            other = ((edited & same) << 1 | exact | exact << 1 | go << 1) & full
            if go | other:
                walk.append((below, go, other))
    return found


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = float(features(text or "", self.lexicon) @ self.weights + self.bias)
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """Evidence of a text's hits, their number of different words in plain use, and the evidence a word.

    A hit's evidence is its entry's weight, times EDITED if it is misspelt and QUOTED if it is in quotation: when
    its window has a reporting word, or when an odd number of quotation marks in the window stands before it and
    at least one after.
    """
    hits, words = [], []
    for k, m in enumerate(WORD.finditer(text.lower())):
        words.append(m.group())
        if found := lexicon.match(words[-1]):
            hits.append((k, *found))
    total, distinct = 0.0, set()
    for k, weight, exact in hits:
        window = words[max(0, k - WINDOW) : k + WINDOW + 1]
        quoted = not REPORTING.isdisjoint(window) or _in_quotes(text, words, k)
        total += weight * (1 if exact else EDITED) * (QUOTED if quoted else 1)
        if not quoted:
            distinct.add(words[k])
    return np.array([np.log1p(total), np.log1p(len(distinct)), total / (20 + len(words))])


def _in_quotes(text: str, words: list[str], k: int) -> bool:
    if not any(q in text for q in QUOTES):
        return False
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) != len(words):  # lower-casing changed the words
        return False
    before = text[spans[max(0, k - WINDOW)][0] : spans[k][0]]
    after = text[spans[k][1] : spans[min(len(spans), k + WINDOW + 1) - 1][1] + 1]
    return sum(map(before.count, QUOTES)) % 2 == 1 and any(q in after for q in QUOTES)


def learn_lexicon(rows: list[tuple[str, int]], least: int = 3, ratio: float = 10.0) -> Lexicon:
    """Words and word beginnings that toxic texts have ``ratio`` times as often as others, in ``least`` texts at least.

    The number of toxic texts counts less 1.3 times its own root, so that rare strings don't stand out by
    chance, and every entry is held against both halves of the rows: one that has not a third of ``ratio`` in
    either goes.  The weight is the logarithm of the odds.  A longer beginning stays beside a shorter one if it
    weighs more; terms stay beside the beginnings that cover them, to be matched with edits.
    """
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    least = max(least, len(toxic) // 200)

    def words_of(text):
        return set(WORD.findall(text.lower()))

    def entries(words, size):
        return {w[:size] for w in words if len(w) > size} if size else {w + "$" for w in words}

    seen, other = (Counter(), Counter()), (Counter(), Counter())
    for size in (0, *STEMS):  # one size at a time: most entries are rare and go
        halves = Counter(), Counter()
        for k, text in enumerate(toxic):
            halves[k % 2].update(entries(words_of(text), size))
        for e in {*halves[0], *halves[1]}:
            if halves[0][e] + halves[1][e] >= least:
                seen[0][e], seen[1][e] = halves[0][e], halves[1][e]
    known = set(seen[0])
    for k, text in enumerate(clean):
        words = words_of(text)
        for size in (0, *STEMS):
            other[k % 2].update(entries(words, size) & known)

    def odds(e, halves, sure):
        n, m = sum(seen[h][e] for h in halves), sum(other[h][e] for h in halves)
        size, rest = (sum(len(range(h, len(x), 2)) for h in halves) for x in (toxic, clean))
        return ((n - sure * n**0.5) / max(1, size)) / ((m + 0.5) / max(1, rest))

    def stands_out(e):
        n, m = seen[0][e] + seen[1][e], other[0][e] + other[1][e]
        return m <= n and odds(e, (0, 1), 1.3) >= ratio and min(odds(e, (0,), 0), odds(e, (1,), 0)) >= ratio / 3

    weights = {e: float(np.log(odds(e, (0, 1), 1.3))) for e in sorted(known) if stands_out(e)}
    terms = {e[:-1]: o for e, o in weights.items() if e[-1] == "$"}
    stems: dict[str, float] = {}
    for e in sorted((e for e in weights if e[-1] != "$"), key=lambda e: (len(e), e)):
        # a beginning that only one word has is that word
        own = [t for t in terms if len(t) > len(e) and t.startswith(e)]
        alone = len(own) == 1 and seen[0][own[0] + "$"] + seen[1][own[0] + "$"] == seen[0][e] + seen[1][e]
        if not alone and not any(stems.get(e[:k], 0.0) >= weights[e] for k in STEMS if k < len(e)):
            stems[e] = weights[e]
    found = Lexicon(terms, stems)
    return Lexicon(terms, stems, frozenset(w for text in clean for w in words_of(text) if (hit := found.match(w)) and not hit[1]))


def fit(rows: list[tuple[str, int]], prior: float, rounds: int = 400, seed: int = 3) -> Model:
    """Logistic weights and a lexicon.

    The weights are fitted on one half of the rows with a lexicon from the other, so that chance entries weigh
    as they do on new texts; the lexicon that is kept comes from all rows.
    """
    if not any(y for _, y in rows) or all(y for _, y in rows):
        return Model(Lexicon({}, {}), np.zeros(3), float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    order = np.random.default_rng(seed).permutation(len(rows))
    # few toxic rows: all serve both ends
    few = sum(y for _, y in rows) < 60
    first, second = (rows, rows) if few else ([rows[k] for k in order[::2]], [rows[k] for k in order[1::2]])
    lexicon = learn_lexicon(first)
    x = np.array([features(t, lexicon) for t, _ in second])
    y = np.array([float(v) for _, v in second])
    share = y.mean()
    w = np.where(y > 0, prior / max(share, 1e-6), (1 - prior) / max(1 - share, 1e-6))
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - middle) / scale, np.ones(len(x))]
    use = np.ones(z.shape[1], bool)
    while True:  # more evidence never lowers a score: a feature with a negative weight is left out
        beta = _newton(z * use, y, w, rounds // 20) * use
        if not (beta[:-1] < 0).any():
            break
        use[:-1] &= beta[:-1] >= 0
    weights = beta[:-1] / scale
    return Model(learn_lexicon(rows), weights, float(beta[-1] - weights @ middle))


def _newton(z: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood."""
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        ridge = np.r_[np.full(z.shape[1] - 1, 0.1), 1e-6]
        grad = z.T @ (w * (p - y)) + ridge * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        beta -= np.linalg.solve(hess, grad)
    return beta


def learned(docs: DataFrame, labels: DataFrame, most_rows: int = 2500) -> Model:
    """Fit on up to some ``most_rows`` toxic and as many other labelled rows of ``docs``, outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id", 3, 1)).select("doc_id", F.col("toxic").alias("label"))
    n = dict(known.groupBy("label").count().collect())
    rows: list[tuple[str, int]] = []
    for label, most in ((1, most_rows), (0, most_rows)):
        share = min(1.0, most / max(1, n.get(label, 0)))
        drawn = known.where((F.col("label") == label) & (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))).distinct()
        rows += training_rows(docs.select("doc_id", "text").join(F.broadcast(drawn.limit(2 * most)), "doc_id"), 2 * most, "text", "label", "doc_id")
    model = fit(rows, n.get(1, 0) / max(1, sum(n.values())))
    model.lexicon.known.clear()
    hand_back_memory()
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, predicted.

    ``score`` is the estimated chance that the text is toxic, ``predicted`` is 1 from ``threshold`` on.
    Null texts count as empty; without labelled rows to learn from every score is about the share of toxic
    ones.  Whole texts are read; ids may be null or repeat; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            s = np.array([model.score(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more: a filter inside each task, all columns kept."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            clean = [model.score(t) < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))
        model.lexicon.known.clear()
        hand_back_memory()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, then score every row."""
    found = scored(docs, learned(docs, labels))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
