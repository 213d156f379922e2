"""Toxicity by weak supervision.

Voters are small hand-made lexicons, patterns (shouting, masked letters, "you are a ..."),
and words, word beginnings and their repetitions that labelled rows for learning suggest. A generative label
model with a hidden type estimates, by expectation maximisation and from the votes alone, how
often each voter fires in either type, and which voters are correlated beyond the type; these
depend on each other in the model (a forest). A type is started for each group of voters that
fire together (those of a language, as a rule), and one for rows without a vote that counts.
A small part of the rows (`anchor`) shows its labels, which tell what share of each type is
toxic. A linear classifier on words, word beginnings, their repetitions, lexicons and patterns is trained on the
posterior labels and scores every whole text.

The voters and models are fitted on a bounded sample of labelled rows (`sample`). Rows
and edge cases: a null or empty text has no features and gets the score of the bias; with
no labelled row of label 1 the hand-made lexicons alone decide (any hit scores 0.9), and a lexicon
without a hit in the sample scores 0.73 by itself; rows of an id that is repeated in docs
teach once, by their least text; repeated rows get equal scores; a null doc_id is not held out; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import byte_texts
from .linear import fold, labelled_sample, soft_logistic

#: Hand-made lists of insults, whole words.
LEXICONS = {
    "en": "idiot moron stupid trash scum loser pathetic worthless clown disgusting dumb jerk imbecile fool garbage filthy",
    "de": "idiot trottel dumm dummkopf abschaum versager widerlich wertlos arschloch depp",
    "fr": "idiot imbécile stupide crétin ordure minable débile pourriture connard abruti",
    "es": "idiota imbécil estúpido basura escoria perdedor patético inútil asqueroso payaso",
}
#: Patterns that may hint at abuse; some of them rarely do, which the label model finds out.
PATTERNS = {
    "you_are_a": r"\byou(?:'re| are) (?:a|an|such)\b",
    "shut_up": r"\bshut up\b",
    "masked": r"\b\w[*@#$]{2,}\w*\b",
    "shouting": r"(?:\b[A-Z]{4,}\b\W+){4}",
    "exclaimed": r"!{3,}",
    "hate": r"\bi hate\b",
}
_COMPILED = {name: re.compile(p, 0 if name == "shouting" else re.IGNORECASE) for name, p in PATTERNS.items()}
_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


#: A beginning is frequent in a text if one in so many words has it, and two at least.
FREQUENT = 100


def beginnings_of(word: str) -> list[str]:
    """The beginnings of a word, marked by a hyphen."""
    return [f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n]


def words_of(text: bytes) -> Counter:
    return Counter(_WORD.findall(text.decode("utf-8", "replace").lower()))


def repeated(counts: Counter, n_words: int) -> list[str]:
    """Parts that stand for beginnings that come twice (abcd-2), and for frequent ones (abcd-often)."""
    twice = [p for p, k in counts.items() if k >= 2]
    return [f"{p}2" for p in twice] + [f"{p}often" for p in twice if counts[p] * FREQUENT >= n_words]


def parts_in(words: Counter) -> set[str]:
    """The words of a text, their beginnings, and which of these are repeated."""
    counts: Counter = Counter()
    for w, k in words.items():
        for p in beginnings_of(w):
            counts[p] += k
    return {*words, *counts, *repeated(counts, words.total())}


def _forest(strength: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """(parent, tree) of each voter: the strongest links first, as long as they close no circle; a tree hangs from its first voter."""
    m, tree = len(strength), list(range(len(strength)))
    near: list[list[int]] = [[] for _ in range(m)]
    pairs = [(strength[i, j], i, j) for i in range(m) for j in range(i + 1, m) if strength[i, j] > least]
    for _, i, j in sorted(pairs, reverse=True):
        if tree[i] != tree[j]:
            old, new = sorted((tree[i], tree[j]))[::-1]
            tree = [new if t == old else t for t in tree]
            near[i].append(j)
            near[j].append(i)
    parents, reached = [-1] * m, set()
    for root in range(m):
        todo = [] if root in reached else [root]
        while todo:
            one = todo.pop()
            reached.add(one)
            for other in near[one]:
                if other not in reached:
                    parents[other] = one
                    todo.append(other)
    return parents, tree


class LabelModel:
    """Votes (0 or 1) of voters given a hidden type, by expectation maximisation.

    Type 0 is the rest; each group of voters that fire together starts a type of its own. At
    first voters are independent in a type, but for near copies of each other. Then the
    strongest correlations that the types leave unexplained, above `correlated`, make a forest;
    the vote of a voter depends on the type and on its parent's vote, and the model is fitted
    again. labels: the class (0 or 1) of the
    first rows, which gives each type its share of class 1; without any, types but 0 are class 1.
    """

    def __init__(self, votes: np.ndarray, labels: np.ndarray, together: float = 0.15, correlated: float = 0.2, copies: float = 0.7, rounds: int = 40):
        n, m = votes.shape
        mean = votes.mean(axis=0)
        phi = np.nan_to_num(np.corrcoef(votes, rowvar=False)) if m > 1 else np.ones((1, 1))
        groups = _forest(phi, together)[1]
        self.parents = _forest(phi, copies)[0]
        start, prior = [np.clip(0.05 * mean, 1e-4, 0.5)], []
        for g in sorted(set(groups)):
            own = np.array(groups) == g
            start.append(np.where(own, 0.5, start[0]))
            prior.append(np.clip(votes[:, own].any(axis=1).mean(), 1e-4, 0.3))
        self.types = np.array([max(1 - sum(prior), 0.2), *prior])
        self.types /= self.types.sum()
        #: P(vote | type, vote of the parent) by voter
        self.rates = np.stack([np.stack(start, axis=1)] * 2, axis=2)
        self._fit(votes, rounds)
        post, left = self.type_posterior(votes), np.zeros((m, m))
        for t in range(len(self.types)):
            apart = votes - post[:, t] @ votes / max(post[:, t].sum(), 1e-9)
            left += (apart * post[:, [t]]).T @ apart
        spread = np.sqrt(np.maximum(np.diag(left), 1e-9))
        self.correlations = left / np.outer(spread, spread)
        self.parents = _forest(np.abs(self.correlations), correlated)[0]
        self._fit(votes, rounds)
        post = self.type_posterior(votes)
        #: the share of class 1 of each type, from the rows with labels
        shown, doubt = post[: len(labels)], np.where(np.arange(len(self.types)) == 0, 0.0, 1.0)
        self.toxic = (shown.T @ labels + 0.5 * doubt) / (shown.sum(axis=0) + 0.5)
        self.prior = float((post @ self.toxic).mean())
        ones, zeros = post @ self.toxic, 1 - post @ self.toxic
        #: how often each voter fires in either class, and the share of class 1 where it fires
        self.fires, self.misfires = (ones @ votes + 0.02) / (ones.sum() + 1), (zeros @ votes + 0.02) / (zeros.sum() + 1)
        self.precisions = (ones @ votes) / np.maximum(votes.sum(axis=0), 1)

    def _split(self, votes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Where the parent of a voter has not voted and where it has, and the votes in these places."""
        above = np.stack([votes[:, p] if p >= 0 else np.zeros(len(votes)) for p in self.parents], axis=1)
        masks = [1.0 - above, above]
        return masks, [mask * votes for mask in masks]

    def _fit(self, votes: np.ndarray, rounds: int) -> None:
        split = self._split(votes)
        for _ in range(rounds):
            post = self._types(*split)
            self.types = np.clip(post.mean(axis=0), 1e-5, 1.0)
            own = (post.T @ votes + 0.02) / (post.sum(axis=0)[:, None] + 1)
            for u, (mask, cast) in enumerate(zip(*split, strict=True)):
                self.rates[:, :, u] = ((post.T @ cast + 2 * own) / (post.T @ mask + 2)).T

    def _types(self, masks: list[np.ndarray], cast: list[np.ndarray]) -> np.ndarray:
        rates = np.clip(self.rates, 1e-5, 1 - 1e-5)
        log = np.log(self.types)[None, :] + sum(cast[u] @ np.log(rates[:, :, u]) + (masks[u] - cast[u]) @ np.log(1 - rates[:, :, u]) for u in (0, 1))
        post = np.exp(log - log.max(axis=1, keepdims=True))
        return post / post.sum(axis=1, keepdims=True)

    def type_posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._types(*self._split(votes))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1 | votes) of each row."""
        return self.type_posterior(votes) @ self.toxic


def candidates(sample: DataFrame, support: int, share: float) -> list[str]:
    """All parts that mark label 1 among the rows of sample (y, text): half of the rows with it have label 1, and of those with label 1 at least `support` and `share` have it."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ones, rows = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), byte_texts(batch.column("text")), strict=True):
                own = parts_in(words_of(text))
                rows.update(own)
                if y:
                    ones.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64()), pa.array([ones[p] for p in rows], pa.int64())], names=["part", "n", "ones"])

    sums = sample.select("y", "text").mapInArrow(count, "part string, n long, ones long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    least = max(support, share * sample.filter("y = 1").count())
    marked = sums.filter((F.col("ones") >= least) & (F.col("ones") >= 0.5 * F.col("n")))
    return [r["part"] for r in marked.orderBy(F.desc("ones"), "part").collect()]


def sample_hits(sample: DataFrame, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, hits of the parts, and hits of lexicons and patterns, for each row of sample (id, y, text)."""
    place = {p: i for i, p in enumerate(parts)}
    lexicons = [set(words.split()) for words in LEXICONS.values()]

    def hits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found, fixed = [], []
            for text in byte_texts(batch.column("text")):
                words = words_of(text)
                own, at = set(words), sorted(place[p] for p in parts_in(words) if p in place)
                whole = text.decode("utf-8", "replace")
                found.append(at)
                fixed.append([bool(own & x) for x in lexicons] + [bool(p.search(whole)) for p in _COMPILED.values()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.list_(pa.int32())), pa.array(fixed, pa.list_(pa.bool_()))], names=["id", "y", "found", "fixed"])

    table = sample.select("id", "y", "text").mapInArrow(hits, "id long, y int, found array<int>, fixed array<boolean>").toArrow()
    x = np.zeros((len(table), len(parts)), dtype=bool)
    for row, at in zip(x, table.column("found").to_pylist(), strict=True):
        row[at] = True
    fixed = np.array(table.column("fixed").to_pylist(), dtype=bool).reshape(len(table), len(LEXICONS) + len(PATTERNS))
    order = np.argsort(table.column("id").to_numpy(), kind="stable") if len(table) else np.empty(0, dtype=int)
    return table.column("y").to_numpy()[order], x[order], fixed[order]


def cover(y: np.ndarray, x: np.ndarray, most: int, purity: float, times: int = 3) -> list[int]:
    """The parts that one after another mark the most rows of label 1 that fewer than `times` parts mark, among those of which few mark others."""
    ones, others, chosen = x[y == 1], x[y == 0], []
    pure = others.sum(axis=0) <= (1 - purity) * x.sum(axis=0)
    marked = np.zeros(len(ones), dtype=int)
    while len(chosen) < most:
        gain = np.where(pure, ones[marked < times].sum(axis=0), 0)
        gain[chosen] = 0
        if not len(gain) or gain.max() < 2:
            break
        chosen.append(int(gain.argmax()))
        marked += ones[:, chosen[-1]]
    return chosen


class Toxicity:
    """A weight for each known word or word beginning, lexicon (:en) and pattern (:masked), and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}
        self.beginnings = {p[: p.rindex("-") + 1] for p in weights if "-" in p}
        self.lexicon: dict[str, list[str]] = {}
        for name, words in LEXICONS.items():
            if weights.get(f":{name}"):
                for w in words.split():
                    self.lexicon.setdefault(w, []).append(f":{name}")
        self.patterns = [(f":{name}", p) for name, p in _COMPILED.items() if weights.get(f":{name}")]

    def score(self, text: bytes) -> float:
        known, own, counts = self.known, set(), Counter()
        words = words_of(text)
        for w, k in words.items():
            hit = known.get(w)
            if hit is None:
                if len(known) > 300_000:
                    known.clear()
                whole = (*([w] if w in self.weights else []), *self.lexicon.get(w, ()))
                hit = known[w] = (whole, tuple(p for p in beginnings_of(w) if p in self.beginnings))
            if hit[0]:
                own.update(hit[0])
            for p in hit[1]:
                counts[p] += k
        if counts:
            own.update(p for p in (*counts, *repeated(counts, words.total())) if p in self.weights)
        if self.patterns:
            whole = text.decode("utf-8", "replace")
            own.update(name for name, p in self.patterns if p.search(whole))
        total = self.bias + sum(self.weights[p] for p in sorted(own))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, sample: int = 16_000, share: float = 0.005, voters: int = 200, anchor: int = 1_000
) -> Toxicity:
    """Voters from at most `sample` labelled rows outside fold 0, the label model on their votes, of which the first
    `anchor` rows show their label, and the classifier on the posterior labels. Counts, and hits of all parts that three rows and `share`
    of the rows with label 1 have, come to the driver. At most `voters` parts vote, those first that mark what the others don't."""
    ship(docs.sparkSession)
    chosen = labelled_sample(labels, label, sample, folds)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))
    parts = candidates(texts, 3, share)
    y, x, fixed = sample_hits(texts, parts)
    names = [f":{name}" for name in (*LEXICONS, *PATTERNS)]
    if not len(y) or not (y == 1).any():
        return Toxicity({f":{name}": 4.5 for name in LEXICONS}, -2.3)
    mixed = np.random.default_rng(5).permutation(len(y))  # the anchor is no range of ids
    y, x, fixed = y[mixed], x[mixed], fixed[mixed]
    induced = cover(y, x, voters, purity=0.8)
    votes = np.column_stack([fixed, x[:, induced]]).astype(np.float64)
    votes = votes[:, votes.any(axis=0)]
    if not votes.shape[1]:
        return Toxicity({f":{name}": 4.5 for name in LEXICONS}, -2.3)
    post = LabelModel(votes, y[:anchor]).posterior(votes)
    # features that the posterior labels set apart
    hits = np.column_stack([x, fixed])
    ones, rows = post @ hits, hits.sum(axis=0)
    useful = np.flatnonzero((ones >= 0.7 * rows) & (rows > 0))
    beta = soft_logistic(hits[:, useful].astype(np.float64), post, ridge=0.05)
    named, bias = [*parts, *names], float(beta[-1])
    weights = {named[j]: float(b) for j, b in zip(useful, beta, strict=False) if b}
    return Toxicity({f":{name}": 1.0 - bias for i, name in enumerate(LEXICONS) if not fixed[:, i].any()} | weights, bias)


def score_toxicity(docs: DataFrame, model: Toxicity, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Toxicity(*shared.value)
        for batch in batches:
            found = [own.score(t) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(fold("doc_id", folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
