"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters say toxic or nothing of a text. They are: one lexicon of common insults for each
of four languages; terms found in labelled rows; patterns (some term at all, several different
ones, terms in one of a hundred words, an insult near a form of address, terms in capitals).
A term is a word or a beginning of 3 to 7
letters, either present at all or dense: in one of a hundred words. All words and beginnings
are counted and tested on the cluster, by a binomial bound on the share of toxic texts,
corrected for the number of terms tried. Of terms that begin with one another only the one
with the strongest evidence votes, so that a word and its beginnings are one voter.

The label model treats a text's class as hidden: from the voters' agreement alone it estimates,
by expectation-maximisation, how often each voter speaks in either class and how the voters
are correlated within a class, and counts a voter the less the more others repeat it; a voter for
toxic can not come to speak for clean. A text's label is no voter, so the posterior may differ from
it. The posteriors are the targets of a logistic regression over the terms and patterns, which
scores every whole text.

Labels, from rows that are not held out only, serve to find terms and to set the classes'
shares; MAX_TRAIN rows at most are used, chosen by a hash of the id, and equal texts once. The driver holds the features
of those rows as lists, and pairs of features that one of them has.

Defined results: null and empty texts have no term and get the score of such texts. Without
usable labels the lexicons and patterns alone vote. Rows of equal id are scored each, equal
texts alike. Very long texts are read whole, once; patterns look at words and the few before
each, so the time is linear. Terms of equal evidence are taken longest first, then by
alphabet. An empty table gives an empty result. Only id and text are used, so other columns
cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnwise.llm.labelled import held_out, training_sample
from turnwise.llm.text import release_memory, text_slices, whole_text
from turnwise.session import materialise, scratch

MAX_TRAIN = 10_000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6, 7)
#: A term is dense in a text if one of so many words has it.
DENSE = 100
#: Part of the way from the share of toxic texts to the strongest term's that a term has to come.
PURE = 0.75
#: Correlation from which a voter repeats another; the weak ties of one to many others are none.
REPEATS = 0.5
#: Words before an insult that are searched for a form of address.
NEAR = 5

# Common insults.
LEXICONS = {
    "en": ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "bastard", "imbecile", "dumbass", "asshole", "bitch", "retard", "vermin"),
    "de": ("arschloch", "dummkopf", "abschaum", "trottel", "schwachkopf", "missgeburt", "vollidiot", "wichser", "drecksau"),
    "fr": ("connard", "salaud", "imbécile", "crétin", "abruti", "ordure", "enfoiré", "minable", "débile"),
    "es": ("imbécil", "estúpido", "idiota", "basura", "cabrón", "gilipollas", "asqueroso", "escoria", "payaso"),
}
# Forms of address.
ADDRESS = frozenset(("you", "your", "yours", "re", "du", "dein", "ihr", "tu", "toi", "vous", "usted", "eres"))

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> tuple[list[str], list[str]]:
    """The words as written, and lower-cased."""
    words = _WORD.findall(text)
    return words, "\n".join(words).lower().split("\n") if words else []


def terms_of(text: str) -> tuple[list[str], list[str]]:
    """Words and beginnings (marked by a last '-') that the text has, and those that are dense in it."""
    _, words = words_of(text)
    found: Counter = Counter()
    for w, times in Counter(words).items():
        found[w] += times
        for n in PREFIXES:
            if len(w) > n:
                found[f"{w[:n]}-"] += times
    return list(found), [t for t, times in found.items() if times * DENSE >= len(words)]


class Finder:
    """Feature ids of a text: terms first, then lexicons, then patterns. A term that ends in '+' has to be dense."""

    def __init__(self, terms: list[str]) -> None:
        self.n = len(terms)
        self.dense = [t.endswith("+") for t in terms]
        self.at = {t.removesuffix("+"): i for i, t in enumerate(terms)}
        self.lexicons = [frozenset(words) for words in LEXICONS.values()]
        self.roots = {t[: PREFIXES[0]].rstrip("-") for t in (*self.at, *(w for words in LEXICONS.values() for w in words))}
        self.several = self.n + len(self.lexicons)
        self.size = self.several + 5

    def _own(self, w: str) -> list[int]:
        at = self.at
        own = [at[k] for k in (w, *(f"{w[:n]}-" for n in PREFIXES if len(w) > n)) if k in at]
        return own + [self.n + i for i, lexicon in enumerate(self.lexicons) if w in lexicon]

    def __call__(self, text: str) -> list[int]:
        words, lows = words_of(text)
        roots = self.roots
        near = [(i, w) for i, w in enumerate(lows) if w[:3] in roots]
        if not near:
            return []
        known = {w: self._own(w) for w in {w for _, w in near}}
        hits = [(i, w) for i, w in near if known[w]]
        times = Counter(x for _, w in hits for x in known[w])
        found = {x for x, k in times.items() if x >= self.n or not self.dense[x] or k * DENSE >= len(lows)}
        # Occurrences of terms that have to be dense and are not count for nothing.
        hits = [(i, w) for i, w in hits if not found.isdisjoint(known[w])]
        if not hits:
            return []
        found.add(self.several)
        if len({w for _, w in hits}) > 1:
            found.add(self.several + 1)
        if len(hits) * DENSE >= len(lows):
            found.add(self.several + 2)
        if any(not ADDRESS.isdisjoint(lows[max(0, i - NEAR) : i]) for i, _ in hits):
            found.add(self.several + 3)
        if any(len(words[i]) > 1 and words[i].isupper() for i, _ in hits):
            found.add(self.several + 4)
        return sorted(found)


class Sparse:
    """Rows of feature ids as a matrix of zeros and ones."""

    def __init__(self, rows: list[list[int]], size: int) -> None:
        self.n, self.size = len(rows), size
        sizes = np.array([len(r) for r in rows], np.int64)
        self.ids = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
        self.owner = np.repeat(np.arange(self.n), sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.ids], self.n)

    def transposed_dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, v[self.owner], self.size)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, Sparse]:
        """The pairs of features that share a row as (lower, higher), and the rows as lists of pairs."""
        found: dict[int, int] = {}
        rows: list[list[int]] = []
        for own in np.split(self.ids, np.flatnonzero(np.diff(self.owner)) + 1) if len(self.ids) else []:
            own = np.sort(own)
            i, j = np.triu_indices(len(own), 1)
            rows.append([found.setdefault(k, len(found)) for k in (own[i] * self.size + own[j]).tolist()])
        keys = np.fromiter(found, np.int64, len(found))
        out = Sparse(rows, len(found))
        # Rows without features have no pairs and no place in the list above.
        out.n, out.owner = self.n, np.unique(self.owner)[out.owner] if len(out.owner) else out.owner
        return keys // self.size, keys % self.size, out


@dataclass
class LabelModel:
    """How often each voter speaks in the clean and the toxic class, and what it counts beside correlated ones.

    Each voter says toxic or nothing. The silence of some counts as well, by the same rates; that of
    others tells nothing, as that of a term, which most toxic texts of its own language lack as well.
    """

    share: float
    silence: np.ndarray
    rates: np.ndarray = field(default_factory=lambda: np.empty((0, 2)))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))

    def posterior(self, votes: Sparse) -> np.ndarray:
        """P(toxic) of each row of voters that speak."""
        speaks = np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])
        silent = np.where(self.silence, np.log1p(-self.rates[:, 1]) - np.log1p(-self.rates[:, 0]), 0)
        total = np.log(self.share / (1 - self.share)) + (self.weight * silent).sum() + votes.dot(self.weight * (speaks - silent))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))

    def fit(self, votes: Sparse, rounds: int = 25) -> LabelModel:
        """Estimates from the votes alone; at first a row is toxic if any voter speaks."""
        p = np.where(votes.dot(np.ones(votes.size)) > 0, 0.95, 0.05)
        self.weight = np.ones(votes.size)
        pairs = votes.pairs()
        for _ in range(rounds):
            w = np.stack([1 - p, p])
            rates = np.stack([(votes.transposed_dot(x) + 0.01) / (x.sum() + 0.12) for x in w], 1)
            # Voters are what they were made to be: none speaks more in the clean class.
            rates[:, 1] = np.maximum(rates[:, 1], rates[:, 0])
            self.rates = np.clip(rates, 1e-6, 1 - 1e-6)
            self.weight = 1 / self._repeats(votes, pairs, w)
            p = self.posterior(votes)
        return self

    def _repeats(self, votes: Sparse, pairs: tuple, weights: np.ndarray) -> np.ndarray:
        """For each voter 1 plus its squared correlations with those that repeat it, given the class."""
        low, high, rows = pairs
        most = np.zeros(len(low))
        for w in weights:
            w = w / max(w.sum(), 1e-9)
            mean = votes.transposed_dot(w)
            sd = np.sqrt(np.clip(mean * (1 - mean), 1e-6, None))
            cov = rows.transposed_dot(w) - mean[low] * mean[high]
            tied = np.clip(cov / (sd[low] * sd[high]), 0, 1)
            most = np.maximum(most, np.where(tied >= REPEATS, tied, 0) ** 2)
        return 1 + np.bincount(low, most, votes.size) + np.bincount(high, most, votes.size)


def fit_logistic(x: Sparse, y: np.ndarray, l2: float = 0.01, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias: Newton steps on soft labels, each solved by conjugate gradients, so that no square matrix is held."""
    w, ridge = np.zeros(x.size + 1), np.full(x.size + 1, l2 * 10)
    ridge[-1] = 1e-6
    dot = lambda v: x.dot(v[:-1]) + v[-1]
    back = lambda v: np.append(x.transposed_dot(v), v.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(dot(w), -30, 30)))
        curve = p * (1 - p) + 1e-9
        left = back(y - p) - ridge * w
        scale = 1 / (back(curve) + ridge)
        step, rest = np.zeros_like(w), left
        z = scale * rest
        way, size = z, rest @ z
        for _ in range(200):
            if size < 1e-16:
                break
            bent = back(curve * dot(way)) + ridge * way
            far = size / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            z = scale * rest
            way, size = z + (rest @ z) / size * way, rest @ z
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    label_model: LabelModel | None = None

    def score(self, found: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.weights[found].sum() + self.weights[-1]))))


def _evidence(t: Column, c: Column, share: Column) -> Column:
    """Minus the log of Chernoff's bound of the chance that t of t + c texts are toxic, at this share; 0 where there are no more than expected."""
    n = t + c
    q = t / n
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    return F.when(q > share, n * (q * F.log(q / share) + rest)).otherwise(0.0)


def find_terms(sample: DataFrame) -> list[str]:
    """Terms tied to label 1, strongest first; those that have to be dense end in '+'.

    Counts, tests and their correction are made on the cluster; only terms that pass come to
    the driver, each of which needs several toxic texts of the bounded sample for itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = tuple(Counter() for _ in range(4))

        def out() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([x[k] for k in keys], pa.int64()) for x in counts]], ["term", "t", "c", "td", "cd"])
            for x in counts:
                x.clear()
            return batch

        for batch in text_slices(batches, "text"):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found, dense = terms_of(text)
                counts[y <= 0].update(found)
                counts[y <= 0][""] += 1
                counts[2 + (y <= 0)].update(dense)
                if len(counts[0]) + len(counts[1]) > 100_000:
                    yield out()
        yield out()
        release_memory()

    counted = sample.select("text", "y").mapInArrow(count, "term string, t bigint, c bigint, td bigint, cd bigint").groupBy("term").agg(*[F.sum(x).alias(x) for x in ("t", "c", "td", "cd")])
    counted = materialise(counted.where("t >= 3"), "toxicity-terms")
    # The empty term stands for all texts: its counts give the share of toxic ones that a term has by chance.
    every = counted.agg(F.max(F.when(F.col("term") == "", F.col("t"))).alias("t"), F.max(F.when(F.col("term") == "", F.col("c"))).alias("c"), F.count("*").alias("tried")).first()
    if every["t"] is None:
        return []
    share = F.lit(min(0.9, max(1e-3, every["t"] / (every["t"] + every["c"]))))
    tiers = F.explode(F.array(F.struct(F.lit("").alias("mark"), F.col("t"), F.col("c")), F.struct(F.lit("+").alias("mark"), F.col("td").alias("t"), F.col("cd").alias("c")))).alias("x")
    tested = counted.where("term <> ''").select("term", tiers).where("x.t >= 3").select("term", F.col("x.mark").alias("mark"), (F.col("x.t") / (F.col("x.t") + F.col("x.c"))).alias("toxic"), _evidence(F.col("x.t"), F.col("x.c"), share).alias("evidence"))
    tested = tested.where(F.col("evidence") > float(np.log(10 * 2 * every["tried"])))
    # How toxic the texts of the strongest term are labelled tells how far labels can be trusted; others have to come near it.
    top = tested.agg(F.max_by("toxic", F.struct("evidence", "term", "mark"))).first()[0]
    passed = tested.where(F.col("toxic") >= share + PURE * (F.lit(top) - share)).collect()
    out: list[str] = []
    taken: set[str] = set()
    heads: set[str] = set()
    for r in sorted(passed, key=lambda r: (-r["evidence"], -len(r["term"]), r["term"], r["mark"])):
        stem = r["term"].rstrip("-")
        # Related are: the term itself, its beginnings, and what begins with it if it is a beginning.
        begins = {f"{stem[:n]}-" for n in PREFIXES if n < len(stem)}
        if not (begins | {r["term"]}) & taken and r["term"] not in heads:
            taken.add(r["term"])
            heads |= begins
            out.append(r["term"] + r["mark"])
    return out


def _found(rows: DataFrame, terms: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(terms)
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([find(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["id", "y", "found"])

    return rows.select("id", "y", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, y int, found array<int>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    with scratch(docs.sparkSession):
        # Copies of a text are one witness, or the words of a much copied text would all seem tied to its label.
        sample = training_sample(docs, labels, target, max_train, id_col, text_col).groupBy("text").agg(F.min("id").alias("id"), F.max("y").alias("y"))
        sample = materialise(sample, "toxicity-sample")
        terms = find_terms(sample)
        finder = Finder(terms)
        rows = _found(sample, terms).orderBy("id").collect()
    found, y = [r["found"] for r in rows], np.array([r["y"] for r in rows], float)
    share = min(0.5, max(0.01, y.mean())) if len(y) else 0.1
    if not len(y) or not any(found):
        # Nothing to learn from: the fixed lexicons and patterns speak for themselves.
        return Model(terms, np.append(np.full(finder.size, 4.0), -3.0))
    votes = Sparse(found, finder.size)
    model = LabelModel(share, np.arange(finder.size) >= finder.several).fit(votes)
    targets = model.posterior(votes)
    # Features that the sample lacks keep what a lexicon says by itself.
    absent = np.ones(finder.size, bool)
    absent[sorted(set().union(*found))] = False
    weights = fit_logistic(votes, targets)
    absent[finder.several :] = False
    weights[:-1][absent] = 4.0
    return Model(terms, weights, model)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model.terms)
        for batch in text_slices(batches, "text"):
            scores = np.array([model.score(find(t)) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not call toxic; all columns, whatever their names, and their order are kept."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), whole_text(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model.terms)
        for batch in text_slices(batches, "text"):
            keep = [model.score(find(t)) < threshold for t in batch.column("text").to_pylist()]
            yield batch.select(["doc"]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    return whole.mapInArrow(run, whole.select("doc").schema).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
