"""Toxicity by weak supervision: many voters, a generative model of their accuracies and correlations, a linear classifier.

1. Voters. A list of general insults and threats, and words and word beginnings whose share of toxic texts is far above
   that of clean ones among labelled texts, make up lexicons; each learned entry belongs to one of several voters. Further
   voters look for patterns: an insult addressed to someone, several hits in one text, hits packed closely, shouting, runs
   of exclamation marks. One pass over all texts leaves a row of votes and counted hits for each.
2. Label model. How often each combination of votes occurs, over all texts, is all it needs: P(toxic) and, for each
   class, how often each voter votes, given one other voter where the two are correlated within the classes (a forest of
   greatest conditional mutual information). EM fits it to all texts, those of known label in their own class.
3. Classifier. Logistic regression on counted hits and patterns, fitted to the model's posteriors, scores every text.

What is bounded, by parameters: the labelled texts for the lexicon (examples for each class, by a hash of doc_id), its
entries, and the texts that the classifier is fitted to. Near copies of one text among the examples count once, so the
words of a much copied text do not become a lexicon. Labels come from rows with crc32(doc_id) mod 3 other than 1 alone.
Scores see the text only.

Defined results: null texts count as empty; rows repeat as they come; rows without a doc_id are scored, not held out, and
have no label; without labels of both classes only the fixed lexicon and patterns vote.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import slices, utf8, words
from .common import written
from .neardup import describe

#: General English insults, and words that address someone.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "clowns", "jerk", "fool", "imbecile", "coward", "liar", "filth", "vermin", "cretin", "imbeciles")
ADDRESSES = ("you", "your", "you're", "youre", "u", "ur", "he's", "she's", "they're", "are", "is", "these", "those", "such")

GROUPS = 6
_PATTERNS = ("fixed", "addressed", "several", "dense", "shouting", "exclaiming")
VOTERS = (*(f"lexicon {g}" for g in range(GROUPS)), *_PATTERNS)
_EXCLAIM, _BATCH_BYTES, _PREFIXES = 33, 4 << 20, (4, 5, 6)
_STRIP = " \t\n.,;:!?\"'()[]{}|*#_-~<>"


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labels that may be learned from."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return rows.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))


def _examples(docs: DataFrame, labels: DataFrame, each: int) -> DataFrame:
    """toxic, text: at most so many texts of each class, near copies once."""
    picked = None
    for toxic in (0, 1):
        rows = labels.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        picked = rows if picked is None else picked.unionByName(rows)
    picked = F.broadcast(picked.distinct())  # no more than twice each rows
    texts = written(docs.select("doc_id", "text").join(picked, "doc_id"), "examples")
    kinds = describe(texts).select("doc_id", F.xxhash64(F.substring("sig", 1, 4)).alias("kind")).distinct()
    return texts.join(kinds, "doc_id").filter("kind is not null").dropDuplicates(["toxic", "kind"]).select("toxic", "text")


def learned_lexicon(examples: DataFrame, size: int, ratio: float = 20.0, least: int = 5, part: int = 100) -> list[str]:
    """Words, and beginnings of words ("stem*"), of at least so many toxic texts and one part of them, whose share of these is ratio times that of clean ones; commonest first.

    Of beginnings that pass, only the shortest counts.
    """
    kinds = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        return []
    plain = F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.btrim(w, F.lit(_STRIP)))
    short = F.filter(F.array_distinct(plain), lambda w: (w != "") & (F.length(w) <= 64))
    own = F.transform(short, lambda w: F.array(w, *(F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in _PREFIXES)))
    rows = examples.select("toxic", F.explode(F.array_distinct(F.flatten(own))).alias("entry")).filter("entry is not null")
    counted = rows.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    lift = ((F.col("t") + 0.5) / (kinds[1] + 1)) / ((F.col("c") + 0.5) / (kinds[0] + 1))
    good = counted.filter((F.col("t") >= max(least, kinds[1] // part)) & (lift >= ratio))
    found = [r["entry"] for r in good.orderBy(F.desc("t"), "entry").limit(4 * size).collect()]
    stems = {e[:-1] for e in found if e.endswith("*")}

    def needed(entry: str) -> bool:
        body = entry.removesuffix("*")
        return not any(body[:n] in stems and (n < len(body) or not entry.endswith("*")) for n in _PREFIXES)

    return [e for e in found if needed(e)][:size]


@dataclass(frozen=True)
class Lexicon:
    """Entries and, for the fixed ones, no group."""

    learned: tuple[str, ...]

    def tables(self) -> tuple[dict[str, int], dict[str, int]]:
        whole = {e: i for i, e in enumerate(self.learned) if not e.endswith("*")}
        return whole, {e[:-1]: i for i, e in enumerate(self.learned) if e.endswith("*")}


def evidence(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, votes (a bit for each voter), n_words, hits (entries of the lexicon, with how often), fixed hits and addressed hits of every text."""
    whole, stems = lexicon.tables()
    fixed, addresses = frozenset(INSULTS), frozenset(ADDRESSES)

    def look(word: bytes) -> tuple[int, bool, bool]:
        body = word.decode("utf-8", "replace").lower().strip(_STRIP)
        entry = whole.get(body, -1)
        for n in _PREFIXES:
            if entry < 0 and len(body) >= n:
                entry = stems.get(body[:n], -1)
        return entry, body in fixed, body in addresses

    def counted(owner: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, minlength=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, bool, bool]] = {}
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in slices(offsets, _BATCH_BYTES):
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                n = high - low
                codes, bounds, distinct = words(part, at)
                if len(known) > 200_000:
                    known.clear()
                looked = [known[w] if w in known else known.setdefault(w, look(w)) for w in distinct]
                table = np.array(looked, np.int64).reshape(-1, 3)[codes] if len(codes) else np.zeros((0, 3), np.int64)
                owner = np.repeat(np.arange(n), np.diff(bounds))
                bad = (table[:, 0] >= 0) | (table[:, 1] > 0)
                before = np.zeros(len(bad), bool)
                before[1:] = (table[:-1, 2] > 0) & (owner[1:] == owner[:-1])
                before[2:] |= (table[:-2, 2] > 0) & (owner[2:] == owner[:-2])
                texts = np.repeat(np.arange(n), np.diff(at))
                upper, letters = (part >= 65) & (part <= 90), ((part | 32) >= 97) & ((part | 32) <= 122)
                runs = np.zeros(len(part), bool)
                runs[1:] = (part[1:] == _EXCLAIM) & (part[:-1] == _EXCLAIM) & (texts[1:] == texts[:-1])
                n_words, n_bad, n_fixed = np.diff(bounds), counted(owner[bad], n), counted(owner[table[:, 1] > 0], n)
                n_addressed, n_upper, n_letters, n_runs = counted(owner[bad & before], n), counted(texts[upper], n), counted(texts[letters], n), counted(texts[runs], n)
                votes = np.zeros(n, np.int64)
                hit = np.flatnonzero(table[:, 0] >= 0)
                np.bitwise_or.at(votes, owner[hit], 1 << (table[hit, 0] % GROUPS))
                several = (n_fixed > 0, n_addressed > 0, n_bad > 1, 100 * n_bad >= np.maximum(n_words, 1), (n_letters >= 20) & (2 * n_upper > n_letters), n_runs > 2)
                for k, vote in enumerate(several):
                    votes |= vote.astype(np.int64) << (GROUPS + k)
                # entries of each text, and how often each occurs
                pairs, times = np.unique(owner[hit] * (len(lexicon.learned) + 1) + table[hit, 0], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(n + 1) * (len(lexicon.learned) + 1)).astype(np.int32)
                entries, times = (pa.ListArray.from_arrays(pa.array(ends), pa.array(v, pa.int32())) for v in (pairs % (len(lexicon.learned) + 1), times))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), pa.array(votes), pa.array(n_words, pa.int64()), entries, times, pa.array(n_fixed, pa.int64()), pa.array(n_addressed, pa.int64())], ["doc_id", "votes", "n_words", "entries", "times", "n_fixed", "n_addressed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes long, n_words long, entries array<int>, times array<int>, n_fixed long, n_addressed long")


@dataclass
class LabelModel:
    """P(toxic), the forest of voters (parent of each, or -1, in an order where parents come first) and P(vote | class, parent's vote)."""

    prior: float
    order: list[int]
    parent: list[int]
    rate: np.ndarray  # voter, class, parent's vote
    correlation: np.ndarray  # voter, voter: within the classes, by the posteriors
    accuracy: np.ndarray  # voter: how often its vote, or silence, agrees with the class

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of rows of votes (bool)."""
        log = np.log([[1 - self.prior], [self.prior]]) + np.zeros((2, len(votes)))
        for v in self.order:
            given = votes[:, self.parent[v]].astype(int) if self.parent[v] >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                p = self.rate[v, y][given]
                log[y] += np.log(np.where(votes[:, v], p, 1 - p))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _forest(weight: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """The heaviest forest over pairs of at least that weight: an order with parents first, and the parents."""
    n, parent, tree = len(weight), [-1] * len(weight), list(range(len(weight)))
    near: list[list[int]] = [[] for _ in range(n)]
    for _, i, j in sorted(((-weight[i, j], i, j) for i, j in itertools.combinations(range(n), 2) if weight[i, j] >= least)):
        if tree[i] != tree[j]:
            old = tree[j]
            tree = [tree[i] if t == old else t for t in tree]
            near[i].append(j)
            near[j].append(i)
    order, seen = [], [False] * n
    for root in range(n):
        stack = [] if seen[root] else [root]
        while stack:
            v = stack.pop()
            seen[v] = True
            order.append(v)
            for u in near[v]:
                if not seen[u]:
                    parent[u] = v
                    stack.append(u)
    return order, parent


def fit_label_model(votes: np.ndarray, unknown: np.ndarray, known: np.ndarray, rounds: int = 30, smooth: float = 1.0, least: float = 1e-3) -> LabelModel:
    """Distinct rows of votes with how many texts of unknown label and of each known label (columns 0, 1) have them.

    Without known labels of both classes the first guess is that two voters or more mean toxic.
    """
    n_voters = votes.shape[1]
    guess = (votes[:, :GROUPS].sum(1) + votes[:, GROUPS : GROUPS + 4].sum(1) >= 2).astype(float)
    clamped = known.sum(0).min() > 0
    mass = known.astype(float) if clamped else np.stack([(1 - guess) * unknown, guess * unknown], 1)
    model = None
    order, parent = list(range(n_voters)), [-1] * n_voters
    for step in range(rounds):
        if step:
            p = model.posterior(votes)
            mass = known + np.stack([(1 - p) * unknown, p * unknown], 1)
        total = mass.sum(0)
        if step in (0, rounds // 2):
            order, parent = _forest(_information(votes, mass), least)
        rate = np.zeros((n_voters, 2, 2))
        for v in range(n_voters):
            for y in (0, 1):
                given = votes[:, parent[v]] if parent[v] >= 0 else np.zeros(len(votes), bool)
                for g in (0, 1):
                    here = mass[:, y] * (given == bool(g))
                    back = (mass[:, y] @ votes[:, v] + smooth * 0.5) / (total[y] + smooth)  # what little is seen of a case leans on the class's rate
                    rate[v, y, g] = (here @ votes[:, v] + smooth * back) / (here.sum() + smooth)
        model = LabelModel(float((total[1] + 1) / (total.sum() + 2)), order, parent, np.clip(rate, 1e-6, 1 - 1e-6), np.zeros((n_voters, n_voters)), np.zeros(n_voters))
    p = model.posterior(votes)
    mass = known + np.stack([(1 - p) * unknown, p * unknown], 1)
    model.correlation = _correlation(votes, mass)
    model.accuracy = (mass[:, 1] @ votes + mass[:, 0] @ ~votes) / max(mass.sum(), 1e-9)
    return model


def _joint(votes: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(voter i and j vote | class), P(voter votes | class)."""
    share = mass / np.maximum(mass.sum(0), 1e-9)
    both = np.einsum("py,pi,pj->yij", share, votes.astype(float), votes.astype(float))
    return both, np.einsum("yii->yi", both).copy()


def _information(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Mutual information of each pair of voters within the classes."""
    both, one = _joint(votes, mass)
    weight = mass.sum(0) / max(mass.sum(), 1e-9)
    out = np.zeros(both.shape[1:])
    for y in (0, 1):
        a, b = one[y][:, None], one[y][None, :]
        for cell, x, z in ((both[y], a, b), (a - both[y], a, 1 - b), (b - both[y], 1 - a, b), (1 - a - b + both[y], 1 - a, 1 - b)):
            cell = np.maximum(cell, 0)
            out += weight[y] * np.where(cell > 1e-12, cell * np.log(np.maximum(cell, 1e-12) / np.maximum(x * z, 1e-12)), 0)
    return out


def _correlation(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    both, one = _joint(votes, mass)
    weight = mass.sum(0) / max(mass.sum(), 1e-9)
    spread = np.sqrt(np.einsum("y,yi->i", weight, one * (1 - one)))
    return np.einsum("y,yij->ij", weight, both - one[:, :, None] * one[:, None, :]) / np.maximum(np.outer(spread, spread), 1e-9)


def features(batch: pa.RecordBatch, n_entries: int) -> np.ndarray:
    """Logarithms of counts of each entry, of all hits, fixed hits and addressed hits, hits by words, and shouting and exclaiming."""
    out = np.zeros((batch.num_rows, n_entries + 6), np.float32)
    entries, times = batch.column("entries"), batch.column("times")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(entries.offsets)))
    times = times.flatten().to_numpy()
    out[rows, entries.flatten().to_numpy()] = np.log1p(times)
    n_words, n_fixed, n_addressed, votes = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_words", "n_fixed", "n_addressed", "votes"))
    hits = np.bincount(rows, times, batch.num_rows) + n_fixed
    out[:, n_entries] = np.log1p(hits)
    out[:, n_entries + 1] = hits > 0
    out[:, n_entries + 2] = np.log1p(n_addressed)
    out[:, n_entries + 3] = np.minimum(10 * hits / np.maximum(n_words, 1), 1)
    for k, name in enumerate(("shouting", "exclaiming")):
        out[:, n_entries + 4 + k] = votes.astype(np.int64) >> VOTERS.index(name) & 1
    return out


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft labels, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = weight / max(weight.sum(), 1e-9)
    step = 1 / (0.25 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + ridge)
    at = before = np.zeros(x.shape[1])
    for k in range(rounds):
        ahead = at + k / (k + 3) * (at - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -60, 60)))
        slope = x.T @ (weight * (p - target)) + ridge * np.append(ahead[:-1], 0)
        before, at = at, ahead - step * slope
    return at


def _table(df: DataFrame) -> pa.RecordBatch:
    table = df.toArrow().combine_chunks()
    batches = table.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], schema=table.schema)


@dataclass
class Detector:
    """A fitted lexicon, label model and classifier."""

    lexicon: Lexicon
    model: LabelModel
    weights: np.ndarray

    def voters(self) -> list[tuple[str, float, str | None, float]]:
        """Each voter's name, accuracy, the voter it is taken to depend on, and their correlation within the classes."""
        m = self.model
        return [(VOTERS[v], float(m.accuracy[v]), VOTERS[m.parent[v]] if m.parent[v] >= 0 else None, float(m.correlation[v, m.parent[v]]) if m.parent[v] >= 0 else 0.0) for v in range(len(VOTERS))]


def vote_rows(patterns: Sequence[int]) -> np.ndarray:
    return (np.array(patterns, np.int64)[:, None] >> np.arange(len(VOTERS)) & 1).astype(bool)


def fit_detector(docs: DataFrame, labels: DataFrame, *, examples: int = 6000, entries: int = 256, fitted: int = 8000) -> tuple[Detector, DataFrame]:
    """A detector, and the evidence table of all docs (doc_id, text) that it was fitted to."""
    train = training_labels(labels)
    lexicon = Lexicon(tuple(learned_lexicon(written(_examples(docs, train, examples), "kinds"), entries)))
    table = written(evidence(docs, lexicon), "evidence")
    # texts of known label, by votes; the others by what is left
    known = table.select("doc_id", "votes").join(train.hint("merge"), "doc_id").groupBy("votes").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    every = table.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    rows = every.join(known, "votes", "left").select("votes", "n", F.coalesce("clean", F.lit(0)).alias("clean"), F.coalesce("toxic", F.lit(0)).alias("toxic")).orderBy("votes").collect()
    known_ = np.array([[r["clean"], r["toxic"]] for r in rows], float).reshape(-1, 2)
    patterns = [r["votes"] for r in rows]
    votes = vote_rows(patterns).reshape(-1, len(VOTERS))
    model = fit_label_model(votes, np.maximum(np.array([r["n"] for r in rows], float) - known_.sum(1), 0), known_)
    # of each class, by the posteriors, so many texts outside the held-out part, weighed to stand for all of it
    sides = model.posterior(votes) >= 0.5 if len(votes) else np.zeros(0, bool)
    toxic = [p for p, s in zip(patterns, sides, strict=True) if s]
    parts, posterior, weight = [], [], []
    for rows_ in (table.filter(F.col("votes").isin(toxic)), table.filter(~F.col("votes").isin(toxic))):
        part = _table(rows_.filter(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "votes").limit(fitted))
        if part.num_rows:
            parts.append(features(part, len(lexicon.learned)))
            posterior.append(model.posterior(vote_rows(part.column("votes").to_pylist())))
            weight.append(np.full(part.num_rows, 1 / part.num_rows))
    if not parts:
        return Detector(lexicon, model, np.zeros(len(lexicon.learned) + 7)), table
    return Detector(lexicon, model, fit_logistic(np.vstack(parts), np.concatenate(posterior), np.concatenate(weight))), table


def scored(table: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, score of each row of an evidence table."""
    weights, n_entries = detector.weights, len(detector.lexicon.learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(features(batch, n_entries) @ weights[:-1] + weights[-1], -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double")


def toxicity_report(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    detector, table = fit_detector(docs, labels, **bounds)
    return scored(table, detector).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
