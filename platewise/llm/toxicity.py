"""Toxicity by weak supervision.

Many voters (word lists, patterns, word stems mined from labelled rows) say toxic, clean or nothing
about each text of a sample. A generative label model, fitted by EM, estimates how often each voter is
right and, in the same iterations, how the voters' errors go together: correlated voters count less
in the next step. Its posteriors are the labels of a logistic regression whose features are all words
of the lists, the mined stems and every voter's vote; that classifier scores every whole text. Its log
odds are scaled to the labels of the learning rows (two numbers), where both classes occur.

A stem is mined on one half of the learning rows and must mark the class on the other half too; copies
of a text lie in one half. What one text happens to say is thus no evidence. The word lists are general vocabulary, written
without any table at hand.

Fitting uses at most ``MAX_SAMPLE`` labelled rows (those with the least hash of the id), so all that
the driver sees of the corpus is bounded by that parameter times the length of a feature list.
Scoring is one pass over the texts without a shuffle.

Defined results: a null or empty text has no features but the quiet voters and is scored from them; a
row with a null id is scored and never held out; rows are scored alike whether or not repeated, and a
repeated id counts once in the fit (its greatest text); of several labels of an id the highest holds;
where no stem is mined (few labels, or one class only) the word lists and patterns alone vote and all
listed words share one weight; without a labelled row scores are 0; extra columns are ignored, and
:func:`judge` replaces columns named like its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import drop, keep, release, table

MAX_SAMPLE = 20_000
MAX_STEMS = 192
MIN_SUPPORT = 2  # texts in the half that proposes a stem
MIN_LIFT = 6.0
MIN_G2 = 7.0
MIN_PRECISION = 0.7  # in the half that confirms it
N_STEM_VOTERS = 12
MEMO = 100_000
FLUSH = 50_000  # counted features that a task holds

# General abusive vocabulary by theme.
LEXICON = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumber dumbass imbecile imbeciles cretin dimwit halfwit nitwit dunce blockhead airhead fool fools foolish brainless clueless"
    " dummkopf dumm blöd blödmann trottel depp idiota idiotas imbécil imbécile tonto tonta estúpido estúpida débile crétin abruti",
    "worth": "worthless loser losers pathetic useless pitiful failure incompetent nobody waste versager nutzlos wertlos erbärmlich inútil inútiles perdedor patético nul minable bon-à-rien",
    "filth": "scum scumbag trash garbage filth filthy vermin rat rats pig pigs swine dirtbag disgusting revolting gross abschaum drecksack dreck schwein ekelhaft widerlich basura escoria asqueroso asquerosa"
    " cerdo ordure dégoûtant porc saleté",
    "mockery": "clown clowns buffoon twit jerk jerks creep creeps freak freaks weirdo dork troll witzfigur payaso payasos bouffon guignol",
    "character": "liar liars coward cowards hypocrite hypocrites parasite traitor snake fraud lügner feigling heuchler verräter mentiroso mentirosa cobarde hipócrita menteur menteuse lâche hypocrite traître",
    "hostility": "hate hated hates hateful despise despicable loathe vile repulsive detest die kill hasse hassen verachte odio odias detesto despreciable déteste hais méprisable",
    "vulgar": "ass asses asshole assholes bastard bastards bitch bitches crap damn dick douche shit shitty bullshit fuck fucking fucker piss slut whore arschloch scheiße scheisse wichser hurensohn mierda cabrón"
    " puta puto pendejo gilipollas connard connasse salaud salope merde putain enculé",
}

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {
    "address": re.compile(r"\b(?:you(?:'re| are)?|du bist|tu es|eres) (?:such )?(?:an? |ein |un )?(?:idiot|moron|loser|clown|fool|liar|stupid|pathetic|worthless|disgusting)"),
    "command": re.compile(r"\b(?:shut up|get lost|go away|go to hell|drop dead|halt die klappe|ferme-la|cállate)\b"),
    "masked": re.compile(r"\b(?:st[u*@]p[i1*]d|[i1]d[i1][o0]t|m[o0*]r[o0*]n|f[u*@]ck|sh[i1*!]t|l[o0]ser)\b"),
    "shouting": re.compile(r"[!?]{3,}"),
}


def features_of_word(word: str) -> tuple[str, ...]:
    """A word and its stems of 4 and 5 letters."""
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Voters:
    """Votes 1 (toxic), -1 (clean) or 0 (nothing) of all voters on a text."""

    def __init__(self, stems: list[str]):
        self.lists = [frozenset(v.split()) for v in LEXICON.values()]
        self.groups = {s: i % N_STEM_VOTERS for i, s in enumerate(stems)}
        self.n_stems = min(len(stems), N_STEM_VOTERS)
        self.names = [*LEXICON, *(f"stems{i}" for i in range(self.n_stems)), *_PATTERNS, "quiet", "dense"]

    def __call__(self, text: str) -> list[int]:
        lower = text.lower()
        words = words_of(lower)
        return self.of(lower, words, {f for w in words for f in features_of_word(w)})

    def of(self, lower: str, words: set[str], feats: set[str]) -> list[int]:
        """The votes on a lower-cased text with these words and features of words."""
        lists = [int(not x.isdisjoint(words)) for x in self.lists]
        hit = {self.groups[f] for f in feats if f in self.groups}
        stems = [int(i in hit) for i in range(self.n_stems)]
        patterns = [int(bool(p.search(lower))) for p in _PATTERNS.values()]
        n = sum(lists) + sum(stems)
        return [*lists, *stems, *patterns, -1 if n == 0 else 0, 1 if n >= 3 else -1 if n == 0 else 0]


class LabelModel:
    """P(toxic | votes) from class-conditional vote tables, discounted for correlated voters.

    A voter whose errors go together with others' counts by one over the sum of those correlations;
    tables and correlations are estimated in turn.
    """

    def __init__(self, n_iter: int = 25, smooth: float = 1.0, tied: float = 0.3):
        self.n_iter, self.smooth, self.tied = n_iter, smooth, tied

    def fit(self, votes: np.ndarray) -> LabelModel:
        # at first voters that agree throughout share a vote
        centred = votes - votes.mean(0)
        scale = np.sqrt((centred**2).mean(0)) + 1e-9
        alike = np.clip(centred.T @ centred / len(votes) / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(alike, 0)
        first = 1 / (1 + alike.sum(1))
        for discounted in (True, False):  # of ties that leave one class only, none are counted
            q = 1 / (1 + np.exp(-1.5 * (votes * first).sum(1) / first.mean()))
            self.discount = np.sqrt(first) if discounted else np.ones(len(first))
            q = self._iterate(votes, q, discounted)
            if q.min() < 0.5 <= q.max():
                break
        self.accuracy = (1 - self.prior) * self.table[0, 0] + self.prior * self.table[1, 2]
        return self

    def _iterate(self, votes: np.ndarray, q: np.ndarray, discounted: bool) -> np.ndarray:
        onehot = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)  # value, row, voter
        for _ in range(self.n_iter):
            self.prior = float(np.clip(q.mean(), 0.01, 0.99))
            counts = np.stack([np.einsum("vrj,r->vj", onehot, p) for p in (1 - q, q)])
            self.table = (counts + self.smooth) / (counts + self.smooth).sum(1, keepdims=True)  # class, value, voter
            self.correlation = self._correlation(votes, q)
            ties = np.where(self.correlation > self.tied, self.correlation, 0)
            np.fill_diagonal(ties, 0)
            if discounted:
                self.discount = (self.discount + 1 / (1 + ties.sum(1))) / 2
            q = self.posterior(votes)
        return q

    def _correlation(self, votes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of what the voters say beyond what the class lets expect."""
        mean = np.einsum("cvj,v->cj", self.table, np.array([-1.0, 0, 1]))
        rest = votes - (np.outer(1 - q, mean[0]) + np.outer(q, mean[1]))
        scale = np.sqrt((rest**2).mean(0)) + 1e-9
        return (rest.T @ rest) / len(votes) / np.outer(scale, scale)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log_odds = np.log(self.table[1]) - np.log(self.table[0])  # value, voter
        by_vote = np.take_along_axis(log_odds, votes + 1, 0)
        z = math.log(self.prior / (1 - self.prior)) + (by_vote * self.discount).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scaling(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) that turn log odds into those of the labels; (1, 0) where a class is absent."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    # targets a little inside 0 and 1, so that separable classes have finite odds
    n1, n0 = int(y.sum()), int((1 - y).sum())
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, size = float(z.mean()), float(z.std()) or 1.0
    slope, shift = fit_logistic((z[:, None] - mean) / size, goal, ridge=1e-3, n_iter=50)
    return (float(slope / size), float(shift - slope * mean / size)) if slope > 0 else (1.0, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, n_iter: int = 12) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(n_iter):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """text and label of at most ``max_sample`` labelled rows that are not held out."""
    ids = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y"))

    @F.pandas_udf("int")
    def half(texts: pd.Series) -> pd.Series:
        # by the least hash of three words in a row, so that most copies, near ones too, lie in one half
        ws = [t.lower().split() for t in texts]
        return pd.Series([min((zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 2))), default=0) >> 7 & 1 for w in ws], dtype="int32")

    return rows.select("text", "y", half("text").alias("half"))


def mine(sample: DataFrame, n: int) -> list[str]:
    """The ``n`` words and stems that mark the rows with y = 1 most clearly, in both halves of the sample."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def rows():
            return pd.DataFrame([(f, *n) for f, n in seen.items()], columns=["f", "n00", "n01", "n10", "n11"])

        for pdf in batches:
            for text, y, half in zip(pdf.text, pdf.y, pdf.half):
                at = 2 * half + y
                for f in {f for w in words_of(text) for f in features_of_word(w)}:
                    n = seen.get(f)
                    if n is None:
                        n = seen[f] = [0, 0, 0, 0]
                    n[at] += 1
                if len(seen) >= FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()
        seen.clear()
        release()

    totals = {(r.half, r.y): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    found = sample.mapInPandas(count, "f string, n00 bigint, n01 bigint, n10 bigint, n11 bigint")
    found = found.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")])
    ways = []
    for h in (0, 1):
        all0, all1 = totals.get((h, 0), 0), totals.get((h, 1), 0)
        if not all0 or not all1:
            continue
        n0, n1, m0, m1 = (F.col(f"n{k}{y}") for k in (h, 1 - h) for y in (0, 1))
        lift = (n1 / all1) / ((n0 + 0.5) / all0)
        # significance: the log-likelihood ratio of a feature that marks the class
        g2 = F.when(n1 > 0, 2 * n1 * F.log(n1 * (all0 + all1) / ((n0 + n1) * all1))).otherwise(0.0)
        ways.append((n1 >= MIN_SUPPORT) & (lift >= MIN_LIFT) & (g2 >= MIN_G2) & (m1 >= 1) & (m1 >= MIN_PRECISION * (m0 + m1)))
    if not ways:
        return []
    both = found.where(reduce(lambda a, b: a | b, ways)).orderBy((F.col("n01") + F.col("n11") - F.col("n00") - F.col("n10")).desc(), "f").limit(n)
    return [r.f for r in both.collect()]


def feature_names(stems: list[str]) -> list[str]:
    """Mined stems, all words of the lists, and the voters."""
    lexicon = {w for v in LEXICON.values() for w in v.split()}
    return [*stems, *sorted(lexicon.difference(stems)), *(f"voter {v}" for v in Voters(stems).names)]


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> dict:
    """The classifier: features with their weights, and the intercept."""
    spark = docs.sparkSession
    sample, path = keep(learning_rows(docs, labels, max_sample), "toxicity")
    stems = mine(sample, MAX_STEMS)
    names = feature_names(stems)
    index = {f: i for i, f in enumerate(names)}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(stems)
        for pdf in batches:
            rows = []
            for text, y in zip(pdf.text, pdf.y):
                feats = sorted({index[f] for w in words_of(text) for f in features_of_word(w) if f in index})
                rows.append((voters(text), feats, y))
            yield pd.DataFrame(rows, columns=["votes", "feats", "y"])

    rows = sample.mapInPandas(read, "votes array<int>, feats array<int>, y int").collect()  # at most max_sample short rows
    drop(spark, path)
    if not rows:
        return {"stems": [], "weights": {}, "intercept": -30.0}
    votes = np.array([r.votes for r in rows], dtype=np.int64)
    model = LabelModel().fit(votes)
    goal = model.posterior(votes)
    n_words = len(names) - votes.shape[1]
    x = np.zeros((len(rows), len(names)), dtype=np.float64)
    for i, r in enumerate(rows):
        x[i, r.feats] = 1
    x[:, n_words:] = votes
    if stems:
        w = fit_logistic(x, goal)
    else:  # too few toxic rows for weights of single words: one weight for all
        one = fit_logistic(np.hstack([x[:, :n_words].sum(1, keepdims=True), x[:, n_words:]]), goal)
        w = np.concatenate([np.full(n_words, one[0]), one[1:]])
    z = x @ w[:-1] + w[-1]
    slope, shift = scaling(z, np.array([r.y for r in rows])) if stems else (1.0, 0.0)
    return {
        "stems": stems,
        "weights": {f: float(v) * slope for f, v in zip(names, w)},
        "intercept": float(w[-1]) * slope + shift,
        "accuracy": dict(zip(Voters(stems).names, model.accuracy.tolist())),
        "correlation": model.correlation,
    }


def score(text: str | Column, model: dict) -> Column:
    """P(toxic) of whole texts."""
    weights, intercept, stems = model["weights"], model["intercept"], model["stems"]

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[str, ...]] = {}
        voters = Voters(stems)
        of_voter = np.array([weights.get(f"voter {v}", 0.0) for v in voters.names])

        def known(word: str) -> tuple[str, ...]:
            got = memo.get(word)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                got = memo[word] = tuple(f for f in features_of_word(word) if f in weights)
            return got

        for s in batches:
            z = []
            for t in s:
                text = (t or "").lower()
                words = words_of(text)
                feats = {f for w in words for f in known(w)}
                votes = voters.of(text, words, feats)
                z.append(intercept + sum(weights[f] for f in sorted(feats)) + float(of_voter @ votes))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30))))

    return run(F.col(text) if isinstance(text, str) else text)


def judge(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score and predicted, which replace columns of these names."""
    return docs.withColumn("score", score("text", model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
