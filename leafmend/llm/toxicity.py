"""Toxicity by weak supervision.

Voters: each word of a fixed lexicon, patterns, and tallies of signs. Signs
(words, and beginnings of words, which stand for inflected forms) are mined
from labelled training documents in folds, and a document's tallies come from
the labels of the other folds alone, so no voter has seen the label of a
document that it votes on. A generative label model with a hidden true label
estimates each voter's rates from agreement by expectation maximization,
measures which voters err together and weakens them; of the given labels it
knows the share of toxic ones, no row's own. A linear classifier on the signs is trained on its posteriors. Only the
classifier scores documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept

#: Bounds of the fit: labelled documents, signs.
SAMPLE, SIGNS = 20_000, 3_000
#: Toxic documents of a sign, and how much likelier it is in toxic documents (log of the ratio), at least.
SUPPORT, LIFT = 4, 1.8
#: Folds of the tallies; what a wrong vote of a tally costs against a right one, when its threshold is set on the other folds.
FOLDS, COST = 5, 3.0
#: Correlations of voters' errors below this are taken for chance.
CHANCE = 0.1
#: Correlation of votes from which one voter is taken for another's copy before anything is known of the classes.
COPY = 0.85
#: Votes from which a voter's correlations are believed.
RARE = 20
#: How likely a row with a single vote is at first: a voter is taken to be right rather than wrong.
ALONE = 0.75
#: Insults, each a voter by itself.
LEXICON = """idiot idiots idiotic moron morons moronic stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown
imbecile fool jerk creep pig vermin filth ugly hate kill shut bastard damn crap sucks
dummkopf trottel abschaum arschloch idioten widerlich drecksack versager
imbécile idiote crétin ordure salaud dégoûtant abruti pourriture
idiota imbécil estúpido basura asqueroso patético escoria inútil""".split()
#: Someone called by an insult, in English, German, French and Spanish; threats and wishes of harm.
_YOU = re.compile(
    r"(?i)\b(?:(?:you|u|they|he|she)(?:'re| are| r| is| all are)\s+(?:\w+\s+){0,2}(?:idiots?|morons?|stupid|dumb|losers?|scum|trash|pathetic|worthless|disgusting|clowns?)"
    r"|(?:du bist|ihr seid|sie sind|er ist)\s+(?:\w+\s+){0,2}(?:dumm|idiot(?:en)?|dummkopf|trottel|abschaum|versager|widerlich|drecksack)"
    r"|(?:tu es|vous êtes|ils sont|il est|elle est)\s+(?:\w+\s+){0,2}(?:stupides?|idiote?s?|imbéciles?|crétins?|nuls?|ordures?|abrutis?|dégoûtants?)"
    r"|(?:eres|sois|son|es)\s+(?:\w+\s+){0,2}(?:idiotas?|imbéciles?|estúpid[oa]s?|basura|escoria|inútil(?:es)?|asqueros[oa]s?|patétic[oa]s?))\b"
)
_THREAT = re.compile(
    r"(?i)\b(?:(?:i(?:'ll| will)|we(?:'ll| will)|i'm going to)\s+(?:kill|hurt|beat|destroy)\s+(?:you|him|her|them)|(?:go|just)\s+(?:die|kill yourself)|kill yourself|shut (?:the \w+ )?up"
    r"|ich (?:bringe dich um|mach dich fertig)|halt(?:'s| die) (?:maul|klappe)|je vais te (?:tuer|frapper)|ferme ta gueule|va te faire|te voy a (?:matar|pegar)|cállate|vete a la)\b"
)
_STRIP = ".,;:!?\"'()[]{}<>«»“”„…-_*#$%&|/\\"


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))) % 5 == 0


def candidates(text: str | None) -> set[str]:
    """What may be a sign: lower-case words, '=' before them, and their first 4, 5 and 6 letters."""
    out = set()
    for w in set((text or "").lower().split()):
        w = w.strip(_STRIP)
        if len(w) > 2:
            out.add("=" + w)
            for k in (4, 5, 6):
                if len(w) >= k:
                    out.add(w[:k])
    return out


@dataclass
class Model:
    """signs, their weights, those of the lexicon and the patterns after them, the bias, and the voters' rates by class."""

    signs: list[str]
    weights: np.ndarray
    bias: float
    rates: np.ndarray

    def scorer(self):
        at = dict(zip(self.signs, self.weights[: len(self.signs)].tolist(), strict=True))
        first = {s.lstrip("=")[:3] for s in self.signs} | {w[:3] for w in LEXICON}
        lexicon = frozenset(LEXICON)
        tail, bias = self.weights[len(self.signs) :].tolist(), self.bias

        def score(text: str | None) -> float:
            found, hit = set(), 0
            low = (text or "").lower()
            for w in set(low.split()):
                if w[:3] not in first:
                    w = w.strip(_STRIP)
                    if w[:3] not in first:
                        continue
                w = w.strip(_STRIP)
                hit |= w in lexicon
                for s in ("=" + w, w[:4], w[:5], w[:6]):
                    if s in at and len(s) > 3:
                        found.add(s)
            z = bias + sum(at[s] for s in sorted(found)) + tail[0] * hit
            for w, v in zip(tail[1:], voted(low, text or ""), strict=True):
                z += w * v
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def voted(low: str, text: str) -> list[int]:
    """The pattern voters' votes on a whole text."""
    return [int(bool(_YOU.search(text))), int("!!!" in text), int(bool(_THREAT.search(text)))]


#: Patterns that voted() looks for.
PATTERNS = 3


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shift(z: np.ndarray, share: float) -> float:
    """What to add to z for logistic(z) to have that mean, by bisection."""
    low, high = -30 - z.max(initial=0.0), 30 - z.min(initial=0.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if logistic(z + mid).mean() < share else (low, mid)
    return (low + high) / 2


def label_model(votes: np.ndarray, balance: float | None = None, rounds: int = 60, chance: float = CHANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rates by class, correlations) of votes (1, or 0) with a hidden binary label.

    Rows with two votes or more start as likely ones and rows with one at ALONE,
    voters that nearly copy one another counted as one; from there on rates and posteriors follow from
    each other, the voters' agreement alone. The residual correlations of
    voters within the classes, chance ones left out, divide the evidence of
    those that err together by 1 + their sum, so k voters that always agree
    count like one. Rates are smoothed. balance: the share of the class, where
    it is known, to which every round's posteriors are held, or else the class
    may shrink to rows that many voters agree on (those of a language that has
    a lexicon); without it too few independent voters leave it open.
    """
    n, m = votes.shape
    rates, rare = np.full((2, m), 0.5), votes.sum(0) < RARE
    rest = votes - votes.mean(0)
    corr = rest.T @ rest / max(1, n) / np.outer(rest.std(0) + 1e-6, rest.std(0) + 1e-6)
    corr[(corr < COPY) | rare[:, None] | rare[None, :]] = 0
    np.fill_diagonal(corr, 0)
    own = votes @ (1 / (1 + corr.sum(1)))
    post = np.where(own >= 1.95, 0.9, np.where(own >= 0.95, ALONE, 0.05))
    for step in range(rounds):
        prior = float(np.clip(post.mean() if balance is None else balance, 1e-3, 1 - 1e-3))
        for c, w in ((1, post), (0, 1 - post)):
            rates[c] = (w @ votes + 0.5) / (w.sum() + 1.0)
        if step in (rounds // 3, 2 * rounds // 3):
            rest = votes - np.outer(post, rates[1]) - np.outer(1 - post, rates[0])
            sd = np.sqrt((rest**2).mean(0)) + 1e-6
            corr = np.clip(rest.T @ rest / n / np.outer(sd, sd), 0, 1)
            corr[(corr < chance) | rare[:, None] | rare[None, :]] = 0
            np.fill_diagonal(corr, 0)
        weight = 1 / (1 + corr.sum(1))
        z = np.log(prior / (1 - prior)) + votes @ (weight * np.log(rates[1] / rates[0])) + (1 - votes) @ (weight * np.log((1 - rates[1]) / (1 - rates[0])))
        post = logistic(z if balance is None else z + shift(z, prior))
    return post, rates, corr


def kind_of(sign: str) -> int:
    """Which tally a sign belongs to: 0 for a word, 1 to 3 for beginnings of 4, 5 and 6 letters."""
    return 0 if sign[0] == "=" else len(sign) - 3


def lifts(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The lift of each sign by its (clean, toxic) counts, 0 where it falls short of SUPPORT or LIFT."""
    x = np.log((counts[:, 1] + 0.5) / (totals[1] + 1.0)) - np.log((counts[:, 0] + 0.5) / (totals[0] + 1.0))
    return np.where((counts[:, 1] >= SUPPORT) & (x >= LIFT), x, 0.0)


def tallies(x: list[np.ndarray], kinds: np.ndarray, counts: np.ndarray, fold: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Votes of the four tallies on rows of signs x, those of each fold by the counts and labels of the others.

    counts: (sign, fold, class). A tally is the sum of the lifts of a row's
    signs of one kind; it votes from the threshold that tells the other folds'
    classes best at COST.
    """
    n, row = len(x), np.repeat(np.arange(len(x)), [len(v) for v in x])
    col = np.concatenate(x).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    votes = np.zeros((n, 4))
    for k in np.unique(fold).tolist():
        rest, mine = fold != k, fold == k
        lift = lifts(counts[:, [j for j in range(counts.shape[1]) if j != k]].sum(1), np.array([(rest & (gold == c)).sum() for c in (0, 1)], float))
        for j in range(4):
            total = np.bincount(row, np.where(kinds == j, lift, 0.0)[col], minlength=n)
            toxic, clean = np.sort(total[rest & (gold > 0)]), np.sort(total[rest & (gold == 0)])
            at = np.unique(toxic[toxic > 0])
            if len(at):
                caught = 1 - np.searchsorted(toxic, at) / max(1, len(toxic))
                wrong = 1 - np.searchsorted(clean, at) / max(1, len(clean))
                votes[mine, j] = total[mine] >= at[np.argmax(caught - COST * wrong)]
    return votes


def linear(x: list[np.ndarray], width: int, y: np.ndarray, rounds: int = 300, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on rows of present features, by full gradient steps with momentum."""
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    col = np.concatenate(x).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    freq = np.maximum(1.0, np.bincount(col, minlength=width)) / len(y)
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    vw, vb = np.zeros(width), 0.0
    for _ in range(rounds):
        z = b + np.bincount(row, w[col], minlength=len(y))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(col, d[row], minlength=width) / np.sqrt(freq) + decay * w
        vw, vb = 0.9 * vw - 1.5 * g, 0.9 * vb - 1.5 * d.sum()
        w, b = w + vw, b + vb
    return w, b


def _plain_model() -> Model:
    """Where nothing is labelled: the lexicon and pattern voters with fixed weights."""
    return Model([], np.array([4.0, 2.0, 0.3, 2.0]), -2.0, np.zeros(0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model learnt from the labels of documents that aren't held out.

    At most sample labelled documents, those of the smallest hashes of their
    ids, are used: a documented bound of the fit. Of several texts of one
    doc_id the smallest counts; rows without a doc_id have no label. Their
    signs are counted by partial aggregation; the driver gets the chosen signs
    and, of each sampled document, the numbers of its signs. Where the training
    labels are all of one class, the fixed voters alone make the model.
    """
    spark = docs.sparkSession
    named = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    named = named.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    # Hashes below a bound that some more than sample rows pass: else each task would send sample rows of its own.
    span, n = 1 << 40, named.count()
    hashed = named.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(span)))
    if n > sample:
        hashed = hashed.where(F.col("h") < math.ceil(span * (sample + 8 * math.sqrt(sample) + 50) / n))
    chosen = {r["doc_id"]: r["y"] for r in hashed.orderBy("h", "doc_id").limit(sample).collect()}
    if len(set(chosen.values())) < 2:
        return _plain_model()
    picked = spark.createDataFrame(list(chosen.items()), "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")  # sample rows at most
    texts = kept(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for y, text, fold in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                for s in candidates(text.as_py()):
                    seen.setdefault((s, fold), [0, 0])[y] += 1
            if seen:
                columns = [pa.array([s for s, _ in seen]), pa.array([f for _, f in seen], pa.int32()), *(pa.array([v[y] for v in seen.values()]) for y in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["sign", "fold", "c", "t"])

    each = [F.sum(F.when(F.col("fold") == k, F.col(x)).otherwise(0)).alias(f"{x}{k}") for k in range(FOLDS) for x in ("c", "t")]
    counted = texts.select("y", "text", "fold").mapInArrow(count, "sign string, fold int, c long, t long").groupBy("sign").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), *each)
    sizes = {(r["fold"], r["y"]): r["count"] for r in texts.groupBy("fold", "y").count().collect()}
    n0, n1 = (sum(n for (_, y), n in sizes.items() if y == c) for c in (0, 1))
    lift = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    top = counted.where(F.col("t") >= SUPPORT).withColumn("lift", lift).where(F.col("lift") >= LIFT)
    top = top.orderBy(F.desc(F.col("lift") * F.sqrt("t")), "sign").limit(SIGNS).collect()
    signs = [r["sign"] for r in top]
    counts = np.array([[[r[f"c{k}"], r[f"t{k}"]] for k in range(FOLDS)] for r in top], float).reshape(len(top), FOLDS, 2)
    place = {s: i for i, s in enumerate(signs)}
    insult = {"=" + w: len(signs) + k for k, w in enumerate(LEXICON)}
    first = len(signs) + len(LEXICON)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                text = text.as_py() or ""
                has = candidates(text)
                extra = [first + k for k, v in enumerate(voted(text.lower(), text)) if v]
                out.append(sorted([place[s] for s in has if s in place] + [insult[s] for s in has if s in insult]) + extra)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "y", "fold", "x"])

    rows = texts.select("doc_id", "text", "y", "fold").mapInArrow(features, "doc_id long, y int, fold int, x array<int>").orderBy("doc_id").collect()
    if not rows:
        return _plain_model()
    x, width = [np.array(r["x"], np.int64) for r in rows], first + PATTERNS
    gold, fold = (np.array([r[c] for r in rows], float) for c in ("y", "fold"))
    alone = np.zeros((len(rows), len(LEXICON) + PATTERNS))
    for i, v in enumerate(x):
        alone[i, v[v >= len(signs)] - len(signs)] = 1
    kinds = np.array([kind_of(s) for s in signs], int)
    votes = np.concatenate([alone, tallies([v[v < len(signs)] for v in x], kinds, counts, fold, gold)], axis=1)
    post, rates, _ = label_model(votes, float(gold.mean()))
    # The classifier's features: the signs, any insult at all, the patterns.
    narrow = lambda v: np.unique(np.where(v < len(signs), v, np.where(v < first, len(signs), v - len(LEXICON) + 1)))
    w, b = linear([narrow(v) for v in x], width - len(LEXICON) + 1, post)
    return Model(signs, w, b, rates)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted added, row by row.

    docs: text and any other columns (columns score and predicted are
    replaced). Null and empty texts get the score of a text without signs;
    texts are read whole; an empty table gives no rows.
    """
    base = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            s = np.array([score(x.as_py()) for x in text], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; a null doc_id is held out like the empty text's crc32 of 0 says."""
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = scored(wanted, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
