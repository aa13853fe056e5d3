"""Toxicity by weak supervision: voters, a generative model of their votes, and a linear classifier of its posteriors.

Voters look for words of fixed lists, for patterns, and for beginnings of words that labelled rows point to. The label
model takes the true class as hidden: each voter has rates of its votes per class, and depends on one other voter at
most; the tree of dependencies is the one that explains most of what voters share within a class. Its posteriors are
the targets of a linear classifier over counts of words and word beginnings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.llm.common import row_key, stored, table
from twinrun.llm.transducer import Words, slices, spans

#: Distinct labelled texts that lexicons and classifier are fitted on, about; chosen by a hash of the text.
FIT_ROWS = 10_000
FIT_TASKS = 8
#: Word beginnings of so many bytes are evidence, next to whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Mined evidence: at most so many, each in so many toxic texts, with so much of a log-likelihood ratio.
MOST_MINED = 4096
LEAST_TOXIC = 4
LEAST_RATIO = 24.0
#: Rounds of the label model, and how far a label of the training rows is believed.
ROUNDS = 6
#: Voters depend on each other if they share more than this (nats) within the classes; below, agreement is put down to the class.
TIED = 0.05
TRUST = 0.98
#: Log-odds that a posterior counts at most next to the label of a row: voters that agree do not outvote it.
SUREST = 2.0
THRESHOLD = 0.3

# Words of abuse by kind and language, for the lexicon voters.
LEXICONS = {
    "insults en": "idiot idiots moron morons stupid dumb fool loser losers clown scum trash jerk bastard imbecile creep freak",
    "contempt en": "pathetic worthless disgusting vile filthy useless ugly despicable repulsive garbage shameful vermin",
    "insults de": "idiot idioten trottel depp dumm dummkopf blödmann arschloch abschaum versager schwachkopf widerlich wertlos",
    "insults fr": "idiot idiote imbécile crétin connard stupide abruti ordure dégoûtant minable salaud nul",
    "insults es": "idiota imbécil estúpido estúpida tonto tonta cabrón basura asqueroso patético inútil payaso escoria",
}

# Bytes that are no part of a word, which is all of ASCII but letters; in the classes of the transducer.
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = 4

_KINDS = (*PREFIXES, 0)
_SEEDS = np.arange(1, len(_KINDS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _evidence(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each kind of evidence, 64-bit hashes and the texts they stand in; and the bytes in each text."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    n = len(lower)
    _, places, content = lower.buffers()
    offsets = np.frombuffer(places, np.int64)[lower.offset : lower.offset + n + 1] if n else np.zeros(1, np.int64)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if offsets[0] == offsets[-1]:
        return [none] * len(_KINDS), np.diff(offsets)
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    _, starts, ends = spans(data, offsets, _LETTERS)
    if not len(starts):
        return [none] * len(_KINDS), np.diff(offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    words = Words(data, starts, ends, np.zeros(len(starts), np.int64))
    out = []
    first = words.lanes[starts]
    for size, seed in zip(_KINDS, _SEEDS):
        if size:
            long = np.flatnonzero(words.sizes >= size)
            h = (first[long] & np.uint64((1 << 8 * size) - 1)) ^ seed
        else:
            long, h = np.arange(len(starts)), words.hashes ^ seed
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append((h ^ h >> np.uint64(29), text[long]))
    return out, np.diff(offsets)


def _word_hashes(words: str) -> list[int]:
    """The hashes of single words as evidence."""
    (h, _) = _evidence(pa.array([words], pa.large_string()))[0][-1]
    return np.unique(h).tolist()


# Patterns: RE2, counted per byte of a text; a voter speaks above the share.
PATTERNS = {"capitals": (r"[A-Z]", 0.3), "exclamations": (r"!", 0.02), "symbols": (r"[#$%&*]", 0.05), "spelled out": (r"\b\w[ .*_-]\w[ .*_-]\w\b", 0.02)}


@dataclass(frozen=True)
class Voters:
    """Evidence (ascending hashes), the voter of each, and how many voters there are; fixed in size.

    A lexicon voter votes 1 with a hit and abstains else. A mined one votes 1 from two hits on, abstains at one, and
    votes -1 without. A pattern voter votes 1 above its share.
    """

    keys: np.ndarray
    voter: np.ndarray
    names: tuple[str, ...]

    @classmethod
    def of(cls, mined: list[tuple[int, int]]) -> Voters:
        """From the fixed lexicons and mined evidence as ``(hash, kind)``; each kind has two voters, by a bit of the hash."""
        names = [*LEXICONS, *[f"mined {k or 'words'} {half}" for k in _KINDS for half in "ab"], *PATTERNS]
        owner: dict[int, int] = {}
        for i, words in enumerate(LEXICONS.values()):
            for h in _word_hashes(words):
                owner.setdefault(h, i)
        for h, kind in mined:  # what a lexicon holds stays with its voter
            owner.setdefault(h, len(LEXICONS) + 2 * kind + (h & 1))
        keys = np.array(sorted(owner), np.uint64)
        return cls(keys, np.array([owner[int(k)] for k in keys], np.int64), tuple(names))

    def _maybe(self) -> np.ndarray:
        seen = np.zeros(1 << 20, bool)
        seen[self.keys >> np.uint64(44)] = True
        return seen

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, number of the evidence, and count of all that is found; and the votes, one row for each text."""
        seen, codes = self._maybe(), []
        evidence, sizes = _evidence(texts)
        for h, text in evidence:
            at = np.flatnonzero(seen[h >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            true = self.keys[place] == h[at]
            codes.append(text[at[true]] * len(self.keys) + place[true])
        code, count = np.unique(np.concatenate(codes), return_counts=True)
        text, key = np.divmod(code, len(self.keys))
        n, v = len(texts), len(self.names)
        hits = np.bincount(text * v + self.voter[key], count, n * v).reshape(n, v)
        votes = np.zeros((n, v), np.int8)
        fixed, mined = len(LEXICONS), v - len(PATTERNS)
        votes[:, :fixed] = hits[:, :fixed] > 0
        votes[:, fixed:mined] = np.sign(hits[:, fixed:mined] - 1)
        for i, (pattern, share) in enumerate(PATTERNS.values()):
            many = pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
            votes[:, mined + i] = many > share * np.maximum(sizes, 1)
        return text, key, count, votes


# ---------------------------------------------------------------- evidence of labelled rows


def _ratio(pos: Column, neg: Column, toxic: int, clean: int) -> Column:
    """Log-likelihood ratio of a piece of evidence and the class, by the texts that hold it."""

    def term(seen: Column, rate: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / rate)).otherwise(0.0)

    n = toxic + clean
    both = pos + neg
    absent = F.lit(float(n)) - both
    return 2 * (
        term(pos, both * (toxic / n)) + term(neg, both * (clean / n))
        + term(F.lit(float(toxic)) - pos, absent * (toxic / n)) + term(F.lit(float(clean)) - neg, absent * (clean / n))
    )


def _mined(sample: DataFrame, toxic: int, clean: int) -> list[tuple[int, int]]:
    """The evidence that speaks most for label 1: ``(hash, kind)``. ``sample``: text, toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[] for _ in _KINDS]
        for batch in batches:
            labels = batch["toxic"].to_numpy(zero_copy_only=False).astype(bool)
            done = 0
            for part in slices(batch["text"].cast(pa.large_string())):
                for kind, (h, text) in enumerate(_evidence(part)[0]):
                    # Each piece of evidence once per text: sorted by hash, then by text.
                    order = np.lexsort((text, h))
                    h, text = h[order], text[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                    h, y = h[new], labels[done + text[new]]
                    seen[kind].append(np.stack([h, y.astype(np.uint64)]))
                done += len(part)
        for kind, parts in enumerate(seen):
            if parts:
                h, y = np.concatenate(parts, axis=1)
                keys, place = np.unique(h, return_inverse=True)
                pos = np.bincount(place, y.astype(float), len(keys)).astype(np.int32)
                neg = (np.bincount(place, minlength=len(keys)) - pos).astype(np.int32)
                kinds = np.full(len(keys), kind, np.int32)
                yield pa.record_batch([keys.view(np.int64), kinds, pos, neg], names=["h", "kind", "pos", "neg"])

    counts = sample.mapInArrow(count, "h bigint, kind int, pos int, neg int").groupBy("h", "kind")
    found = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST_TOXIC)
    ratio = _ratio(F.col("pos").cast("double"), F.col("neg").cast("double"), toxic, clean)
    more = F.col("pos") * clean > F.col("neg") * toxic
    best = found.where(more).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "h").limit(MOST_MINED)
    return [(r.h & (1 << 64) - 1, r.kind) for r in best.collect()]


# ---------------------------------------------------------------- label model


@dataclass
class LabelModel:
    """Rates of votes by class along trees of dependencies: ``rates[j, p, v, c]`` is P(vote v of j | vote p of its parent,
    class c), a root's parent being itself with one value; ``prior`` is P(class 1). Votes are numbered 0, 1, 2 for -1, 0, 1.
    """

    parent: np.ndarray
    rates: np.ndarray
    prior: float
    joint: np.ndarray = field(repr=False)

    @classmethod
    def of_counts(cls, joint: np.ndarray) -> LabelModel:
        """From expected counts ``joint[c, i, j, a, b]`` of vote a of i with vote b of j in class c.

        The trees are the heaviest ones by mutual information within classes, so correlated voters are not counted as
        independent evidence; weaker ties than TIED are left out, else the trees would explain what the class does.
        """
        v = joint.shape[1]
        total = joint[:, 0, 0].sum(axis=(1, 2)) if v else np.ones(2)
        p = (joint + 0.05) / (joint + 0.05).sum(axis=(3, 4), keepdims=True)
        alone = p.sum(axis=4, keepdims=True) * p.sum(axis=3, keepdims=True)
        share = (total / max(total.sum(), 1e-9))[:, None, None]
        shared = (share * (p * np.log(p / alone)).sum(axis=(3, 4))).sum(axis=0)
        parent = np.full(v, -1)
        reached = np.zeros(v, bool)
        best, by = np.full(v, -1.0), np.full(v, -1)
        for _ in range(v):
            j = int(np.argmax(np.where(reached, -np.inf, best)))
            parent[j], reached[j] = by[j] if best[j] > TIED else -1, True
            nearer = shared[j] > best
            best, by = np.where(nearer, shared[j], best), np.where(nearer, j, by)
        rates = np.zeros((v, 3, 3, 2))
        for j in range(v):
            given = joint[:, parent[j], j] if parent[j] >= 0 else joint[:, j, j].sum(axis=2)[:, None, :].repeat(3, axis=1)
            # A vote never seen under a parent's vote falls back on the voter's own rate.
            own = joint[:, j, j].sum(axis=2)
            own = (own + 1) / (own + 1).sum(axis=1, keepdims=True)
            smooth = given + 2 * own[:, None, :]
            rates[j] = (smooth / smooth.sum(axis=2, keepdims=True)).transpose(1, 2, 0)
        return cls(parent, rates, float(np.clip(total[1] / max(total.sum(), 1e-9), 1e-4, 1 - 1e-4)), joint)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) for rows of votes -1, 0, 1."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        at = votes.astype(np.int64) + 1
        for j, p in enumerate(self.parent):
            log += np.log(self.rates[j, at[:, p] if p >= 0 else 0, at[:, j]])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def accuracies(self, names: tuple[str, ...]) -> dict[str, tuple[float, float]]:
        """For each voter, how often it is right when it votes, and how often it votes."""
        out = {}
        for j, name in enumerate(names):
            own = self.joint[:, j, j].sum(axis=2)
            voted = own[:, 0].sum() + own[:, 2].sum()
            out[name] = (float((own[0, 0] + own[1, 2]) / max(voted, 1e-9)), float(voted / own.sum()))
        return out


def _vote_counts(votes: np.ndarray, weight: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Expected joint counts of pairs of votes by class."""
    n, v = votes.shape
    one_hot = np.zeros((n, v, 3))
    one_hot[np.arange(n)[:, None], np.arange(v), votes.astype(np.int64) + 1] = 1
    flat = one_hot.reshape(n, 3 * v)
    both = [flat.T @ (flat * (weight * p)[:, None]) for p in (1 - toxic, toxic)]
    return np.stack(both).reshape(2, v, 3, v, 3).transpose(0, 1, 3, 2, 4)


def _expected(patterns: DataFrame, v: int, model: LabelModel | None, labelled: bool) -> np.ndarray:
    """The counts of all patterns under the model; before there is one, of the labelled rows or by the sum of the votes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, v, v, 3, 3))
        for batch in batches:
            raw = b"".join(x.as_py() for x in batch["votes"])
            votes = np.frombuffer(raw, np.int8).reshape(-1, v)
            weight = batch["n"].to_numpy(zero_copy_only=False).astype(float)
            label = batch["label"].to_numpy(zero_copy_only=False)
            if model is not None:
                p = model.posterior(votes)
            elif labelled:
                p, weight = np.full(len(votes), 0.5), np.where(label < 0, 0, weight)
            else:
                p = np.where(votes.clip(0).sum(axis=1) > 0, 0.9, 0.1)
            p = np.where(label < 0, p, np.where(label > 0, TRUST, 1 - TRUST))
            for at in range(0, len(votes), 4096):
                s = slice(at, at + 4096)
                total += _vote_counts(votes[s], weight[s], p[s])
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["joint"])

    rows = patterns.coalesce(8).mapInArrow(count, "joint binary").collect()
    return sum((np.frombuffer(r.joint).reshape(2, v, v, 3, 3) for r in rows), np.zeros((2, v, v, 3, 3)))


# ---------------------------------------------------------------- classifier


def _features(text: np.ndarray, key: np.ndarray, count: np.ndarray, votes: np.ndarray, voter: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows, columns and values of the classifier's inputs: counts of evidence, hits of voters, and votes of patterns."""
    n, v = votes.shape
    hits = np.bincount(text * v + voter[key], count, n * v)
    spoken = np.flatnonzero(hits)
    pattern, at = np.nonzero(votes[:, v - len(PATTERNS) :])
    n_keys = len(voter)
    rows = np.concatenate([text, spoken // v, pattern])
    columns = np.concatenate([key, n_keys + spoken % v, n_keys + v - len(PATTERNS) + at])
    return rows, columns, np.concatenate([np.log1p(count), np.log1p(hits[spoken]), np.ones(len(at))])


def _fitted(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, n_columns: int) -> np.ndarray:
    """Weights of a logistic regression and the bias (last), by Adam over the whole sample, with a small ridge."""
    w, m, s = (np.zeros(n_columns + 1) for _ in range(3))
    rows, columns = np.concatenate([rows, np.arange(len(target))]), np.concatenate([columns, np.full(len(target), n_columns)])
    values = np.concatenate([values, np.ones(len(target))])
    ridge = np.full(n_columns + 1, 1e-4)
    ridge[-1] = 0
    for t in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * w[columns], len(target)), -30, 30)))
        gradient = np.bincount(columns, values * (p - target)[rows], n_columns + 1) / max(1, len(target)) + ridge * w
        m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass(frozen=True)
class Toxicity:
    """A fitted scorer: the voters, the label model (for inspection), and the weights, the last of which is the bias."""

    voters: Voters
    labels: LabelModel
    weights: np.ndarray

    def scores(self, n: int, text: np.ndarray, key: np.ndarray, count: np.ndarray, votes: np.ndarray) -> np.ndarray:
        rows, columns, values = _features(text, key, count, votes, self.voters.voter)
        total = self.weights[-1] + np.bincount(rows, values * self.weights[columns], n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def score(self, docs: DataFrame, *others: Column, text: str = "text") -> DataFrame:
        """``others`` and ``score``, 0 to 1, of whole texts. NULL is the empty text, which has a score like any other."""
        return scored(evidence_of(docs, self.voters, *others, text=text), self)


def evidence_of(docs: DataFrame, voters: Voters, *others: Column, text: str = "text") -> DataFrame:
    """``others``, ``votes`` (one byte for each voter) and ``found``: pairs of 32-bit integers, evidence and count."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    given = docs.select(*others, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(text))
    names = given.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch[text].cast(pa.large_string())):
                n = len(part)
                at, key, count, votes = shared.value.found(part)
                pairs = np.stack([key, count], axis=1).astype("<u4")
                ends = np.searchsorted(at, np.arange(n + 1))
                found = [pairs[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                rest = [batch[c].slice(done, n) for c in names]
                done += n
                raw = [row.tobytes() for row in votes]
                yield pa.record_batch([*rest, pa.array(raw, pa.binary()), pa.array(found, pa.binary())], names=[*names, "votes", "found"])

    added = T.StructType.fromDDL("votes binary, found binary")
    return given.mapInArrow(run, T.StructType([*given.schema[:-1], *added]))


def _unpacked(votes: list[bytes], found: list[bytes], v: int) -> tuple[np.ndarray, ...]:
    """What ``Voters.found`` gave, from the columns of ``evidence_of``."""
    text = np.repeat(np.arange(len(found)), [len(x) // 8 for x in found])
    pairs = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2).astype(np.int64)
    return text, pairs[:, 0], pairs[:, 1], np.frombuffer(b"".join(votes), np.int8).reshape(-1, v)


def scored(evidence: DataFrame, model: Toxicity) -> DataFrame:
    """The evidence's other columns and the score; no text is read."""
    shared = evidence.sparkSession.sparkContext.broadcast(model)
    names = [c for c in evidence.columns if c not in ("votes", "found")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            parts = _unpacked(batch["votes"].to_pylist(), batch["found"].to_pylist(), len(t.voters.names))
            yield pa.record_batch([*[batch[c] for c in names], pa.array(t.scores(len(batch), *parts))], names=[*names, "score"])

    return evidence.mapInArrow(run, T.StructType([*evidence.select(*names).schema, T.StructField("score", T.DoubleType())]))


# ---------------------------------------------------------------- fit


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4. Rows without an id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Toxicity, DataFrame]:
    """A fitted model and the stored evidence of all ``docs``: ``doc_id, held_out, votes, found``.

    Lexicons are mined from, and the classifier is fitted on, a sample of distinct texts of labelled rows that are not
    held out: about ``fit_rows`` of them, by a hash of the text. The label model takes the votes of all rows that are
    not held out, counted by pattern. Without labels there is no mined evidence, and voters start from their majority;
    without rows the scorer has its bias alone. Of several labels of one id the largest counts.
    """
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    train = known.where(~held_out(F.col("doc_id")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    marked = rows.join(train, "doc_id")
    n = train.count()
    share = min(1.0, fit_rows / max(1, n))
    keyed = marked.withColumns(dict(zip(("k1", "k2"), row_key(F.col("text")))))
    chosen = keyed.where(F.pmod("k1", F.lit(1 << 30)) < int(share * (1 << 30)))
    distinct = chosen.groupBy("k1", "k2").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = stored(distinct.select("text", F.col("toxic").cast("int").alias("toxic")).repartition(FIT_TASKS), "toxic-sample")
    counts = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = counts.get(1, 0), sum(c for k, c in counts.items() if k != 1)
    voters = Voters.of(_mined(sample, toxic, clean) if toxic and clean else [])
    v = len(voters.names)

    every = stored(evidence_of(docs, voters, F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")), "toxic-evidence")
    # Votes are counted before labels are joined to rows: most rows have the same few patterns.
    training = every.where("NOT held_out").select("doc_id", "votes").join(train, "doc_id", "left")
    label = F.coalesce(F.when(F.col("toxic") == 1, 1).otherwise(F.when(F.col("toxic").isNotNull(), 0)), F.lit(-1))
    patterns = stored(training.groupBy("votes", label.alias("label")).agg(F.count("*").alias("n")), "toxic-votes")
    model = None
    for _ in range(ROUNDS):
        model = LabelModel.of_counts(_expected(patterns, v, model, labelled=n > 0))

    fit = evidence_of(sample, voters, F.col("toxic")) if toxic and clean else None
    weights = np.zeros(len(voters.keys) + v + 1)
    if fit is not None:
        got = fit.collect()
        parts = _unpacked([r.votes for r in got], [r.found for r in got], v)
        target = model.posterior(parts[3])
        # The label of a training row is one more vote, which weighs more than the posterior.
        odds = np.clip(np.log((target + 1e-12) / (1 - target + 1e-12)), -SUREST, SUREST) + np.where([r.toxic == 1 for r in got], 1, -1) * np.log(TRUST / (1 - TRUST))
        target = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        weights = _fitted(*_features(*parts, voters.voter), target, len(voters.keys) + v)
    else:
        weights[-1] = -2.0
        weights[len(voters.keys) : len(voters.keys) + len(LEXICONS)] = 3.0
    return Toxicity(voters, model, weights), every


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, evidence = learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = scored(evidence.select("doc_id", "held_out", "votes", "found"), model)
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
