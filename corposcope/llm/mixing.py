"""Mixing sources to target shares of tokens, with soft membership.

A classifier trained on labelled documents gives every document without a known
source a posterior over the sources; labelled documents belong to their source.
Each document gets a nonnegative rate (expected number of times it is taken),
bounded by its source's repeat cap, such that the expected tokens of each source
meet its target.  Rates minimise the squared misses by projected gradient steps from
rate one: with membership m a document's rate is one minus m times the sum of all
steps, clipped to [0, m times caps].  That sum is one number per source, so a step
is one aggregation, nothing of its past is kept, and documents of equal membership
(all of one source) have equal rates and are summed once.  Steps go on until no
source that still can move misses its goal by more than ``TOLERANCE`` of all tokens.

The first fit uses certain members only.  Sources that it leaves at their cap below
their goal are out of reach, whatever soft documents add; an exact count of their
tokens confirms it.  The second fit has all documents: sources that stay short keep
their cap, the others' targets are raised in proportion until the mixture is as large
as the corpus, and the fit is repeated.

Edge cases: null or empty texts have no tokens; a target for a source without
documents is out of reach unless it is zero; a null target counts as zero and a
null cap as one; sources without a target are treated like missing ones; without
labelled documents posteriors are uniform; repeated rows are separate documents;
an empty corpus gives targets with zero tokens, none of them out of reach; without
targets every rate is zero.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.llm.textarrays import run_hashes, utf8
from corposcope.session import spread, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of the published byte-level vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
SAMPLE = 6000  #: labelled documents that train the classifier, at most; the first by hash of their id
TOLERANCE, STEPS = 1e-7, 200
_encoders: dict = {}


def token_counter(vocabulary: bytes):
    """Function from texts to token counts, of the published vocabulary file's bytes; built once per process."""
    if len(vocabulary) not in _encoders:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[len(vocabulary)] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = _encoders[len(vocabulary)].encode_ordinary
    return lambda text: len(encode(text))


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word: runs of letters, hashed."""
    flat, off = utf8(texts)
    n = len(off) - 1
    joined = np.zeros(flat.size + n, np.uint8)
    joined[np.arange(flat.size) + np.repeat(np.arange(n), np.diff(off))] = flat
    start, _, h = run_hashes(_LOWER[joined], _LETTER[joined])
    return np.searchsorted(off + np.arange(n + 1), start, side="right") - 1, (h % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Classifier:
    """Multinomial naive Bayes on hashed words; ``heat`` is fitted on held-out documents so posteriors are calibrated."""

    sources: list[str]
    prior: np.ndarray
    weight: np.ndarray | None = None
    heat: float = 1.0
    held_out: dict[float, float] = field(default_factory=dict)

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        """[texts, sources]."""
        score = np.tile(self.prior, (len(texts), 1)).astype(float)
        if self.weight is not None and self.heat and len(texts):
            doc, bucket = word_buckets(texts)
            for k in range(len(self.sources)):
                score[:, k] += self.heat * np.bincount(doc, self.weight[k, bucket], minlength=len(texts))
        p = np.exp(score - score.max(1, keepdims=True)) if self.sources else score
        return p / p.sum(1, keepdims=True) if self.sources else p


HEATS = (0.0, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)


def train(rows: list[tuple[str, str | None]], sources: list[str]) -> Classifier:
    """Fit on (source, text) rows; every fourth row is held out for the heat, whose losses are kept in ``held_out``."""
    k = {s: i for i, s in enumerate(sources)}
    if not rows:
        return Classifier(sources, np.zeros(len(sources)))
    y = np.array([k[s] for s, _ in rows])
    doc, bucket = word_buckets(pa.array([t or "" for _, t in rows], pa.string()))
    held = np.arange(y.size) % 4 == 3
    own = ~held if y.size >= 8 else np.ones(y.size, bool)
    counts = 1.0 + np.bincount(y[doc[own[doc]]] * BUCKETS + bucket[own[doc]], minlength=len(sources) * BUCKETS).reshape(len(sources), BUCKETS)
    n = 1.0 + np.bincount(y[own], minlength=len(sources))
    out = Classifier(sources, np.log(n / n.sum()), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))
    if held.any():
        x = np.stack([np.bincount(doc, out.weight[j, bucket], minlength=y.size) for j in range(len(sources))], 1)[held]
        for heat in HEATS:
            z = out.prior + heat * x
            z = z - z.max(1, keepdims=True)
            out.held_out[heat] = float(-(z[np.arange(z.shape[0]), y[held]] - np.log(np.exp(z).sum(1))).mean())
        out.heat = min(HEATS, key=lambda heat: (out.held_out[heat], heat))
    return out


def measured(documents: DataFrame, known: dict[str, int], classifier: Classifier, vocabulary: bytes) -> DataFrame:
    """(doc_id, source, tokens, member): ``member`` is the posterior of documents without a known source, else null."""
    shipped = documents.sparkSession.sparkContext.broadcast(vocabulary)  # one published file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(shipped.value)
        for batch in batches:
            sources, texts = batch.column(1).to_pylist(), batch.column(2)
            loose = [i for i, s in enumerate(sources) if s not in known]
            member: list = [None] * len(sources)
            for i, p in zip(loose, classifier.posteriors(texts.take(pa.array(loose, pa.int64()))).tolist() if loose else []):
                member[i] = p
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([count(t) if t else 0 for t in texts.to_pylist()], pa.int64()),
                 pa.array(member, pa.list_(pa.float64()))], ["doc_id", "source", "tokens", "member"])
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).mapInArrow(
        run, "doc_id long, source string, tokens long, member array<double>")


@dataclass
class Fit:
    """Result of the fit: rates per source, the sum of all steps that gives every document's rate, and the shares."""

    sources: list[str]
    target: np.ndarray
    cap: np.ndarray
    tokens: np.ndarray
    rate: np.ndarray
    total: float
    reached: np.ndarray
    short: np.ndarray
    moved: np.ndarray
    steps: int


def soft_rates(member: np.ndarray, cap: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Rates of documents by membership: one, moved by all steps, clipped to [0, expected cap]."""
    return np.clip(1.0 - member @ moved, 0.0, member @ cap)


def _soft_totals(soft: DataFrame, cap: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Expected tokens that soft documents add to each source: one aggregation."""
    size = cap.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                member = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                out += (soft_rates(member, cap, moved) * tokens) @ member
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], ["k", "v"])

    got = soft.select("tokens", "member").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["k"]] = r["v"]
    return out


def descend(tokens: np.ndarray, cap: np.ndarray, goal: np.ndarray, soft=None) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of steps, tokens reached, number of steps) of projected gradient least squares towards ``goal``.

    ``soft`` gives the tokens that uncertain documents add for a sum of steps.  A step
    is the miss, scaled by the tokens that the source has; the sum stays where rates are in [0, cap].
    """
    extra = soft if soft is not None else lambda moved: np.zeros(tokens.size)
    size = max(tokens.sum(), goal.sum(), 1.0)
    moved = np.maximum(np.zeros(tokens.size), 1.0 - cap)
    added = extra(moved)
    scale = np.maximum(tokens + added, size * 1e-6)
    steps = 0
    for steps in range(STEPS + 1):
        reached = np.clip(1.0 - moved, 0.0, cap) * tokens + added
        miss = reached - goal
        stuck = (miss < 0) & (moved <= 1.0 - cap) | (miss > 0) & (moved >= 1.0)
        if steps == STEPS or not (np.abs(miss[~stuck]) > TOLERANCE * size).any():
            break
        moved = np.clip(moved + miss / scale, 1.0 - cap, np.maximum(1.0, 1.0 - cap))
        added = extra(moved)
    return moved, reached, steps


def fit(counted: DataFrame, sources: list[str], share: np.ndarray, cap: np.ndarray) -> Fit:
    """Both fits over the rates of all documents of ``counted``."""
    k = {s: i for i, s in enumerate(sources)}
    sums = (counted.groupBy("source", F.col("member").isNotNull().alias("soft")).agg(F.sum("tokens").alias("t")).collect())
    tokens = np.zeros(len(sources))
    loose = 0.0
    for r in sums:
        if r["soft"]:
            loose += r["t"] or 0
        else:
            tokens[k[r["source"]]] += r["t"] or 0
    total = tokens.sum() + loose
    # Certain members: what is at its cap and below its goal is out of reach; the exact count confirms it.
    moved, reached, steps = descend(tokens, cap, share * total)
    short = (np.clip(1.0 - moved, 0.0, cap) >= cap) & (reached < share * total) & (tokens * cap < share * total)
    soft = None
    if loose and sources:
        equal = staged(counted.where("member is not null and tokens > 0").groupBy("member").agg(F.sum("tokens").alias("tokens")), "soft")
        soft = lambda moved: _soft_totals(equal, cap, moved)
    goal, stuck = share * total, np.zeros(len(sources), bool)
    for _ in range(len(sources) + 1):
        moved, reached, n = descend(tokens, cap, goal, soft)
        steps += n
        fresh = (np.clip(1.0 - moved, 0.0, cap) >= cap) & (reached < goal * (1 - 1e-6)) & ~stuck
        free = ~(stuck | fresh) & (share > 0)
        if not fresh.any() or not free.any():
            break
        stuck |= fresh  # sources in reach take over what the short ones lack
        goal = np.where(free, (total - reached[stuck].sum()) * share / share[free].sum(), np.where(stuck, reached, goal))
    return Fit(sources, share, cap, tokens, np.clip(1.0 - moved, 0.0, cap), total, reached / max(reached.sum(), 1.0), short, moved, steps)


def prepare(documents: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER, sample: int = SAMPLE) -> tuple[DataFrame, Fit]:
    """Count tokens, train the classifier and fit the rates. The target table is one row per source and is read whole."""
    rows = targets.where("source is not null").groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"),
        F.max(F.coalesce(F.col("max_repeats").cast("double"), F.lit(1.0))).alias("cap")).orderBy("source").collect()
    sources = [r["source"] for r in rows]
    share, cap = np.array([r["share"] for r in rows]), np.array([r["cap"] for r in rows])
    labelled = documents.where(F.col("source").isin(sources)).select("source", "text", F.xxhash64("doc_id", "text").alias("k"))
    # A threshold on the hash keeps a little more than the sample, so that no task sends more than its part of it.
    part = min(1.0, 1.1 * sample / max(labelled.count(), 1))
    some = labelled.where(F.col("k") <= F.lit(min(2**63 - 1, round((2 * part - 1) * 2.0**63)))).groupBy("source", "text").agg(F.min("k").alias("k"))
    train_rows = some.orderBy("k", "source").limit(sample).collect()
    classifier = train([(r[0], r[1]) for r in train_rows], sources)
    counted = staged(measured(documents, {s: i for i, s in enumerate(sources)}, classifier, read_vocabulary(tokenizer)), "tokens")
    return counted, fit(counted, sources, share, cap)


def mixture(counted: DataFrame, found: Fit) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each document is taken.

    The fraction of a rate is settled by the hash of the id, so a rerun gives the
    same mixture and no document is taken more often than its cap, rounded up.
    """
    spark = counted.sparkSession
    rates = spark.createDataFrame([(s, float(r)) for s, r in zip(found.sources, found.rate)], "source string, rate double")
    hard = counted.where("member is null").join(F.broadcast(rates), "source").select("doc_id", "source", "tokens", "rate")
    cap, moved = found.cap, found.moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros(batch.num_rows)
            if batch.num_rows and cap.size:
                x = soft_rates(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, cap.size), cap, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x)],
                                             ["doc_id", "source", "tokens", "rate"])

    soft = counted.where("member is not null").mapInArrow(run, "doc_id long, source string, tokens long, rate double")
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    return (hard.unionByName(soft)
                .withColumn("repeats", (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
                .select("doc_id", "source", "tokens", "repeats"))


def report(counted: DataFrame, found: Fit) -> DataFrame:
    """(source, target_share, max_repeats, tokens, rate, expected_share, out_of_reach): one row per target."""
    rows = [(s, float(a), int(c), int(t), float(r), float(m), bool(x)) for s, a, c, t, r, m, x in zip(
        found.sources, found.target, found.cap, found.tokens, found.rate, found.reached, found.short)]
    return counted.sparkSession.createDataFrame(
        rows, "source string, target_share double, max_repeats int, tokens long, rate double, expected_share double, out_of_reach boolean")


def actual_shares(mixed: DataFrame, sources: list[str]) -> DataFrame:
    """(source, tokens, share): what the drawn mixture really holds; unknown sources come as null."""
    s = F.when(F.col("source").isin(sources), F.col("source"))
    by = mixed.groupBy(s.alias("source")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    total = by.agg(F.sum("tokens")).first()[0] or 0
    return by.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
