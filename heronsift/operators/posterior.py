"""Posteriors of mixed models: random intercepts integrated out over stored or condensed blocks, draws by independent proposals."""

from __future__ import annotations

import itertools
import json
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of a block's likelihood table worked on at once.
WORK = 1 << 17
#: Degrees of freedom of the proposals: their tails outweigh the posterior's.
TAILS = 5.0
#: Nodes are doubled until no sum of log likelihoods changes by more; condensed groups may change their differences by so much.
CLOSE, SAME = 1e-4, 1e-3
#: Moments that condensed groups of a class keep at most, one number tried after the other; their least and greatest degree.
TERMS, DEGREES = (210, 500), (6, 24)
#: Rows of condensed groups at most, blocks joined on the driver at most.
KEPT, JOINED = 20_000, 32
#: Values of condensed groups' likelihood tables worked out on the driver, or by a task at least.
FEW = 1 << 23

Evaluate = Callable[[np.ndarray], np.ndarray]


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the Gamma function: Stirling's series after a shift by eight."""
    shift = x * (x + 7)
    # x (x+1) .. (x+7) as products of pairs that all grow by the same square.
    product = shift * (shift + 6) * (shift + 10) * (shift + 12)
    y = x + 8
    r = 1 / y
    r2 = r * r
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 / 1680))) - np.log(product)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block a batch: a list of (features of the cells, n | k per group, weights, weighted sums of k and k1)."""
    for batch in batches:
        parts, names = [], batch["pattern"].dictionary_encode()
        at = names.indices.to_numpy()
        weight, ends, flat = batch["weight"].to_numpy(), batch["sums"].offsets.to_numpy(), batch["sums"].values.to_numpy()
        for i, name in enumerate(names.dictionary.to_pylist()):
            mine = np.flatnonzero(at == i)
            x = np.array(json.loads(name), float)
            n, k, k1 = np.moveaxis(flat[ends[mine][:, None] + np.arange(3 * len(x))].reshape(len(mine), len(x), 3), 2, 0)
            w = weight[mine]
            parts.append((x, np.hstack([n, k - k1]), w, float(w @ k.sum(1)), float(w @ k1.sum(1))))
        yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(parts)], pa.binary())})


def blocks(cells: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Blocks of groups that are alike in the features and sums (``n``, ``k``, ``k1``) of all their cells, with weights."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    held = cells.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(x.alias("x"), "n", "k", "k1"))).alias("p"))
    kinds = held.select(F.to_json("p.x").alias("pattern"), F.flatten(F.transform("p", lambda e: F.array(e["n"], e["k"], e["k1"]))).alias("sums"))
    kinds = kinds.groupBy("pattern", "sums").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    # A number of its own: the rows are few bytes, yet each is worked on for every draw.
    dealt = kinds.repartition(2 * cells.sparkSession.sparkContext.defaultParallelism, "pattern", "sums").sortWithinPartitions("pattern", "sums")
    return dealt.mapInArrow(_packed, "block binary")


def rule(nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for a standard normal: Gauss-Hermite, or evenly spaced where there are many."""
    u, w = np.polynomial.hermite_e.hermegauss(nodes) if nodes <= 32 else (u := np.linspace(-8, 8, nodes), np.exp(-u * u / 2))
    return u, w / w.sum()


def likelihood(block: list, at: np.ndarray, family: str, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log likelihood of a block at rows of effects, deviation and (of a beta) log precision, intercepts integrated out."""
    total = np.zeros(len(at))
    p, nodes = block[0][0].shape[1], np.append(0.0, u)
    for lo in range(0, len(at), step := max(1, WORK // (len(w) * max(len(b[2]) for b in block)))):
        some = at[lo : lo + step]
        for x, sums, weight, k, k1 in block:
            eta = (x @ some[:, :p].T)[:, :, None] + some[:, p, None] * nodes  # cells x points x nodes, the first at 0
            if family == "bernoulli":
                table = np.concatenate([-np.logaddexp(0, eta), eta])
            else:
                phi = np.exp(some[:, p + 1])[:, None]
                a = np.maximum(phi / (1 + np.exp(-eta)), 1e-12)
                table = np.concatenate([lgamma(phi) - lgamma(a) - lgamma(np.maximum(phi - a, 1e-12)), a])
                total[lo : lo + step] += (phi[:, 0] - 1) * k1 - k
            centre = table[:, :, 0]
            far = sums @ (table[:, :, 1:] - centre[:, :, None]).reshape(len(table), -1)
            with np.errstate(over="ignore"):
                mean = np.exp(far).reshape(-1, len(w)) @ w
            if np.isfinite(mean).all() and mean.min(initial=1) > 1e-290:
                logs = np.log(mean)
            else:
                far = far.reshape(-1, len(w))
                most = far.max(1)
                logs = most + np.log(np.exp(far - most[:, None]) @ w)
            total[lo : lo + step] += weight @ logs.reshape(len(weight), -1) + (weight @ sums) @ centre
    return total


def summed(stored: DataFrame, at: np.ndarray, family: str, nodes: int) -> np.ndarray:
    """Log likelihood of all blocks at rows of parameters; a row per task comes back."""
    u, w = rule(nodes)

    def run(batches):
        total = np.zeros(len(at))
        for batch in batches:
            for block in batch["block"]:
                total += likelihood(pickle.loads(block.as_py()), at, family, u, w)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    return sum((np.frombuffer(r.total) for r in stored.mapInArrow(run, "total binary").collect()), np.zeros(len(at)))


def joined(blocks: list[list]) -> list:
    """One block: parts joined where the features and the numbers of rows of all cells are alike."""
    held: dict[tuple, list] = {}
    for x, sums, weight, k, k1 in itertools.chain(*blocks):
        rows, at = np.unique(sums[:, : len(x)], axis=0, return_inverse=True)
        for i, row in enumerate(rows):
            mine = at.ravel() == i
            held.setdefault((x.shape, x.tobytes(), row.tobytes()), []).append((x, sums[mine], weight[mine], k * (i == 0), k1 * (i == 0)))
    return [(p[0][0], np.vstack([b[1] for b in p]), np.concatenate([b[2] for b in p]), sum(b[3] for b in p), sum(b[4] for b in p)) for p in held.values()]


def powers(sums: np.ndarray, terms: int) -> np.ndarray | None:
    """Products of Chebyshev polynomials of the columns that vary, a row per product, up to the greatest total degree with so many; None if that is low."""
    lo, hi = sums.min(0), sums.max(0)
    vary = hi > lo
    p = int(vary.sum())
    degree = max((d for d in range(DEGREES[1] + 1) if math.comb(p + d, d) <= terms), default=0)
    if degree < DEGREES[0]:
        return None
    z = (2 * sums[:, vary] - lo[vary] - hi[vary]) / (hi - lo)[vary]
    one = np.cos(np.arange(degree + 1)[:, None, None] * np.arccos(np.clip(z, -1, 1)))
    out, left = np.ones((1, len(z))), np.array([degree])
    for j in range(p):
        out = np.concatenate([out[left >= d] * one[d, :, j] for d in range(degree + 1)])
        left = np.concatenate([left[left >= d] - d for d in range(degree + 1)])
    return out


def chosen(values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns, as many as there are rows at most, and weights with the same weighted sum of columns."""
    n, spread = len(values), (values * np.abs(weight)) @ values.T
    root = np.linalg.cholesky(spread + 1e-13 * np.trace(spread) / n * np.eye(n))
    flat = np.linalg.solve(root, values)
    size = np.einsum("ij,ij->j", flat, flat)
    # Columns far out and columns by chance, of these each time the one that is farthest from those before.
    far, some = np.argsort(-size, kind="stable")[: 2 * n], np.random.default_rng(n).permutation(len(weight))[: 2 * n]
    tried = np.union1d(far, some)
    left, size, picked, rows = flat[:, tried], size[tried], [], np.empty((n, len(tried)))
    for i in range(n):
        j = int(size.argmax())
        if size[j] < 1e-10 * n / np.abs(weight).sum():
            break
        rows[i] = (left[:, j] @ left - rows[:i, j] @ rows[:i]) / math.sqrt(size[j])
        size = np.maximum(size - rows[i] ** 2, 0)
        size[j] = 0
        picked.append(tried[j])
    at = np.sort(picked)
    return at, np.linalg.lstsq(flat[:, at], flat @ weight, rcond=1e-12)[0]


def condensed_block(block: list, terms: int) -> list:
    """A block whose classes of over twice ``terms`` groups have fewer, with the same moments of their sums."""
    out = []
    for x, sums, weight, k, k1 in block:
        values = powers(sums, terms)
        if values is not None and len(weight) > 2 * len(values):
            at, weight = chosen(values, weight)
            sums = sums[at]
        out.append((x, sums, weight, k, k1))
    return out


def condensed(stored: DataFrame, terms: int) -> list | None:
    """All blocks as one of few groups, condensed within tasks first; None where they stay too many."""

    def run(batches):
        held: list | None = []
        for batch in batches:
            for block in batch["block"]:
                if held is not None and block.is_valid:
                    held = condensed_block(joined([held, pickle.loads(block.as_py())]), terms)
                if not block.is_valid or held is not None and sum(len(b[2]) for b in held) > KEPT:
                    held = None
        if held != []:
            yield pa.RecordBatch.from_pydict({"block": pa.array([held and pickle.dumps(held)], pa.binary())})

    tasks, fewer = 2 * stored.sparkSession.sparkContext.defaultParallelism, stored.mapInArrow(run, "block binary")
    while tasks > JOINED:
        tasks = -(-tasks // JOINED)
        fewer = fewer.repartition(tasks).mapInArrow(run, "block binary")
    found = [r.block for r in fewer.collect()]
    if None in found:
        return None
    whole = condensed_block(joined([pickle.loads(b) for b in found]), terms)
    return whole if sum(len(b[2]) for b in whole) <= KEPT else None


def dealt(spark: SparkSession, block: list, at: np.ndarray, family: str, nodes: int) -> np.ndarray:
    """Log likelihood of one block at rows of parameters; the rows are dealt to tasks where they are many."""
    u, w = rule(nodes)
    tasks = min(spark.sparkContext.defaultParallelism, len(at), len(at) * nodes * sum(len(b[2]) for b in block) // FEW)
    if tasks < 2:
        return likelihood(block, at, family, u, w) if block else np.zeros(len(at))

    def run(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                yield pa.RecordBatch.from_pydict({"i": pa.array([i]), "total": pa.array([likelihood(block, at[i::tasks], family, u, w).tobytes()], pa.binary())})

    out = np.zeros(len(at))
    if block:
        for r in spark.range(0, tasks, 1, tasks).mapInArrow(run, "i long, total binary").collect():
            out[r.i :: tasks] = np.frombuffer(r.total)
    return out


def peak(evaluate: Evaluate, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a log density is greatest, by Newton's steps on differences, and the covariance there."""
    p = len(at)
    h, pairs = np.full(p, 0.1), [(i, j) for i in range(p) for j in range(i)]
    for _ in range(50):
        e = np.diag(h)
        f = evaluate(at + np.concatenate([np.zeros((1, p)), e, -e, *(np.array([[1.0], [-1.0]]) * (e[i] + e[j]) for i, j in pairs)]))
        up, down = f[1 : p + 1], f[p + 1 : 2 * p + 1]
        slope, bend = (up - down) / (2 * h), np.diag((up + down - 2 * f[0]) / h**2)
        for c, (i, j) in enumerate(pairs):
            bend[i, j] = bend[j, i] = (f[2 * p + 1 + 2 * c] + f[2 * p + 2 + 2 * c] - up[i] - down[i] - up[j] - down[j] + 2 * f[0]) / (2 * h[i] * h[j])
        size = 1 / np.sqrt(np.maximum(np.abs(np.diag(bend)), 0.1))
        values, axes = np.linalg.eigh(-bend * np.outer(size, size))
        axes = size[:, None] * axes / np.sqrt(np.maximum(np.abs(values), 1e-3))
        move = axes @ (axes.T @ slope)
        if slope @ move < 0.01:
            break
        tries = at + move * 0.5 ** np.arange(10)[:, None]
        found = evaluate(tries)
        if not np.nanmax(found) > f[0]:
            break
        at, h = tries[np.nanargmax(found)], np.clip(0.5 * size, 1e-3, 0.1)
    return at, axes @ axes.T


class Proposal:
    """A multivariate t; ``folded`` is a coordinate whose sign means nothing."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, folded: int | None):
        self.mean, self.root, self.folded = mean, np.linalg.cholesky(cov), folded

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        z = rng.standard_normal((n, len(self.mean))) / np.sqrt(rng.chisquare(TAILS, n) / TAILS)[:, None]
        at = self.mean + z @ self.root.T
        if self.folded is not None:
            at[:, self.folded] = np.abs(at[:, self.folded])
        return at

    def log_density(self, at: np.ndarray) -> np.ndarray:
        p, sides = len(self.mean), [at]
        if self.folded is not None:
            sides.append(at * np.where(np.arange(p) == self.folded, -1, 1))
        z = [np.linalg.solve(self.root, (s - self.mean).T) for s in sides]
        return np.logaddexp.reduce([-(TAILS + p) / 2 * np.log1p((q * q).sum(0) / TAILS) for q in z]) - np.log(np.diag(self.root)).sum()


def shares(weight: np.ndarray, least: float) -> np.ndarray:
    """Weights from their logs, flattened until they are worth ``least`` equal ones (or a half of them all)."""
    power = 1.0
    while True:
        share = np.exp(power * (weight - weight.max()))
        share /= share.sum()
        if 1 / (share @ share) >= min(least, len(share) / 2):
            return share
        power *= 0.8


def sampled(evaluate: Evaluate, mean: np.ndarray, cov: np.ndarray, chains: int, tune: int, draws: int, seed: int, folded: int | None = None) -> np.ndarray:
    """``chains x draws x parameters``: Metropolis-Hastings with independent proposals.

    Proposals don't hang on the chains' states, so all of a round are evaluated at
    once.  The tuning steps go in rounds, each fitting the next one's proposals to
    its weighted points; they are fixed for the draws.
    """
    rngs = [np.random.default_rng([seed, c]) for c in range(chains)]
    p, out = len(mean), np.empty((chains, draws, len(mean)))
    proposal, state, height = Proposal(mean, cov, folded), [None] * chains, np.full(chains, -math.inf)
    sizes = [len(x) for x in np.array_split(np.arange(tune), 8) if len(x)]
    for k, size in enumerate([*sizes, draws]):
        at = np.stack([proposal.draw(rng, size) for rng in rngs])
        flat = at.reshape(-1, p)
        target = evaluate(flat)
        weight = np.where(np.isnan(target), -math.inf, target) - proposal.log_density(flat)
        for c, rng in enumerate(rngs):
            if state[c] is not None:  # the proposals have changed since
                height[c] = state[c][1] - proposal.log_density(state[c][0][None])[0]
            chance = np.log(rng.random(size))
            for i in range(size):
                j = c * size + i
                if chance[i] < weight[j] - height[c] or state[c] is None:
                    state[c], height[c] = (flat[j], target[j]), weight[j]
                if k == len(sizes):
                    out[c, i] = state[c][0]
        if k < len(sizes) and len(flat) > 4 * p:
            share = shares(weight, 20 * p)
            mean = share @ flat
            proposal = Proposal(mean, (share[:, None] * (flat - mean)).T @ (flat - mean), folded)
    return out
