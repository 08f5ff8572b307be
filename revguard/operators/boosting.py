"""Second-order boosted trees with gamma, L1 and L2 penalties, trained once.

Every feature is cut at quantiles of the training rows, and a row is kept as one byte per feature.  A tree grows level
by level: each task adds up the gradients and Hessians of its rows per (node, feature, bin), one aggregate sums these
cells, and the driver takes the best cut per node from them.  Of two nodes with the same parent only the lighter one is
added up, the other is the parent's cells less these.  What a level sends to the driver is bounded by
nodes x features x bins, whatever the number of rows.  The sums are of fixed-point integers, so neither the order of the
tasks nor a task that runs again changes a tree.

A round needs only the margins of those before it, so no round is trained twice.  The first level of a round adds the tree
before it to the margins and keeps these with the round's gradients (cached; written every ``fold_every`` rounds, a reliable
checkpoint), so no level goes through an older tree; it also counts the validation rows by label and score bin, which gives
the AUC of the rounds so far without another pass.

A job per level costs more than its sums while the rows are few.  Where they fit the tasks that run at a time (at most
``resident_rows`` each), the training is one job per ``job_rounds`` rounds instead: its tasks start together (a barrier stage),
keep their rows, add up their cells through files in the checkpoint folder, and all take the same cuts from the same sums.
Rows, sums and trees are as with a job per level, which remains for more rows, for a checkpoint folder that the tasks cannot
open as files, and under dynamic allocation.

Rows without a label are left out; a missing or NaN value is above every cut.  If the validation rows do not hold both
labels, all rounds are trained and kept.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revguard.session import cut_lineage, ensure_checkpoint_dir
from revguard.sources.sinks import delete

FIXED = float(1 << 24)  # gradients and Hessians are summed in steps of 2^-24
AUC_BINS = 4096
RESIDENT_ROWS = 1 << 21  # rows that a task keeps when it trains many rounds: some 200 MB
RESIDENT_TASKS = 64  # each of these reads the cells of all others
BLOCK_ROWS = 1 << 16  # that such a task takes at a time
WAIT_S = 900  # for another task's cells; Spark itself ends the tasks of a barrier stage of which one has failed


@dataclass(frozen=True)
class Penalties:
    """Step size and the bounds that a split and a leaf obey."""
    step: float = 0.05
    depth: int = 6
    min_child_weight: float = 5.0
    gamma: float = 1.0
    l1: float = 0.1
    l2: float = 1.0


@dataclass
class Tree:
    """Nodes by number; ``feature`` is -1 at a leaf, a row goes left if its bin is at most ``cut``."""
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    grad: list = field(default_factory=list)
    hess: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, grad: float, hess: float) -> int:
        for column, value in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.grad, grad),
                              (self.hess, hess), (self.gain, 0.)):
            column.append(value)
        return len(self.feature) - 1

    def arrays(self, p: Penalties):
        return (*(np.array(c, np.int64) for c in (self.feature, self.cut, self.left, self.right)),
                leaf_value(np.array(self.grad), np.array(self.hess), p))


def shrunk(grad, l1: float):
    """The gradient sum moved towards zero by the L1 penalty."""
    return np.sign(grad) * np.maximum(np.abs(grad) - l1, 0.)


def leaf_value(grad, hess, p: Penalties):
    return -p.step * shrunk(grad, p.l1) / (hess + p.l2)


def quality(grad, hess, p: Penalties):
    """What a node's best value takes off the objective, twice."""
    return shrunk(grad, p.l1) ** 2 / np.maximum(hess + p.l2, 1e-16)


def best_split(grad: np.ndarray, hess: np.ndarray, p: Penalties):
    """(gain, feature, bin, grad left, hess left) of one node's cells (features x bins), or None.

    Both sides need ``min_child_weight``; equal gains go to the lower feature, then the lower bin.
    """
    g, h = grad[0].sum(), hess[0].sum()
    gl, hl = grad.cumsum(1), hess.cumsum(1)
    gain = quality(gl, hl, p) + quality(g - gl, h - hl, p) - quality(g, h, p)
    fits = (hl >= p.min_child_weight) & (h - hl >= p.min_child_weight) & (hl > 0) & (h - hl > 0)
    gain = np.where(fits, gain, -np.inf)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return (gain[f, b], int(f), int(b), gl[f, b], hl[f, b]) if gain[f, b] > 1e-6 else None


def prune(tree: Tree, gamma: float) -> None:
    """Takes back splits over two leaves that gain less than ``gamma``, from the bottom up."""
    for i in reversed(range(len(tree.feature))):
        if tree.feature[i] >= 0 and tree.gain[i] < gamma and tree.feature[tree.left[i]] < 0 and tree.feature[tree.right[i]] < 0:
            tree.feature[i], tree.left[i], tree.right[i], tree.gain[i] = -1, -1, -1, 0.


def step_down(x: np.ndarray, arrays):
    """Which nodes have children, and a function from each row's node to the child that its bins lead to."""
    feature, cut, left, right = arrays[:4]
    inner, own = feature >= 0, np.arange(len(feature))
    # A leaf is its own child on both sides.  The bins are taken column by column, as ``row_blocks`` lays them out.
    child = np.column_stack([np.where(inner, left, own), np.where(inner, right, own)]).ravel()
    start, cut, bins = np.where(inner, feature, 0) * len(x), cut.astype(x.dtype), x.ravel(order="F")
    rows = np.arange(len(x))
    return inner, lambda at: child.take(2 * at + (bins.take(start.take(at) + rows) > cut.take(at)))


def leaves(x: np.ndarray, arrays) -> np.ndarray:
    """The leaf that each row of bins falls into."""
    inner, down = step_down(x, arrays)
    at = np.zeros(len(x), np.int64)
    while inner.take(at).any():
        at = down(at)
    return at


def sampled(u: np.ndarray, turn: int, seed: int, share: float) -> np.ndarray:
    """Rows that a round looks at, by their key's hash: the same ones however the rows are spread over tasks."""
    with np.errstate(over="ignore"):
        z = u.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) % (1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) < share * (1 << 53)


def area(pos: np.ndarray, neg: np.ndarray) -> float | None:
    """ROC-AUC of counts per ascending score bin, ties half; None without both labels."""
    if not pos.sum() or not neg.sum():
        return None
    above = pos.sum() - pos.cumsum()
    return float((neg * (above + pos * .5)).sum() / (pos.sum() * neg.sum()))


def best_round(aucs: list, patience: int) -> tuple[int, bool]:
    """(rounds up to the best AUC, whether ``patience`` rounds without a better one were seen)."""
    best = 0
    for r, auc in enumerate(aucs):
        if auc > aucs[best]:
            best = r
        elif r - best >= patience:
            return best + 1, True
    return best + 1, False


def edges_of(train: DataFrame, cols: list[str], max_bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each feature, the least value among them: one aggregate, features apart."""
    at = [i / max_bins for i in range(max_bins)]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    found = dict(train.select(F.posexplode(values).alias("feature", "value")).where("not isnan(value)")
                 .groupBy("feature").agg(F.percentile_approx("value", at, 10_000)).collect())
    return [np.unique(np.array(found.get(j) or [0.], float)) for j in range(len(cols))]


def row_blocks(train: DataFrame, val: DataFrame, cols: list[str], edges: list[np.ndarray], label: str, id_col: str,
               resident_rows: int = 0) -> tuple[RDD, int]:
    """Blocks (u, x, y, held, margin) of labelled rows: key hashes, a byte per feature, labels, validation rows, margins.

    A block is one Arrow batch, so a partition of any length is read block by block.  The bytes of a feature lie together.
    Also the number of tasks that can keep all rows at once, dealt out evenly then; 0 if none can.
    """
    both = train.withColumn("_held", F.lit(False)).unionByName(val.withColumn("_held", F.lit(True)))
    wide = both.where(F.col(label).isNotNull()).select(
        F.xxhash64(id_col).alias("u"), F.col(label).cast("int").alias("y"), F.col("_held").alias("held"),
        *[F.col(f"`{c}`").cast("double").alias(f"c{j}") for j, c in enumerate(cols)])
    tasks = tasks_at_once(train.sparkSession) if resident_rows else 0
    if tasks and wide.count() <= tasks * resident_rows:
        wide = wide.repartition(tasks)
    else:
        tasks = 0

    def run(batches):
        for b in batches:
            x = np.empty((b.num_rows, len(edges)), np.uint8)
            for j, e in enumerate(edges):
                x[:, j] = np.searchsorted(e, b.column(f"c{j}").to_numpy(zero_copy_only=False).astype(float))
            u, y, held = (b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "y", "held"))
            yield pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in (
                ("u", u.astype(np.int64)), ("x", x), ("y", y.astype(np.int8)), ("held", held.astype(bool)))})

    def opened(row):
        y = np.frombuffer(row.y, np.int8)
        return (np.frombuffer(row.u, np.int64), np.asfortranarray(np.frombuffer(row.x, np.uint8).reshape(len(y), -1)), y,
                np.frombuffer(row.held, bool), np.zeros(len(y)))

    blocks = cut_lineage(wide.mapInArrow(run, "u binary, x binary, y binary, held binary"))
    if tasks and blocks.rdd.getNumPartitions() == tasks:
        return blocks.rdd.map(opened), tasks
    return blocks.coalesce(train.sparkSession.sparkContext.defaultParallelism).rdd.map(opened), 0


def tasks_at_once(spark: SparkSession) -> int:
    """How many tasks of a barrier stage start together here; 0 where that cannot be told."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0  # barrier stages do not run under it
    context = sc._jsc.sc()
    slots = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
    return min(slots, sc.defaultParallelism, RESIDENT_TASKS)


def moved(x: np.ndarray, margin: np.ndarray, trees: list) -> np.ndarray:
    """Margins with ``trees`` added in their order."""
    margin = margin.copy()
    for t in trees:
        margin += t[4][leaves(x, t)]
    return margin


def with_gradients(blocks: RDD, trees: list, *, pos_weight: float, turn: int, seed: int, subsample: float) -> RDD:
    """The blocks with ``trees`` added to their margins, and a round's gradients and Hessians in steps of 2^-24.

    Both are 0 for rows that the round does not look at; the Hessian of others is at least one step.
    """
    return blocks.map(lambda block: graded(block, trees, pos_weight=pos_weight, turn=turn, seed=seed, subsample=subsample)) \
        .persist(StorageLevel.MEMORY_AND_DISK)


def graded(block, trees: list, *, pos_weight: float, turn: int, seed: int, subsample: float):
    """One block of ``with_gradients``."""
    u, x, y, held, margin = block[:5]
    margin = moved(x, margin, trees)
    score = 1 / (1 + np.exp(-margin))
    seen = ~held & sampled(u, turn, seed, subsample)
    w = np.where(y == 1, pos_weight, 1.) * seen
    g = np.rint(w * (score - y) * FIXED)
    h = np.rint(np.maximum(w * score * (1 - score), seen / FIXED) * FIXED)
    return u, x, y, held, margin, g, h


def held_counts(y: np.ndarray, held: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Validation rows by score bin and label."""
    at = np.minimum((1 / (1 + np.exp(-margin[held])) * AUC_BINS).astype(int), AUC_BINS - 1)
    return np.bincount(at * 2 + y[held], minlength=2 * AUC_BINS)


def cell_ends(n_slots: int, used: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Where the cells of each used feature end."""
    return n_slots * np.cumsum(widths[used])


def add_cells(cells: np.ndarray, x: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray,
              widths: np.ndarray, n_slots: int) -> None:
    """Adds the gradients and Hessians of rows that have a slot to ``cells`` (2 x all cells)."""
    k = np.flatnonzero((slot >= 0) & (h > 0))
    slot, g, h = slot[k], g[k], h[k]
    for f, end in zip(used, cell_ends(n_slots, used, widths)):
        n = n_slots * widths[f]
        cell = slot * widths[f] + x[:, f].take(k)
        cells[0, end - n: end] += np.bincount(cell, g, n).astype(np.int64)
        cells[1, end - n: end] += np.bincount(cell, h, n).astype(np.int64)


def by_slot(cells: np.ndarray, n_slots: int, used: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Cells as 2 x slots x used features x bins."""
    out = np.zeros((2, n_slots, len(used), widths.max()), np.int64)
    for j, (f, end) in enumerate(zip(used, cell_ends(n_slots, used, widths))):
        out[:, :, j, : widths[f]] = cells[:, end - n_slots * widths[f]: end].reshape(2, n_slots, -1)
    return out


def level_cells(blocks: RDD, tree, slots: np.ndarray, used: np.ndarray, widths: np.ndarray, *, count_held: bool):
    """Summed gradients and Hessians (slots x used features x bins) of one level, and label counts per score bin.

    Each task adds up its blocks; a feature has as many cells per slot as it has bins (``widths``).
    """
    n_slots = int(slots.max()) + 1
    size = int(cell_ends(n_slots, used, widths)[-1])

    def run(part):
        cells, seen = np.zeros((2, size), np.int64), np.zeros(2 * AUC_BINS if count_held else 0, np.int64)
        for _, x, y, held, margin, g, h in part:
            if count_held and held.any():
                seen += held_counts(y, held, margin)
            add_cells(cells, x, slots.take(leaves(x, tree)), g, h, used, widths, n_slots)
        yield cells, seen

    # Up to 64 tasks' cells (under 1 MB each) go to the driver as they are; more are summed in the executors first.
    depth = 1 if blocks.getNumPartitions() <= 64 else 2
    cells, seen = blocks.mapPartitions(run).treeReduce(lambda a, b: tuple(m + n for m, n in zip(a, b)), depth)
    return by_slot(cells, n_slots, used, widths), seen.reshape(-1, 2)


def grow(root: np.ndarray, next_level, used: np.ndarray, p: Penalties) -> Tree:
    """A tree from the root's cells; ``next_level(tree, slots)`` gives those of the nodes it is asked for."""
    tree = Tree()
    cells = {tree.add(*(root[:, 0, 0] / FIXED).sum(1)): root[:, 0]}  # by node that may split on
    pairs = []  # split nodes with the children that may split on, the lighter one first
    for depth in range(p.depth):
        if depth:
            slots = np.full(len(tree.feature), -1, np.int64)
            slots[[own[0] for _, own in pairs]] = np.arange(len(pairs))
            got, parents = next_level(tree, slots), cells
            cells = {own[0]: got[:, i] for i, (_, own) in enumerate(pairs)}
            cells |= {own[1]: parents[node] - got[:, i] for i, (node, own) in enumerate(pairs) if len(own) > 1}
        pairs = []
        for node in sorted(cells):
            found = best_split(*(cells[node] / FIXED), p)
            if found:
                tree.gain[node], f, tree.cut[node], gl, hl = found
                tree.feature[node] = int(used[f])
                tree.left[node] = tree.add(gl, hl)
                tree.right[node] = tree.add(tree.grad[node] - gl, tree.hess[node] - hl)
                own = [i for i in (tree.left[node], tree.right[node]) if tree.hess[i] >= 2 * p.min_child_weight]
                if own:
                    pairs.append((node, sorted(own, key=lambda i: tree.hess[i])))
        if not pairs:
            break
    prune(tree, p.gamma)
    return tree


def fit(train: DataFrame, val: DataFrame, cols: list[str], *, label: str = "label", id_col: str = "invoice_id",
        rounds: int = 600, patience: int = 40, pos_weight: float = 1.0, subsample: float = 0.8, col_sample: float = 0.8,
        max_bins: int = 64, seed: int = 42, penalties: Penalties = Penalties(), fold_every: int = 16, resident_rows: int = 0,
        job_rounds: int = 200):
    """(trees up to the best validation AUC, cuts per feature, AUC after each round that was trained).

    ``resident_rows``: how many rows a task may keep, to train ``job_rounds`` rounds in a job; 0 for a job per level.
    """
    if not 2 <= max_bins <= 255:
        raise ValueError("max_bins must be from 2 to 255: a bin is one byte")
    p = penalties
    edges = edges_of(train, cols, max_bins)
    widths, n_used = np.array([len(e) + 1 for e in edges]), max(1, int(col_sample * len(cols)))
    blocks, tasks = row_blocks(train, val, cols, edges, label, id_col, resident_rows)
    if tasks:
        found = fit_resident(train.sparkSession, blocks, widths, p, rounds=rounds, patience=patience, pos_weight=pos_weight,
                             subsample=subsample, n_used=n_used, seed=seed, job_rounds=job_rounds)
        if found:
            return found[0], edges, found[1]
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    trees, aucs = [], []
    root = root_only(p)
    try:
        while True:
            turn, newest = len(trees), [t.arrays(p) for t in trees[-1:]]
            if turn and turn % fold_every == 0:
                blocks, old, newest = folded(blocks, newest), blocks, []
                old.unpersist()
            blocks, old = with_gradients(blocks, newest, pos_weight=pos_weight, turn=turn, seed=seed, subsample=subsample), blocks
            used = features_of(turn, len(cols), n_used, seed)

            def cells(tree, slots, count_held=False):
                return level_cells(blocks, tree, slots, used, widths, count_held=count_held)

            first, seen = cells(root, np.zeros(1, np.int64), turn > 0)
            old.unpersist()
            if turn:
                aucs.append(area(seen[:, 1], seen[:, 0]))
                keep, stopped = (turn, False) if aucs[-1] is None else best_round(aucs, patience)
                if stopped or turn >= rounds:
                    return trees[:keep], edges, aucs
            trees.append(grow(first, lambda tree, slots: cells(tree.arrays(p), slots)[0], used, p))
    finally:
        blocks.unpersist()


def root_only(p: Penalties):
    """The arrays of a tree that is one leaf."""
    tree = Tree()
    tree.add(0., 0.)
    return tree.arrays(p)


def features_of(turn: int, n: int, n_used: int, seed: int) -> np.ndarray:
    """The features that a round looks at."""
    return np.sort(np.random.default_rng([seed, turn]).permutation(n)[:n_used])


class Exchange:
    """Sums integer arrays over the tasks of a barrier stage, through files in a folder that all of them see.

    A file is renamed when it is written, so it appears whole.  A task that has read all files of a turn has seen every task
    write, and so end the turn before: its own file of that turn can go.
    """
    def __init__(self, folder: str, rank: int, tasks: int):
        self.folder, self.rank, self.tasks, self.turn = folder, rank, tasks, 0
        os.makedirs(folder, exist_ok=True)

    def name(self, turn: int, rank: int) -> str:
        return os.path.join(self.folder, f"{turn}-{rank}")

    def read(self, name: str) -> np.ndarray:
        until = time.monotonic() + WAIT_S
        while True:
            try:
                with open(name, "rb") as f:
                    return np.frombuffer(f.read(), np.int64)
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"no cells of another task within {WAIT_S} s: {name}") from None
                time.sleep(5e-4)

    def total(self, own: np.ndarray) -> np.ndarray:
        mine = self.name(self.turn, self.rank)
        own.tofile(f"{mine}.part")
        os.replace(f"{mine}.part", mine)
        out = own.copy()
        for rank in range(self.tasks):
            if rank != self.rank:
                out += self.read(self.name(self.turn, rank))
        if self.turn:
            os.remove(self.name(self.turn - 1, self.rank))
        self.turn += 1
        return out


def fit_resident(spark: SparkSession, blocks: RDD, widths: np.ndarray, p: Penalties, *, rounds: int, job_rounds: int, **options):
    """(trees, AUCs) as ``fit`` gives them, by a barrier stage per ``job_rounds`` rounds; None if its tasks see no common folder.

    A stage of which a task fails runs again as a whole, from the trees of the stages before it.
    """
    top = local_folder(spark)
    if top is None:
        return None
    folder = os.path.join(top, f"boosting-{uuid.uuid4().hex}")
    os.makedirs(folder)
    try:
        trees, aucs, done = [], [], False
        while not done:
            def run(part, trees=trees, aucs=aucs):
                task = BarrierTaskContext.get()
                names = task.allGather(uuid.uuid4().hex if os.path.isdir(folder) else "")
                if all(names):  # an attempt has a folder of its own, named by its first task
                    rank = task.partitionId()
                    found = rounds_here(list(part), Exchange(os.path.join(folder, names[0]), rank, len(names)).total, widths, p,
                                        trees, aucs, rounds=rounds, until=len(trees) + job_rounds, **options)
                    if rank == 0:
                        yield found

            found = blocks.barrier().mapPartitions(run).collect()
            if not found:
                return None
            trees, aucs, done = found[0]
        return trees, aucs
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def local_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder as a path that ``open`` takes; None if it is on no file system of the hosts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return path.getPath() if path.getScheme() == "file" else None


def merged(blocks: list) -> list:
    """The blocks put together to fewer of about ``BLOCK_ROWS`` rows."""
    out, some = [], []
    for block in blocks:
        some.append(block)
        if sum(len(b[0]) for b in some) >= BLOCK_ROWS or block is blocks[-1]:
            u, x, *rest = zip(*some)
            out.append((np.concatenate(u), np.concatenate([b.T for b in x], axis=1).T, *map(np.concatenate, rest)))
            some = []
    return out


def rounds_here(blocks: list, total, widths: np.ndarray, p: Penalties, trees: list[Tree], aucs: list, *, rounds: int, until: int,
                patience: int, pos_weight: float, subsample: float, n_used: int, seed: int):
    """(trees, AUCs, whether training is over) after rounds up to number ``until`` over blocks that this task keeps.

    ``total`` sums an array over all tasks, so each of them grows the same trees.
    """
    blocks = merged(blocks)
    trees, aucs, newest = list(trees), list(aucs), [t.arrays(p) for t in trees]
    while len(trees) < until:
        turn = len(trees)
        used = features_of(turn, len(widths), n_used, seed)
        rows = []  # of those that the round looks at: bins, gradients, Hessians; their nodes
        at = []
        seen = np.zeros(2 * AUC_BINS, np.int64)
        for i, block in enumerate(blocks):
            _, x, y, held, margin, g, h = graded(block, newest, pos_weight=pos_weight, turn=turn, seed=seed, subsample=subsample)
            blocks[i] = *block[:4], margin
            if turn and held.any():
                seen += held_counts(y, held, margin)
            k = np.flatnonzero(h > 0)
            rows.append((x.T.take(k, axis=1).T, g[k], h[k]))
            at.append(np.zeros(len(k), np.int64))

        def cells(slots, more=()):
            n_slots = int(slots.max()) + 1
            own = np.zeros((2, int(cell_ends(n_slots, used, widths)[-1])), np.int64)
            for (x, g, h), nodes in zip(rows, at):
                add_cells(own, x, slots.take(nodes), g, h, used, widths, n_slots)
            sums = total(np.concatenate([own.ravel(), *more]))
            return by_slot(sums[: own.size].reshape(2, -1), n_slots, used, widths), sums[own.size:]

        def next_level(tree, slots):
            arrays = tree.arrays(p)
            at[:] = [step_down(x, arrays)[1](nodes) for (x, _, _), nodes in zip(rows, at)]
            return cells(slots)[0]

        first, seen = cells(np.zeros(1, np.int64), [seen])
        if turn:
            seen = seen.reshape(-1, 2)
            aucs.append(area(seen[:, 1], seen[:, 0]))
            keep, stopped = (turn, False) if aucs[-1] is None else best_round(aucs, patience)
            if stopped or turn >= rounds:
                return trees[:keep], aucs, True
        trees.append(grow(first, next_level, used, p))
        newest = [trees[-1].arrays(p)]
    return trees, aucs, False


def folded(blocks: RDD, trees: list) -> RDD:
    """The blocks with ``trees`` added to their margins, written once (a reliable checkpoint)."""
    after = blocks.map(lambda b: (*b[:4], moved(b[1], b[4], trees))).persist(StorageLevel.MEMORY_AND_DISK)
    after.checkpoint()
    after.count()
    return after


def as_model(trees: list[Tree], edges: list[np.ndarray], cols: list[str], p: Penalties) -> PipelineModel:
    """The trees as a ``pyspark.ml`` model, so that scoring, saving and attributions run as for any boosted model.

    That model's probability is the logistic function of twice its margin, so node values are halved.  A node carries its
    summed Hessian as cover; its gain is divided by that, so importances are summed gains.

    A model of as many single leaves is saved, its table of nodes is replaced and it is read back: nodes made one by one in the
    JVM cost several calls each.
    """
    spark = SparkSession.getActiveSession()
    sc = spark.sparkContext
    ml, new_array, double = sc._jvm.org.apache.spark.ml, sc._gateway.new_array, sc._jvm.double
    tree_model = ml.regression.DecisionTreeRegressionModel
    leaf = ml.tree.LeafNode(0., 0., sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(new_array(double, 3), 0))
    built = new_array(tree_model, len(trees))
    weights = new_array(double, len(trees))
    for t in range(len(trees)):
        built[t], weights[t] = tree_model(f"boosted-tree-{t}", leaf, len(cols)), 1.
    gbt = GBTClassificationModel(ml.classification.GBTClassificationModel("boosted-trees", built, weights, len(cols), 2))
    gbt._resetUid("boosted-trees")
    gbt.setFeaturesCol("features").setPredictionCol("gbt_prediction")
    gbt.setProbabilityCol("gbt_probability").setRawPredictionCol("gbt_raw")
    path = os.path.join(ensure_checkpoint_dir(spark), f"gbt-{uuid.uuid4().hex}")
    try:
        gbt.write().save(path)
        table = spark.read.parquet(os.path.join(path, "data")).schema
        rows = [named(table, {"treeID": t, "nodeData": node}) for t, tree in enumerate(trees) for node in saved_nodes(tree, edges, p)]
        spark.createDataFrame(rows, table, verifySchema=False).write.mode("overwrite").parquet(os.path.join(path, "data"))
        gbt = GBTClassificationModel.load(path)
    finally:
        delete(spark, path)
    return PipelineModel([VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep"), gbt])


def saved_nodes(tree: Tree, edges: list[np.ndarray], p: Penalties) -> list[dict]:
    """The nodes that can be reached, parents before children, as ``pyspark.ml`` saves them."""
    value = leaf_value(np.array(tree.grad), np.array(tree.hess), p) / 2
    order, todo = [], [0]
    while todo:
        i = todo.pop()
        order.append(i)
        if tree.feature[i] >= 0:
            todo += [tree.right[i], tree.left[i]]
    at = {i: k for k, i in enumerate(order)} | {-1: -1}
    out = []
    for i in order:
        f, hess, v = tree.feature[i], float(tree.hess[i]), float(value[i])
        split = {"featureIndex": f, "leftCategoriesOrThreshold": [float(edges[f][tree.cut[i]])] if f >= 0 else [], "numCategories": -1}
        out.append({"id": at[i], "prediction": v, "impurity": 0., "impurityStats": [hess, float(v * hess), float(v ** 2 * hess)],
                    "rawCount": int(hess), "gain": float(tree.gain[i] / hess) if f >= 0 else -1., "leftChild": at[tree.left[i]],
                    "rightChild": at[tree.right[i]], "split": split})
    return out


def named(schema, row: dict) -> tuple:
    """The row's values in the order of the schema's fields."""
    return tuple(named(f.dataType, row[f.name]) if isinstance(row[f.name], dict) else row[f.name] for f in schema.fields)
