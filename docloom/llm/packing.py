"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights.

Documents become token pieces; only pieces' *lengths* reach the solver, as a histogram of at most ``capacity`` entries, so
the driver's work is the same for a thousand documents and for a trillion.

1. Covering program: the fewest configurations (multisets of lengths that fit a sequence) that cover the histogram.
   Multiplicative weights price the lengths; each round a knapsack dynamic program finds the configurations of largest
   price (for several slightly disturbed price vectors at once), which are taken until the scarcest of their lengths is covered
   once more, and their lengths' prices fall accordingly. Any prices give a lower bound of the program (demand times
   price over the best configuration's price), and the shares taken, scaled until every length is covered, an upper one.
2. Rounding: whole multiples of the shares where those are large; and whole multiples of configurations priced anew under the
   learned prices, with weights that keep all lengths' remaining shares together. What is left of either (a tenth,
   three tenths or a half of the items, whatever gives the fewest sequences) is packed best-fit decreasing, group by group
   of equal bins. Rounds go on until the plan is within ``GAP`` of the lower bound or ``ROUNDS`` are over. The plan is never
   longer than that of best-fit decreasing alone; ties go to the program's.
3. The plan is ranges ("items 100..199 of length 37 fill place 2 of configuration 5"). An item's number among its length
   is a count within its task plus a prefix over tasks, both computed by Spark; the plan itself is broadcast (its size is
   bounded by the configurations' number times the capacity).

Defined results: null text counts as empty; an empty document has its end token. Longer documents are cut into full
pieces, the first piece being the shorter one. Repeated ids give pieces of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.bpe import loaded
from docloom.llm.common import materialize, read_table, spread, tokenizer_path

CAPACITY = 1024
#: Rounds of pricing at most (each prices ``BATCH`` vectors), and the distance to the lower bound that ends them.
ROUNDS, BATCH, GAP = 800, 16, 0.005
Config = tuple[tuple[int, int], ...]  # (length, copies), longest first


def best_configurations(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[list[Config], np.ndarray]:
    """Knapsack pricing: for each row of ``weights``, the multiset of (sorted) ``lengths`` within ``capacity`` of largest total weight."""
    rows, low = np.arange(len(weights)), int(lengths[0])
    price = np.full((len(weights), capacity + 1), -1.0)
    price[:, lengths] = weights
    value, choice = np.zeros((len(weights), capacity + 1)), np.zeros((len(weights), capacity + 1), np.int32)
    for c in range(low, capacity + 1):
        gains = (value[:, c - low :: -1] if c > low else value[:, :1]) + price[:, low : c + 1]
        k = gains.argmax(1)
        better = gains[rows, k] > value[:, c - 1]
        value[:, c] = np.where(better, gains[rows, k], value[:, c - 1])
        choice[:, c] = np.where(better, k + low, 0)
    found = []
    for row in choice:
        config: dict[int, int] = {}
        c = capacity
        while c >= low:
            n = int(row[c])
            config[n] = config.get(n, 0) + 1
            c -= n or 1
        config.pop(0, None)
        found.append(tuple(sorted(config.items(), reverse=True)))
    return found, value[:, capacity]


class CoveringProgram:
    """Multiplicative weights on the covering program of a histogram (``lengths`` ascending, ``counts`` positive)."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 7):
        self.lengths, self.counts, self.capacity = lengths, counts, capacity
        self.rng, self.place = np.random.default_rng(seed), np.zeros(capacity + 1, np.int64)
        self.place[lengths] = np.arange(len(lengths))
        self.log_price = np.log(lengths / capacity)
        self.prices = lengths / capacity  # the dual solution of the best bound so far: no configuration is worth more than 1
        self.bound = float(self.prices @ counts)
        self.value, self.shares = np.inf, []  # of the best feasible cover so far
        self.step, self.window = 0.1, 8
        self._restart()

    def _restart(self) -> None:
        """Forget the shares of rounds whose prices were still far off; the prices stay."""
        self.taken: dict[Config, float] = {}
        self.covered, self.rounds = np.zeros(len(self.lengths)), 0

    def _disturbed(self, weights: np.ndarray, noise: float) -> np.ndarray:
        out = weights * np.exp(noise * self.rng.standard_normal((BATCH, len(weights))))
        out[0] = weights
        return out

    def items(self, config: Config) -> tuple[np.ndarray, np.ndarray]:
        return self.place[[n for n, _ in config]], np.array([c for _, c in config])

    def run(self, rounds: int) -> None:
        demand = self.counts.astype(float)
        for _ in range(rounds):
            weights = self._disturbed(np.exp(self.log_price - self.log_price.max()), 0.02)
            found, worth = best_configurations(self.lengths, weights, self.capacity)
            bounds = weights @ demand / worth
            k = int(bounds.argmax())
            if bounds[k] > self.bound:
                self.bound, self.prices = float(bounds[k]), weights[k] / worth[k]
            for config in dict.fromkeys(found):
                at, copies = self.items(config)
                amount = float((demand[at] / copies).min())
                self.taken[config] = self.taken.get(config, 0.0) + amount
                self.covered[at] += amount * copies
                self.log_price[at] -= self.step * amount * copies / demand[at]
            self.rounds += 1
            if self.rounds >= self.window:
                self._keep()
                self._restart()
                self.window, self.step = self.window * 2, self.step * 0.7
        self._keep()

    def _keep(self) -> None:
        """The shares since the last restart as a feasible cover: scaled, with sequences of one length for what stays uncovered."""
        share = self.covered / self.counts
        for q in (0, 0.02, 0.1, 0.3):
            scale = float(np.quantile(share, q))
            if scale <= 0:
                continue
            short = np.maximum(0, self.counts - self.covered / scale) / (self.capacity // self.lengths)
            value = sum(self.taken.values()) / scale + float(short.sum())
            if value < self.value:
                alone = [(((int(n), self.capacity // int(n)),), float(x)) for n, x in zip(self.lengths, short, strict=True) if x]
                self.value, self.shares = value, [(k, v / scale) for k, v in self.taken.items()] + alone

    def draw_down(self, leave: float = 0.1) -> list[tuple[Config, int]]:
        """Whole multiples of priced configurations until ``leave`` of the volume is left; all lengths shrink alike.

        Only configurations worth (nearly) a sequence under the best prices count: others belong to no good cover.
        """
        left, plan = self.counts.copy(), []
        volume = float(self.lengths @ left)
        while left.any() and self.lengths @ left > leave * volume:
            here = np.flatnonzero(left)
            share = left[here] / self.counts[here]
            weights = self._disturbed(self.prices[here] * np.exp(share - share.mean()), 0.002)
            before = len(plan)
            for config in best_configurations(self.lengths[here], weights, self.capacity)[0]:
                at, copies = self.items(config)
                times = int((left[at] // copies).min())
                if times and self.prices[at] @ copies >= 1 - 0.2 / self.capacity:
                    times = max(1, times // 2)
                    left[at] -= times * copies
                    plan.append((config, times))
            if len(plan) == before:
                break
        return plan


def whole_multiples(shares: list[tuple[Config, float]], left: dict[int, int]) -> list[tuple[Config, int]]:
    """Whole parts of the shares, best filled configurations first; takes the items from ``left``."""
    plan = []
    for config, share in sorted(shares, key=lambda x: (-sum(n * c for n, c in x[0]), -x[1])):
        times = min([int(share), *(left[n] // c for n, c in config)])
        if times:
            plan.append((config, times))
            for n, c in config:
                left[n] -= c * times
    return plan


def best_fit_decreasing(left: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit decreasing on a histogram: equal bins are handled as one group, so the work doesn't grow with the counts."""
    groups: dict[int, dict[Config, int]] = {}
    for n in sorted((n for n in left if left[n]), reverse=True):
        items = left[n]
        while items:
            space = min((s for s, g in groups.items() if s >= n and g), default=capacity)
            group = groups.get(space) if space in groups and groups[space] else None
            config, bins = next(iter(group.items())) if group else ((), items)
            each = min(space // n, items)
            used = min(bins, items // each)
            if group:
                if used == bins:
                    del group[config]
                else:
                    group[config] = bins - used
            grown = (*config, (n, each))
            target = groups.setdefault(space - n * each, {})
            target[grown] = target.get(grown, 0) + used
            items -= used * each
    return [(config, bins) for g in groups.values() for config, bins in g.items()]


@dataclass
class Plan:
    """sequences: (configuration, how many), whose items are exactly the histogram; from_program: how many of those (full pieces
    aside) the program's configurations make up; bound: sequences that any plan needs at least."""

    sequences: list[tuple[Config, int]]
    from_program: int
    bound: float

    @property
    def count(self) -> int:
        return sum(t for _, t in self.sequences)


def plan_sequences(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, gap: float = GAP) -> Plan:
    """The best of the program's roundings and of best-fit decreasing alone."""
    items = {n: c for n, c in zip(map(int, lengths), map(int, counts), strict=True) if c}
    full = items.pop(capacity, 0)
    whole = [(((capacity, 1),), full)] if full else []
    if not items:
        return Plan(whole, 0, full)
    best = Plan(best_fit_decreasing(dict(items), capacity), 0, 0)

    def offer(part: list[tuple[Config, int]]) -> None:
        nonlocal best
        rest = dict(items)
        for config, times in part:
            for n, c in config:
                rest[n] -= c * times
        made = sum(t for _, t in part)
        plan = Plan(part + best_fit_decreasing(rest, capacity), made, 0)
        if (plan.count, -made) < (best.count, -best.from_program):
            best = plan

    keys = np.array(sorted(items), np.int64)
    program = CoveringProgram(keys, np.array([items[int(k)] for k in keys]), capacity)
    done, part = 0, min(100, rounds)
    while done < rounds:
        program.run(part)
        done += part
        offer(whole_multiples(program.shares, dict(items)))
        drawn = program.draw_down()
        volume = float(program.lengths @ program.counts)
        for share in (0.9, 0.7, 0.5):
            used, upto = 0.0, 0
            while upto < len(drawn) and used < share * volume:
                used += drawn[upto][1] * sum(n * c for n, c in drawn[upto][0])
                upto += 1
            offer(drawn[:upto])
        if best.count <= np.ceil(program.bound - 1e-6) * (1 + gap):
            break
        part = min(2 * part, rounds - done)
    return Plan(whole + best.sequences, best.from_program, full + program.bound)


def place_ranges(plan: list[tuple[Config, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first item number, first sequence, offset): consecutive items fill consecutive sequences."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for config, times in plan:
        offset = 0
        for n, copies in config:
            for _ in range(copies):
                rows.setdefault(n, []).append((used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + times
                offset += n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def cut_pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(task, nth, doc_id, piece, start, length, ids_crc32[, ids]); ``nth`` counts a task's pieces of one length."""
    fields = [("task", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, task = loaded(path, library=True), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((task, int(seen[length]), doc, k, start, length, zlib.crc32(own)) + (own,) * with_ids)
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "task int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, ddl)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Give every piece of a *stored* ``token_pieces`` table its sequence_id and offset."""
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # at most ``capacity`` rows
    plan = plan_sequences(histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), capacity, rounds)
    ranges = spark.sparkContext.broadcast(place_ranges(plan.sequences))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    numbered = pieces.join(before, ["length", "task"])
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    schema_of = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            number = b.column("nth").to_numpy() + b.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), ranges.value[int(n)]
                k = np.searchsorted(rows[:, 0], number[at], side="right") - 1
                sequence[at] = rows[k, 1] + number[at] - rows[k, 0]
                offset[at] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    ddl = ", ".join(f"{c} {schema_of[c]}" for c in kept) + ", sequence_id long, offset long"
    return numbered.mapInArrow(run, ddl)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset of every piece of every document."""
    return pack(materialize(token_pieces(docs, path, capacity, end_id, with_ids=with_ids), "pieces"), capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): whole sequences from ``pack_documents(with_ids=True)``; a group is one sequence."""
    places = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(places.alias("p"))
    return grouped.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
