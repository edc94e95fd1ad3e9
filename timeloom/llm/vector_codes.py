"""Product codes of vectors: codebooks trained by exact rounds that norm-of-sum bounds keep short."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timeloom.plans.scratch import discard, materialise

#: Steps a unit of a component is cut into, groups of entries that share a lower bound, rows of a block.
STEPS, GROUPS, ROWS = 1024, 8, 2048
#: Squared distances below this are exact in doubles; others are worked out in Python's whole numbers.
EXACT = 2**53
#: Rounding of square roots and of sums of two, as a share of them.
SLACK = 1e-6
#: Sums are sent as multiples of this and the rest, so that Spark's decimals hold those of any 32-bit float.
LOW = 10**30
#: Most components of all entries together, which the driver and every task hold once a round.
MAX_CODEBOOK = 2_000_000


@dataclass
class Codebooks:
    """``entries[r][p]``: the codebook of part ``p`` after ``r`` updates (a matrix of whole numbers, an entry a row)."""

    entries: list[list[np.ndarray]]
    groups: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all last components as decimal numbers between commas, by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries[-1] for entry in part for x in entry).encode()).hexdigest()


def whole_steps(flat: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)`` of finite doubles, as 64-bit whole numbers, or Python's where they don't fit."""
    x = np.floor(flat.astype(np.float64) * STEPS)
    return x.astype(np.int64) if not len(x) or np.abs(x).max() < 2**62 else np.array([int(v) if np.isfinite(v) else int(w) * STEPS for v, w in zip(x.ravel(), flat.ravel())], object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of ``x`` from all of ``c``, exactly; doubles where those hold them exactly."""
    most = max((int(np.abs(m).max()) for m in (x, c) if m.size), default=0)
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < EXACT else object
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` from the same row of ``c``, exactly."""
    most = max((int(np.abs(m).max()) for m in (x, c) if m.size), default=0)
    kind = np.int64 if 4 * most * most * max(1, x.shape[1]) < EXACT else object
    d = x.astype(kind) - c.astype(kind)
    return (d * d).sum(1)


def entry_groups(first: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry of a starting codebook, so that neighbours share one: farthest-first seeds, nearest seed."""
    if not len(first):
        return np.zeros(0, np.int64)
    x = first.astype(np.float64)
    seeds, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(seeds) < min(groups, len(x)):
        seeds.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[seeds[-1]]) ** 2).sum(1))
    return ((x[:, None] - x[seeds][None]) ** 2).sum(2).argmin(1)


class Assigner:
    """Nearest entries of the parts of rows by one round's codebooks, with bounds from earlier rounds.

    Every bound carries the round in which it was worked out (its stamp). A bound of an older round is moved by how far
    entries stand from where they stood then: the norm of the summed moves, which is at most the sum of the moves'
    norms, since codebooks of all rounds are kept. A row's upper bound is its distance from its entry; each group of
    entries has a lower bound of the distance from any of them but the row's own entry. Only groups whose bound doesn't exceed the row's
    exact distance are scanned again, exactly.
    """

    def __init__(self, books: Codebooks, part: int):
        self.now = len(books.entries) - 1
        self.c, of = books.entries[-1][part], books.groups[part]
        self.members = [np.flatnonzero(of == g) for g in range(int(of.max()) + 1 if len(of) else 0)]
        self.of = of
        # net[t]: how far each entry stands from where it stood after t updates; far[t]: the farthest of a group
        self.net = np.array([np.sqrt(paired(self.c, books.entries[t][part]).astype(np.float64)) for t in range(self.now + 1)])
        self.far = np.array([[self.net[t][m].max() for m in self.members] for t in range(self.now + 1)])
        self.scanned = 0

    def fresh(self, x: np.ndarray):
        """State of rows that have none: every entry is scanned."""
        n, g = len(x), len(self.members)
        return np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.zeros(n, np.uint8), np.zeros((n, g), np.float32), np.zeros((n, g), np.uint8)

    def __call__(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray):
        n, g = len(x), len(self.members)
        rows = np.arange(n)
        code, upper, upper_at, lower, lower_at = code.copy(), upper.copy(), upper_at.copy(), lower.copy(), lower_at.copy()
        known = np.isfinite(upper)
        high = np.where(known, (upper + self.net[upper_at, code]) * (1 + SLACK), np.inf)
        low = np.maximum(0, lower - self.far[lower_at, np.arange(g)[None]] * (1 + SLACK)) * (1 - SLACK)
        open_rows = np.flatnonzero(high >= low.min(1)) if n and g else rows[:0]
        if not len(open_rows):
            return code, upper, upper_at, lower, lower_at
        x = x[open_rows]
        # the exact distance from the present entry, against which groups are tested and others win
        old, had = code[open_rows], known[open_rows]
        best, at = paired(x, self.c[old]), old.copy()
        self.scanned += int(had.sum())
        exact = np.sqrt(best.astype(np.float64))
        scan = (low[open_rows] <= exact[:, None] * (1 + SLACK)) | ~had[:, None]
        new_low = np.where(scan, 0.0, low[open_rows])
        stamp = lower_at[open_rows]
        value = lower[open_rows]
        first, second = {}, {}
        for k, members in enumerate(self.members):
            on = np.flatnonzero(scan[:, k])
            if not len(on):
                continue
            d = squared(x[on], self.c[members])
            self.scanned += d.size
            where = d.argmin(1)  # the first of equals, and members are in ascending order
            found = d[np.arange(len(on)), where]
            d[np.arange(len(on)), where] = EXACT * EXACT if d.dtype == object else np.inf
            first[k], second[k] = (on, members[where], found), d.min(1)
            better = (found < best[on]) | ((found == best[on]) & (members[where] < at[on]))
            best[on[better]], at[on[better]] = found[better], members[where[better]]
        for k, (on, who, found) in first.items():
            # of a scanned group, the nearest that isn't the row's entry
            bound = np.where(who == at[on], second[k].astype(np.float64), found.astype(np.float64))
            new_low[on, k] = np.sqrt(np.minimum(bound, 1e300)) * (1 - SLACK)
            value[on, k], stamp[on, k] = new_low[on, k], self.now
        # the entry left behind is now one of the others of its group
        moved = np.flatnonzero((at != old) & had)
        k = self.of[old[moved]]
        left = np.minimum(new_low[moved, k], exact[moved] * (1 - SLACK))
        unscanned = ~scan[moved, k]
        value[moved[unscanned], k[unscanned]], stamp[moved[unscanned], k[unscanned]] = left[unscanned], self.now
        code[open_rows], upper[open_rows], upper_at[open_rows] = at, np.sqrt(best.astype(np.float64)) * (1 + SLACK), self.now
        lower[open_rows], lower_at[open_rows] = value, stamp
        return code, upper, upper_at, lower, lower_at


def kept_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows whose vector is not null and has no null or non-finite component."""
    e = F.col(vector_col)
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(e.isNotNull()).where(ok)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    values = whole_steps(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), width), values.dtype)
    out[np.arange(width)[None] < size[:, None]] = values
    return out


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """Rows of ``vectors`` with ``code`` (an array, the entry of each part) and ``error`` (squared distance, summed over
    parts), and the codebooks.

    Components are ``floor(1024 * x)``, all arithmetic is exact. A codebook starts as the parts of the ``entries`` smallest
    ids (nulls last, of equal ids the smaller vector); each round assigns every row's part to the nearest entry (ties: lower
    number) and moves entries to the floor of their parts' mean; entries without parts stay. Rows with null, NaN or infinite components
    are dropped, repeated rows all count; an empty table gives no rows and empty codebooks; vectors shorter than the longest, and lengths that
    ``parts`` doesn't divide, are taken as if they ended in zeros. An error beyond a long is null. All other
    columns stay, but for ones named like the results, which are replaced.

    Every assignment is one pass over a table that holds rows, codes and bounds, and is written before the next; the table of the
    round before is then no longer read. Sums come back as one row a task, part and entry and are added by Spark, so nothing on
    the driver grows with the rows; MAX_CODEBOOK bounds the codebooks.
    """
    if entries > 256 * 256:
        raise ValueError("at most 65,536 entries a part")
    spark = vectors.sparkSession
    rows = kept_rows(vectors.drop("code", "error"), id_col, vector_col)
    first = rows.select(id_col, vector_col).orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).toArrow()
    longest = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    each = -(-longest // parts)
    width = each * parts
    if width * entries > MAX_CODEBOOK:
        raise ValueError(f"codebooks of more than {MAX_CODEBOOK} components")
    start = _matrix(first.column(1).combine_chunks(), width) if first.num_rows else np.zeros((0, width), np.int64)
    cut = lambda m: [m[:, p * each : (p + 1) * each] for p in range(parts)]
    books = Codebooks([cut(start)], [entry_groups(c, GROUPS) for c in cut(start)])
    sizes = [int(g.max()) + 1 if len(g) else 0 for g in books.groups]

    def assign(held: Codebooks, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            assigners = [Assigner(held, p) for p in range(parts)]
            for whole in batches:
                for begin in range(0, whole.num_rows, ROWS):
                    b = whole.slice(begin, ROWS)
                    x, n = cut(_matrix(b.column(b.schema.get_field_index(vector_col)), width)), b.num_rows
                    names = b.schema.names
                    if "_state" in names:
                        raw = np.frombuffer(b"".join(b.column(names.index("_state")).to_pylist()), np.uint8).reshape(n, -1)
                    else:
                        raw = None
                    out, error, at = [], np.zeros(n, np.int64), 0
                    for p, a in enumerate(assigners):
                        size = 2 + 4 + 1 + 5 * sizes[p]  # code, upper bound and stamp, lower bounds and stamps
                        if raw is None:
                            state = a.fresh(x[p])
                        else:
                            s, g = np.ascontiguousarray(raw[:, at : at + size]), sizes[p]
                            state = (s[:, :2].copy().view(np.uint16)[:, 0].astype(np.int64), s[:, 2:6].copy().view(np.float32)[:, 0], s[:, 6], s[:, 7 : 7 + 4 * g].copy().view(np.float32), s[:, 7 + 4 * g :])
                        at += size
                        code, up, up_at, lo, lo_at = a(x[p], *state)
                        if last:
                            out.append(code)
                            error = error + paired(x[p], a.c[code])
                        else:
                            lo = np.ascontiguousarray(lo, np.float32)
                            out.append(np.concatenate([code.astype(np.uint16)[:, None].view(np.uint8), up.astype(np.float32)[:, None].view(np.uint8), up_at.astype(np.uint8)[:, None], lo.view(np.uint8).reshape(n, -1), lo_at.astype(np.uint8)], axis=1))
                    others = [b.column(i) for i, c in enumerate(names) if c != "_state"]
                    if last:
                        codes = np.stack(out, axis=1).astype(np.int32).ravel()
                        code = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(codes))
                        yield pa.RecordBatch.from_arrays([*others, code, pa.array([e if -(2**63) <= e < 2**63 else None for e in error.tolist()], pa.int64())], [*(c for c in names if c != "_state"), "code", "error"])
                    else:
                        state = np.concatenate(out, axis=1)
                        blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(state.shape[1]), n, [None, pa.py_buffer(np.ascontiguousarray(state).tobytes())]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([*others, blob], [*(c for c in names if c != "_state"), "_state"])

        return run

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums and counts of a task's parts by entry."""
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, each), object if big else np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, at = cut(_matrix(b.column(0), width)), 0
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for p in range(parts):
                code = raw[:, at : at + 2].copy().view(np.uint16)[:, 0].astype(np.int64)
                at += 7 + 5 * sizes[p]
                order = np.argsort(code, kind="stable")
                found, begin = np.unique(code[order], return_index=True)
                n[p, found] += np.diff([*begin, len(order)])
                if each:
                    total[p, found] += np.add.reduceat(x[p][order], begin, axis=0)
        p, e = np.nonzero(n)
        cells = [[dict(zip(("high", "low"), map(Decimal, divmod(int(v), LOW)))) for v in total[i, j]] for i, j in zip(p, e)]
        both = pa.list_(pa.struct([("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))]))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(cells, both)], ["part", "entry", "n", "total"])

    big = start.dtype == object or (longest and rows.where(F.exists(vector_col, lambda v: F.abs(v.cast("double")) >= 2.0**20)).limit(1).count() > 0)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    table = rows
    for r in range(rounds if len(start) else 0):
        before = table
        table = materialise(before.mapInArrow(assign(Codebooks(list(books.entries), books.groups), False), f"{columns}, _state binary"), f"codes-{r}")
        if r:
            discard(before)
        sums = table.select(vector_col, "_state").mapInArrow(tally, "part int, entry int, n long, total array<struct<high: decimal(38,0), low: decimal(38,0)>>")
        cells = sums.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x.high").alias("high"), F.sum("x.low").alias("low"))
        moved = [c.astype(object) if big else c.copy() for c in books.entries[-1]]
        for p, e, at, n, high, low in zip(*(c.to_pylist() for c in cells.where("at is not null").toArrow().columns)):
            moved[p][e, at] = (int(high) * LOW + int(low)) // n
        books.entries.append(moved)
    coded = table.mapInArrow(assign(Codebooks(list(books.entries), books.groups), True), f"{columns}, code array<int>, error long") if len(start) else rows.select("*", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"))
    return coded, books


def op11_norm_of_sum_codes(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = product_codes(vectors)
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = materialise(coded.select("vec_id", "label", hexed.alias("code"), "error"), "coded")
    totals = materialise(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    found = rows.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Every round in full, without bounds."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select vec_id, label, p, m.d as d, m.e as e from (
    select vec_id, any_value(label) as label, p, min({{'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v), 'e': c.e}}) as m from x join c{r} c using (p) group by vec_id, p) b)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (select c.p, c.e, coalesce(n.v, c.v) as v from c{r} c left join (
    select p, e, list(floor((s - ((s % n) + n) % n) / n) order by pos) as v from (
      select p, e, pos, sum(cast(y as hugeint)) as s, count(*) as n from (select x.p, a.e, unnest(x.v) as y, unnest(range(len(x.v))) as pos from x join a{r} a using (vec_id, p)) u group by p, e, pos) t group by p, e) n using (p, e))""")
    return f"""
with q as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v, row_number() over (order by vec_id) - 1 as n from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select vec_id, label, n, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as v from q, range({parts}) r(p)),
c0 as materialized (select p, n as e, v from x where n < {entries}),
{", ".join(steps)},
h as (select sha256(string_agg(array_to_string(list_transform(v, lambda y: cast(cast(y as bigint) as varchar)), ','), ',' order by p, e)) as codebooks_sha256 from c{rounds}),
coded as (select vec_id, any_value(label) as label, string_agg(lower(printf('%02x', e)), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, h
"""


OP11_SQL = _sql()
