"""Arrow-batched helpers for bounded linear algebra inside tasks.

A group (one book on one day, one block of symbols) is packed by Spark into one row; numpy
works on that row and nothing larger than a group ever meets in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from bookheat.session import spread


#: Rows that a task gathers before it hands them on.
ROWS_AT_ONCE = 50_000
_EXACT = Context(prec=400)


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)  # type: ignore[return-value]


def _field(values: pa.Array):
    """A struct field as numpy (numbers), list (strings) or 2-D numpy (arrays of numbers)."""
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        return values
    if pa.types.is_floating(values.type) or pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False)
    return values.to_pylist()


def _slice(values, lo: int, hi: int):
    if isinstance(values, pa.Array):
        part = values.slice(lo, hi - lo)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        if len(np.unique(np.diff(part.offsets.to_numpy()))) > 1:
            raise ValueError("the series of a group differ in length")
        return flat.reshape(hi - lo, -1) if hi > lo else flat.reshape(0, 0)
    return values[lo:hi]


def map_packed(
    packed: DataFrame, keys: list[str], fn: Callable[[dict], list[tuple]], out: str, items: str = "items", beside: tuple[str, ...] = ()
) -> DataFrame:
    """Apply ``fn`` to each row's ``items`` (array of structs) and emit its tuples with the keys.

    ``fn`` gets {field: array}, array-typed fields as matrices (one row per item), and the row's lists of numbers
    ``beside`` as arrays, empty for null.
    """
    in_schema = packed.schema
    out_schema = StructType([in_schema[k] for k in keys] + schema_of(out).fields)
    arrow_schema = to_arrow_schema(out_schema)
    n_out = len(schema_of(out).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(items))
            offsets = col.offsets.to_numpy()
            structs = col.values
            fields = {structs.type.field(i).name: _field(structs.field(i)) for i in range(structs.type.num_fields)}
            lists = {n: batch.column(batch.schema.get_field_index(n)) for n in beside}
            numbers = {n: (v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)) for n, v in lists.items()}
            owner: list[int] = []
            rows: list[tuple] = []
            for g in range(len(batch)):
                lo, hi = int(offsets[g]), int(offsets[g + 1])
                own = {n: v[ends[g] : ends[g + 1]] for n, (ends, v) in numbers.items()}
                made = fn({n: _slice(v, lo, hi) for n, v in fields.items()} | own)
                rows.extend(made)
                owner.extend([g] * len(made))
                if len(rows) < ROWS_AT_ONCE and g + 1 < len(batch):
                    continue
                take = pa.array(owner, pa.int64())
                cols = [batch.column(batch.schema.get_field_index(k)).take(take) for k in keys]
                values = list(zip(*rows)) if rows else [()] * n_out
                cols += [pa.array(v, arrow_schema.field(len(keys) + i).type) for i, v in enumerate(values)]
                cols = [c.cast(arrow_schema.field(i).type) for i, c in enumerate(cols)]
                owner, rows = [], []
                yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return packed.select(*keys, items, *beside).mapInArrow(run, out_schema)


def map_groups(df: DataFrame, keys: list[str], cols: list[str], fn, out: str, placed: bool = False) -> DataFrame:
    """Pack ``cols`` per key in the order of the first column, then ``map_packed``.

    ``placed`` says the rows already lie together by (a part of) the keys.
    """
    rows = df if placed else spread(df, *keys)
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("items"))
    return map_packed(packed, keys, fn, out)


def ewma_correlation(x: np.ndarray, span: int) -> np.ndarray:
    """EWMA correlation of the rows of ``x`` (newest column last)."""
    n = x.shape[1]
    w = (1 - 2.0 / (span + 1)) ** np.arange(n - 1, -1, -1)
    d = x - (x @ w / w.sum())[:, None]
    cov = (d * w) @ d.T / w.sum()
    s = np.sqrt(np.diag(cov))
    s[s == 0] = 1e-10
    c = cov / np.outer(s, s)
    np.fill_diagonal(c, 1.0)
    return c


def pct_rank_incl(v: np.ndarray, rows: int) -> np.ndarray:
    """Share of the last ``rows`` values up to each one, itself included, that are <= it."""
    size, out = min(rows, len(v)), []
    padded = np.concatenate([np.full(size - 1, np.inf), v])
    for lo in range(0, len(v), 4096):
        own = v[lo : lo + 4096]
        seen = np.lib.stride_tricks.sliding_window_view(padded[lo : lo + len(own) + size - 1], size)
        out.append((seen <= own[:, None]).sum(axis=1) / np.minimum(np.arange(lo, lo + len(own)) + 1, size))
    return np.concatenate(out)


def pct_ranks_incl(v: np.ndarray, rows: int) -> np.ndarray:
    """``pct_rank_incl`` of every row of ``v``; many rows at once are compared lag by lag."""
    m, n = v.shape
    if m < 8:
        return np.array([pct_rank_incl(one, rows) for one in v]).reshape(m, n)
    out, size = np.empty((m, n)), np.minimum(np.arange(n) + 1, rows)
    for lo in range(0, m, 128):
        t = np.ascontiguousarray(v[lo : lo + 128].T)
        below, seen, count = np.empty(t.shape, bool), np.zeros(t.shape, np.uint8), np.zeros(t.shape, np.int64)
        for k in range(min(rows, n)):
            np.less_equal(t[: n - k], t[k:], out=below[k:])
            seen[k:] += below[k:].view(np.uint8)
            if k % 255 == 254:
                count += seen
                seen[:] = 0
        out[lo : lo + 128] = ((count + seen) / size[:, None]).T
    return out


def pct_ranks_at(v: np.ndarray, row: np.ndarray, day: np.ndarray, rows: int) -> np.ndarray:
    """``pct_ranks_incl`` of ``v`` on the places (row, day) alone; where they are few, the others are not ranked."""
    n = v.shape[1]
    if 8 * len(day) > v.size:
        return pct_ranks_incl(v, rows)[row, day]
    out, k = np.empty(len(day)), np.arange(n)
    step = max(1, 1_000_000 // n)
    for lo in range(0, len(day), step):
        r, d = row[lo : lo + step], day[lo : lo + step, None]
        seen = (k <= d) & (k > d - rows)
        out[lo : lo + step] = ((v[r] <= v[r, d[:, 0]][:, None]) & seen).sum(axis=1) / seen.sum(axis=1)
    return out


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """``round`` of Spark: half up on the shortest decimal form of a number; a negative zero becomes zero."""
    v = np.asarray(v, dtype=float)
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.abs(v) * scale
        whole = np.floor(size)
        rest = size - whole
        out = np.copysign((whole + (rest >= 0.5)) / scale, v)
        # the product may have crossed a half, or has no digits left behind the point: those are few
        doubt = ~((np.abs(rest - 0.5) > 4e-16 * size) & (size < 2.0**50))
    for i in np.argwhere(doubt):
        x = v[tuple(i)]
        if np.isfinite(x):
            x = float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, _EXACT))
        out[tuple(i)] = x
    return out + 0.0


def absorption_ratio(x: np.ndarray, components: int | None = None) -> float:
    """Share of variance in the top eigenvalues; rows are assets. Neutral .5 when too small."""
    n, t = x.shape
    if t < 10 or n < 3:
        return 0.5
    k = min(components or max(1, n // 5), n)
    total = float(np.var(x, axis=1).sum())
    if total == 0:
        return 0.5
    d = x - x.mean(axis=1, keepdims=True)
    gram = d @ d.T if n <= t else d.T @ d
    top = np.linalg.eigvalsh(gram / (t - 1))[-k:].sum()
    return float(min(max(top / total, 0.0), 1.0))


def turbulence(x: np.ndarray) -> float:
    """Mahalanobis distance of the last column from the columns before it."""
    hist, today = x[:, :-1], x[:, -1]
    if hist.shape[1] < 30 or hist.shape[0] < 2:
        return 0.0
    cov = np.cov(hist) + 1e-8 * np.eye(hist.shape[0])
    d = today - hist.mean(axis=1)
    try:
        v = float(d @ np.linalg.solve(cov, d))
    except np.linalg.LinAlgError:
        v = float(d @ np.linalg.pinv(cov) @ d)
    return max(v, 0.0)


def diversification_ratio(x: np.ndarray, w: np.ndarray) -> float:
    """Weighted mean volatility over portfolio volatility, at least one."""
    gross = np.abs(w).sum()
    if x.shape[0] < 2 or x.shape[1] < 20 or gross == 0:
        return 1.0
    w = w / gross
    vol = float(np.sqrt(max(np.var(w @ x, ddof=1), 1e-12)))
    return max(float(np.abs(w) @ np.std(x, axis=1, ddof=1)) / vol, 1.0)


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Slopes, t statistics and R² of y on the rows of ``x`` with an intercept."""
    t, k = y.shape[0], x.shape[0]
    design = np.column_stack([np.ones(t), x.T])
    inv = np.linalg.pinv(design.T @ design)
    beta = inv @ (design.T @ y)
    sse = float(((y - design @ beta) ** 2).sum())
    sst = float(((y - y.mean()) ** 2).sum())
    se = np.sqrt(np.maximum(np.diag(inv) * sse / max(t - k - 1, 1), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        ts = np.where(se > 0, beta / se, 0.0)
    return beta[1:], ts[1:], 1 - sse / sst if sst > 0 else 0.0
