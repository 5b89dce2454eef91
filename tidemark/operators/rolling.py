"""Statistics of a key's last rows, by halves.

Spark computes a sliding frame anew for each row.  A frame of many rows is the half of it that ends
at a row and the half that ends as many rows before: halves are halved down to a few rows, which are
computed as frames, and then put together again, a lag and a merge for each doubling.  Moments are
merged about their means, so no digits are lost where a series hardly moves, and equal values
deviate by 0 exactly.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Frames of so many rows, or of an odd number, aren't halved.
SHORT = 16

#: Kind of statistics -> what is carried for it.
PARTS = {"count": ("n",), "mean": ("n", "mean"), "moments": ("n", "mean", "square"), "highest": ("high",)}

#: Kind, column and number of rows.
Asked = tuple[str, str, int]


def _halves(rows: int) -> list[int]:
    """``rows`` and its halves, the shortest first."""
    found = [rows]
    while found[0] > SHORT and found[0] % 2 == 0:
        found.insert(0, found[0] // 2)
    return found


def _named(kind: str, column: str, rows: int) -> str:
    return f"__{kind}_{column}_{rows}"


def _begun(kind: str, column: str, rows: int, of: WindowSpec) -> dict[str, Column]:
    w, x = of.rowsBetween(1 - rows, 0), F.col(f"`{column}`")
    n = F.count(x).over(w)
    found = {"n": lambda: n, "mean": lambda: F.avg(x).over(w), "square": lambda: F.var_pop(x).over(w) * n, "high": lambda: F.max(x).over(w)}
    return {_named(part, column, rows): found[part]() for part in PARTS[kind]}


def _merged(kind: str, column: str, rows: int) -> dict[str, Column]:
    """The parts of twice ``rows``, from those of ``rows`` and of as many before them."""
    of = lambda part, side="": F.col(f"`{_named(part, column, rows)}{side}`")
    if kind == "highest":
        return {_named("high", column, 2 * rows): F.greatest(of("high"), of("high", "__before"))}
    n, m = of("n"), F.coalesce(of("n", "__before"), F.lit(0).cast("long"))
    apart = of("mean", "__before") - of("mean")
    either = lambda part, both: F.when(m == 0, of(part)).when(n == 0, of(part, "__before")).otherwise(both)
    found = {
        "n": lambda: n + m,
        "mean": lambda: either("mean", of("mean") + apart * (m / (n + m))),
        "square": lambda: either("square", of("square") + of("square", "__before") + apart * apart * (n * (m / (n + m)))),
    }
    return {_named(part, column, 2 * rows): found[part]() for part in PARTS[kind]}


def with_trailing(rows: DataFrame, asked: Iterable[Asked], partition: str = "ticker", order: str = "date") -> DataFrame:
    """``rows`` with what :func:`count`, :func:`mean`, :func:`deviation` and :func:`maximum` read: statistics of the last rows of each key, the row itself included."""
    every = {(kind, c, n) for kind, c, k in asked for n in _halves(k)}
    of = Window.partitionBy(partition).orderBy(order)
    done = {a for a in every if _halves(a[2]) == [a[2]]}
    out = rows.withColumns({k: x for a in sorted(done) for k, x in _begun(*a, of).items()})
    while todo := sorted(a for a in every - done if (a[0], a[1], a[2] // 2) in done):
        lagged = {f"{k}__before": F.lag(f"`{k}`", n // 2).over(of) for kind, c, n in todo for k in (_named(part, c, n // 2) for part in PARTS[kind])}
        out = out.withColumns(lagged)
        out, done = out.withColumns({k: x for kind, c, n in todo for k, x in _merged(kind, c, n // 2).items()}).drop(*lagged), done | set(todo)
    return out


def count(column: str, rows: int) -> Column:
    return F.col(f"`{_named('n', column, rows)}`")


def mean(column: str, rows: int) -> Column:
    return F.col(f"`{_named('mean', column, rows)}`")


def deviation(column: str, rows: int) -> Column:
    """The sample's standard deviation, null below two values."""
    n = count(column, rows)
    return F.when(n > 1, F.sqrt(F.col(f"`{_named('square', column, rows)}`") / (n - 1)))


def maximum(column: str, rows: int) -> Column:
    return F.col(f"`{_named('high', column, rows)}`")
