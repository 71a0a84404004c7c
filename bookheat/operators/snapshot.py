"""The whole state of every book on one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the lists, the first orders the list (a minus sign: largest first).
LISTS = {
    "positions": ("-weight", "symbol"),
    "factor_exposures": ("-exposure_share", "factor", "total_exposure"),
    "attribution": ("-heat_share", "symbol", "marginal_heat", "recommendation"),
    "recommendations": ("priority", "action", "instrument", "delta", "urgency", "why"),
    "clusters": ("cluster_id", "symbol"),
}


def listed(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """(book_id, name): the rows of each book as one ordered list of structs, of bounded length: a book's own positions.

    ``rows`` may be one row per book already, with a list ``name`` in any order.
    """
    first = columns[0].removeprefix("-")
    fields: list[str] = [first, *columns[1:]]

    def item(of) -> Column:
        key = -of(first) if columns[0].startswith("-") else of(first)
        return F.struct(key.alias("_order"), *[of(c).alias(c) for c in columns[1:]], of(first).alias(first))

    def without_order(e: Column) -> Column:
        return F.struct(*[e[c].alias(c) for c in fields])

    if name in rows.columns:
        items = F.transform(name, lambda e: item(lambda c: e[c]))
        return rows.select("book_id", F.transform(F.array_sort(items), without_order).alias(name))
    return rows.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(item(F.col))), without_order).alias(name))


def portfolio_states(heat: DataFrame, regimes: DataFrame | None = None, limits: DataFrame | None = None, **lists: DataFrame) -> DataFrame:
    """One row per book that has positions: its newest heat row, mean correlation, regime, limits and the lists named in ``LISTS``.

    Whatever a book lacks is null: a book without a score keeps its positions and exposures. ``regimes`` and ``limits`` have one row per book.
    Frames that are all placed by book alike are joined where they lie.
    """
    columns = [c for c in heat.columns if c != "book_id"]
    newest = heat.groupBy("book_id").agg(F.max_by(F.struct(*columns), "date").alias("heat"))
    out = listed(lists["positions"], LISTS["positions"], "positions")
    out = out.join(newest, "book_id", "left").withColumn("correlation_avg", F.col("heat.avg_corr"))
    for name, rows in (("regime", regimes), ("throttle", limits)):
        if rows is not None:
            out = out.join(rows.select("book_id", F.struct(*[c for c in rows.columns if c != "book_id"]).alias(name)), "book_id", "left")
    for name, rows in lists.items():
        if name != "positions":
            out = out.join(listed(rows, LISTS[name], name), "book_id", "left")
    return out
