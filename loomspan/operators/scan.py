"""Segmented scan: running aggregates and neighbours along runs of any length, without a window over a whole run.

`ranged` deals each run (the rows with equal `by`) to ranges of its ordering key, by the run's own row count and ends;
ranges that turn out too full, since keys come in clumps, are cut at their own quantiles into CUTS + 1 parts. A scan is
then a window inside each range, one carry row a range (what the ranges before it add up to), and their combination.
Carries are joined by run and range, which is how the windows have dealt the rows already. What fixes the ranges, a row a
run, is written; each scan reads the rows twice, so rows that are dear to make are best written by the caller first.

Nulls of `by` are a run. Rows with a null key stand first, those with NaN last. Equal keys go by the other ordering
columns and are never parted, so a range holds more rows than ROWS only where that many share one key. Runs of one row
and empty tables are ordinary cases. Helper columns start with `_g` and are gone from `rows()`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.tables import written

#: Rows that a range is meant to hold, and times that number from which it is cut at quantiles.
ROWS, FULL = 65_536, 2
#: Quantiles of a range that is too full: a tree of 32 by 32 parts.
ARMS = 32
CUTS = ARMS * ARMS - 1
_RANGE, _PART = "_grange", "_gpart"
#: Doubles, or sums of blocks of them, that are added one after another.
BLOCK = 16


def _cells(key: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Number of the range of a finite key, from 0 to n - 1; -1 for nulls and -infinity, n for infinity and NaN."""
    at = F.when(hi > lo, F.floor((key - lo) / (hi - lo) * n)).otherwise(F.lit(0))
    inside = F.greatest(F.lit(0), F.least(n - 1, at)).cast("long")
    return F.when(key.isNull() | (key == float("-inf")), F.lit(-1)).when(F.isnan(key) | (key == float("inf")), n).otherwise(inside)


def _finite(key: Column) -> Column:
    return F.when(~F.isnan(key) & (F.abs(key) < float("inf")), key)


def _below(cuts: Column, key: Column) -> Column:
    """How many of the sorted cuts are smaller than key: the arm first, then inside it. Equal keys get one number."""
    smaller = lambda of: F.size(F.filter(of, lambda x: x < key))
    arm = smaller(F.transform(F.sequence(F.lit(1), F.lit(ARMS - 1)), lambda j: F.get(cuts, j * ARMS - 1)))
    return F.when(cuts.isNotNull(), arm * ARMS + smaller(F.slice(cuts, arm * ARMS + 1, F.lit(ARMS - 1))))


def _same(columns: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def _beside(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of small (a row a key, nulls are keys), which keep their names."""
    other = small.select(*[F.col(c).alias(f"_gj{c}") for c in on], *[c for c in small.columns if c not in on])
    return rows.join(other, _same(on, "_gj"), "left").drop(*[f"_gj{c}" for c in on])


@dataclass(frozen=True)
class Ranged:
    """Rows dealt to ranges of their runs. `order` sorts a run; the key that made the ranges is its first column or agrees with it."""

    dealt: DataFrame
    by: list[str]
    order: list[Column]
    names: list[str]

    @property
    def keys(self) -> list[str]:
        return [*self.by, _RANGE, _PART]

    def _window(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def _carries(self, per: DataFrame, made: dict[str, Column]) -> DataFrame:
        """per (a row a range) with columns over the ranges of its run; `made` may use `before` and `run` frames."""
        return per.select(*self.keys, *[c.alias(n) for n, c in made.items()])

    def _frame(self, first: int, last: int) -> Window:
        return Window.partitionBy(*self.by).orderBy(_RANGE, _PART).rowsBetween(first, last)

    def rows(self) -> DataFrame:
        return self.dealt.select(*self.names)

    def with_columns(self, made: dict[str, Column]) -> Ranged:
        """Columns made from a row's own ones, between two scans."""
        new = [n for n in made if n not in self.names]
        return Ranged(self.dealt.withColumns(made), self.by, self.order, [*self.names, *new])

    def running(self, **scans: tuple[str, str | None]) -> Ranged:
        """name=(kind, column): `min`, `max`, `sum` and `count` of the run's rows up to and including each row.

        As in SQL, nulls don't count, and there is no least, largest or sum before the first value. With None, `count` counts rows.
        """
        aggregates = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
        joined = {"min": F.least, "max": F.greatest, "sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b}
        inside = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        of = {n: aggregates[kind](F.lit(1) if c is None else F.col(c)) for n, (kind, c) in scans.items()}
        per = self.dealt.groupBy(*self.keys).agg(*[a.alias(f"_gt{n}") for n, a in of.items()])
        upto = self._frame(Window.unboundedPreceding, -1)
        before = {f"_gb{n}": (F.sum if kind in ("sum", "count") else aggregates[kind])(f"_gt{n}").over(upto) for n, (kind, _) in scans.items()}
        local = self.dealt.withColumns({f"_gl{n}": a.over(inside) for n, a in of.items()})
        both = _beside(local, self._carries(per, before), self.keys)
        made = both.withColumns({n: joined[kind](F.col(f"_gb{n}"), F.col(f"_gl{n}")) for n, (kind, _) in scans.items()})
        return self._over(made.drop(*[f"_g{x}{n}" for n in scans for x in "bl"]), list(scans))

    def totals(self, **sums: str | None) -> Ranged:
        """name=column: the sum of a column over the row's whole run, or (None) the number of the run's rows."""
        of = {n: F.count("*") if c is None else F.sum(c) for n, c in sums.items()}
        per = self.dealt.groupBy(*self.by).agg(*[a.alias(f"_gn{n}") for n, a in of.items()])
        both = _beside(self.dealt, per, self.by)
        return self._over(both.withColumns({n: F.col(f"_gn{n}") for n in sums}).drop(*[f"_gn{n}" for n in sums]), list(sums))

    def shifted(self, name: str, column: str, by: int) -> Ranged:
        """The value `by` rows before (negative: after) in the run, null beyond its ends.

        A range hands its last (first) |by| values on; since no range is empty, so many neighbours hold all that is wanted.
        """
        k, back = abs(by), by > 0
        order = [_reversed(c) for c in self.order] if back else self.order
        edge = Window.partitionBy(*self.keys).orderBy(*order)
        value = F.col(column)
        # The edge's values, nearest to the border first.
        at_edge = self.dealt.select(*self.keys, value.alias("_gv"), F.row_number().over(edge).alias("_gr")).where(F.col("_gr") <= k)
        per = at_edge.groupBy(*self.keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_gr", "_gv"))), lambda x: x["_gv"]).alias("_ge"))
        near = self._frame(-k, -1) if back else self._frame(1, k)
        found = F.collect_list("_ge").over(near)
        carried = self._carries(per, {"_gc": F.flatten(F.reverse(found) if back else found)})
        inside = F.lag(value, k) if back else F.lead(value, k)
        # Places from the border that the wanted value lies beyond.
        place = self._window() if back else Window.partitionBy(*self.keys).orderBy(*[_reversed(c) for c in self.order])
        local = self.dealt.withColumns({"_gi": inside.over(self._window()), "_gp": F.row_number().over(place)})
        both = _beside(local, carried, self.keys)
        made = F.when(F.col("_gp") > k, F.col("_gi")).otherwise(F.get("_gc", F.lit(k) - F.col("_gp")))
        return self._over(both.withColumn(name, made).drop("_gi", "_gp", "_gc"), [name])

    def _over(self, dealt: DataFrame, new: list[str]) -> Ranged:
        return Ranged(dealt, self.by, self.order, [*self.names, *[n for n in new if n not in self.names]])


def _reversed(c: Column) -> Column:
    """Ascending columns with nulls first, as a run is sorted, the other way round."""
    return c.desc_nulls_last()


def ranged(df: DataFrame, by: list[str], key: Column | str, order: list[str] | None = None, rows: int | None = None) -> Ranged:
    """df dealt to ranges of about `rows` rows. key: a number that grows with the order; order: the columns that sort a run (by default the key's)."""
    rows = rows or ROWS
    sorting = [F.col(c) for c in (order or [key if isinstance(key, str) else "_gkey"])]
    d = df.withColumn("_gkey", (F.col(key) if isinstance(key, str) else key).cast("double"))
    names = df.columns
    groups = by or ["_gall"]
    if not by:
        d = d.withColumn("_gall", F.lit(0))
    k = F.col("_gkey")
    ends = d.groupBy(*groups).agg(F.min(_finite(k)).alias("_glo"), F.max(_finite(k)).alias("_ghi"), F.count("*").alias("_gn"))
    # Written: a row a run fixes the ranges, and plans that read the rows again don't make it again.
    ends = written(ends)
    d = _beside(d, ends, groups)
    wanted = F.ceil(F.col("_gn") / F.lit(float(rows))).cast("long")
    d = d.withColumn(_RANGE, _cells(k, F.col("_glo"), F.col("_ghi"), wanted)).drop("_glo", "_ghi", "_gn")
    if ends.where(F.col("_gn") > FULL * rows).isEmpty():  # no run is so large that a range of it could be too full
        return Ranged(d.withColumn(_PART, F.lit(0)), groups, sorting, names)
    at = [*groups, _RANGE]
    full = d.groupBy(*at).agg(F.count("*").alias("_gn")).where(F.col("_gn") > FULL * rows)
    if full.isEmpty():
        return Ranged(d.withColumn(_PART, F.lit(0)), groups, sorting, names)
    crowded = _beside(d.select(*at, "_gkey"), full, at).where("_gn is not null")
    cuts = crowded.groupBy(*at).agg(F.percentile_approx(_finite(k), [i / (CUTS + 1) for i in range(1, CUTS + 1)], 16 * CUTS).alias("_gcuts"))
    d = _beside(d, written(cuts), at).withColumn(_PART, F.coalesce(_below(F.col("_gcuts"), k), F.lit(0))).drop("_gcuts")
    return Ranged(d, groups, sorting, names)


def _in_blocks(d: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """d (`_gat`, `_gv`, and `_gfrom` and `_gto`, what stands before and after its part) with `_gupto` and `_gbefore`; `keys` tell parts of BLOCK ** levels rows."""
    at, rows = F.col("_gat"), Window.partitionBy(*keys).orderBy("_gat")
    made, n = [], [BLOCK**i for i in range(levels + 1)]

    def added(d: DataFrame, name: str, item: Column, level: int) -> DataFrame:
        d = d.withColumn("_gblock", F.floor(at / F.lit(n[level + 1])))
        block = Window.partitionBy(*keys, "_gblock").orderBy("_gat").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return d.withColumn(name, F.sum(item).over(block))

    def ends(level: int) -> Column:
        return at % n[level] == n[level] - 1

    for i in range(levels):  # what the whole blocks so far add up to, inside the block a level above
        made.append(f"_gs{i}")
        d = added(d, made[i], F.when(ends(i), F.col(made[i - 1])) if i else F.col("_gv"), i)
    d = d.withColumn("_gupto", F.when(ends(levels), F.col("_gto")).otherwise(F.col("_gfrom")))
    before = F.when(at % n[levels] == 0, F.col("_gfrom")).otherwise(F.lag("_gupto").over(rows))
    for i in range(levels - 1, -1, -1):  # the same, beginning with what stands before that block
        d = d.withColumn("_gbefore", before)
        whole = F.when(ends(i), F.col(made[i - 1])) if i else F.col("_gv")
        first = F.coalesce(F.col("_gbefore") + whole, "_gbefore", whole)
        d = added(d, "_gsum", F.when(at % n[i + 1] == 0, first).otherwise(whole), i)
        d = d.withColumn("_gupto", F.when(ends(i + 1), F.col("_gupto")).otherwise(F.col("_gsum")))
    return d.withColumn("_gbefore", before)


def added_in_blocks(df: DataFrame, by: list[str], place: str, value: str, name: str, before: str) -> DataFrame:
    """df with `name`, the sum of the run's doubles up to and including each row, and `before`, that of the row before it.

    Doubles add up to other last bits in another order. Here the places alone fix it: largest whole blocks of 16, 256, ... rows first,
    each block the sum of its 16 parts from left to right, rows of the last block at the end. DuckDB sums a growing window in
    this order too, if its hash of the run is no other run's. place: numbers a run's rows from 1 without gaps. Parts of 65,536 rows are a
    task's; a run has a row a part beside, and 16 ** 9 rows at most. df is read twice. Nulls don't count.
    """
    levels, keys = 4, [*by, "_gpart"]
    nothing = F.lit(None).cast("double")
    at = F.col(place) - 1
    rows = df.withColumns({"_gat": at, "_gv": F.col(value).cast("double"), "_gpart": F.floor(at / F.lit(BLOCK**levels))})
    alone = _in_blocks(rows.select(*keys, "_gat", "_gv", nothing.alias("_gfrom"), nothing.alias("_gto")), keys, levels)
    whole = alone.where(F.col("_gat") % BLOCK**levels == BLOCK**levels - 1).select(*by, F.col("_gpart").alias("_gat"), F.col(f"_gs{levels - 1}").alias("_gv"))
    sums = _in_blocks(whole.withColumns({"_gfrom": nothing, "_gto": nothing}), by, levels + 1).select(*by, F.col("_gat").alias("_gpart"), "_gupto")
    # A part's own row, and that of the part after it.
    sums = sums.select(*keys, nothing.alias("_gfrom"), F.col("_gupto").alias("_gto")).union(sums.select(*by, F.col("_gpart") + 1, "_gupto", nothing))
    carried = written(sums.groupBy(*keys).agg(F.max("_gfrom").alias("_gfrom"), F.max("_gto").alias("_gto")))
    made = _in_blocks(_beside(rows, carried, keys), keys, levels)
    return made.select(*df.columns, F.col("_gupto").alias(name), F.col("_gbefore").alias(before))
