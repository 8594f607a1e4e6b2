"""Linear recurrences ``y -> p y + q`` over ordered rows, inside the JVM and split within a key.

Steps of this form compose into one of the same form.  Within a block of calendar slots the composition has a closed form: with
``P`` the running product of the ``p`` since the last row whose ``p`` is 0, the value is ``P * (y + sum of q / P)``, which windows give without packing a
row.  What is carried from block to block is a tree: blocks compose into groups of ``block`` blocks, the groups' totals are carried along
the key, then each group's blocks get what came in.  A key of ten million slots has 153 groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialise

#: Slots in a block, and blocks in a group.
BLOCK = 256


def linear_scan(df: DataFrame, by: str, idx: str, steps: dict[str, tuple[Column, Column]], block: int = BLOCK) -> DataFrame:
    """``df`` with a column per entry of ``steps``: the value after each row, in order of ``idx``, starting from 0.

    A step is ``(p, q)``; where either is null the row leaves the value as it was.  The product of the ``p`` that are not 0 within a block
    must stay above 1e-300: averages of the last value and any of a weight above ``10 ** (-300 / block)`` do.
    """
    names = list(steps)
    columns = df.columns
    whole = {n: p.isNotNull() & q.isNotNull() for n, (p, q) in steps.items()}
    rows = df.withColumn("_block", F.floor(F.col(idx) / block))
    w = Window.partitionBy(by, "_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {f"_p_{n}": F.when(whole[n], p).otherwise(1.0) for n, (p, _) in steps.items()}
    rows = rows.withColumns(made | {f"_q_{n}": F.when(whole[n], q).otherwise(0.0) for n, (_, q) in steps.items()})
    zero = {n: F.col(f"_p_{n}") == 0 for n in names}
    rows = rows.withColumns({f"_m_{n}": F.product(F.when(zero[n], 1.0).otherwise(F.col(f"_p_{n}"))).over(w) for n in names})
    rows = rows.withColumns(
        {f"_s_{n}": F.sum(F.col(f"_q_{n}") / F.col(f"_m_{n}")).over(w) for n in names}
        | {f"_z_{n}": F.max(zero[n]).over(w) for n in names}
    )
    # what had been summed before the last row that starts anew
    since = {n: F.last(F.when(zero[n], F.col(f"_s_{n}") - F.col(f"_q_{n}") / F.col(f"_m_{n}")), ignorenulls=True).over(w) for n in names}
    rows = rows.withColumns({f"_b_{n}": F.coalesce(since[n], F.lit(0.0)) for n in names})
    local = {f"_y_{n}": F.col(f"_m_{n}") * (F.col(f"_s_{n}") - F.col(f"_b_{n}")) for n in names}
    rows = rows.withColumns(local | {f"_c_{n}": F.when(F.col(f"_z_{n}"), 0.0).otherwise(F.col(f"_m_{n}")) for n in names})
    # written once: the blocks' totals and the rows themselves both come from here
    rows = materialise(rows.select(*[c for c in columns if c not in names], "_block", *[f"_{k}_{n}" for n in names for k in "cy"]))

    last = F.max_by(F.struct(*[F.col(f"_{k}_{n}") for n in names for k in "cy"]), idx).alias("_last")
    totals = rows.groupBy(by, "_block").agg(last)
    after = _carried(totals.select(by, "_block", "_last.*"), by, names, block)
    out = rows.join(after, [by, "_block"])
    value = lambda n: (F.col(f"_in_{n}") * F.col(f"_c_{n}") + F.col(f"_y_{n}")).alias(n)
    return out.select(*[c for c in columns if c not in names], *[value(n) for n in names])


def _carried(totals: DataFrame, by: str, names: list[str], block: int) -> DataFrame:
    """``(by, _block, _in_<name>)``: what comes into each block, from the blocks' totals ``(_c_<name>, _y_<name>)``."""
    step = F.struct("_block", *[F.col(f"_{k}_{n}") for n in names for k in "cy"])
    groups = totals.groupBy(by, F.floor(F.col("_block") / block).alias("_group")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    unit = {f"{k}_{n}": F.lit(1.0 if k == "c" else 0.0) for n in names for k in "cy"}

    def compose(a, x):
        made = {"c": lambda n: a[f"c_{n}"] * x[f"_c_{n}"], "y": lambda n: a[f"y_{n}"] * x[f"_c_{n}"] + x[f"_y_{n}"]}
        return [made[k](n).alias(f"{k}_{n}") for n in names for k in "cy"]

    def walk(fields: dict[str, Column], first: str, key: str):
        """Fold that notes, for each element, what had been composed before it."""
        kinds = ",".join([f"{key}:bigint", *[f"{f}:double" for f in fields]])
        start = F.struct(*[v.alias(f) for f, v in fields.items()], F.array().cast(f"array<struct<{kinds}>>").alias("all"))

        def add(a, x):
            note = F.struct(x[first].alias(key), *[a[f].alias(f) for f in fields])
            return F.struct(*compose(a, x), F.array_append(a["all"], note).alias("all"))

        return start, add

    groups = groups.withColumn("_done", F.aggregate("_steps", *walk(unit, "_block", "_block")))
    entry = F.struct("_group", *[F.col(f"_done.{k}_{n}").alias(f"_{k}_{n}") for n in names for k in "cy"])
    keys = groups.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("_totals"))
    came = keys.select(by, F.inline(F.aggregate("_totals", *walk(unit, "_group", "_group"))["all"]))
    came = came.select(by, "_group", *[F.col(f"y_{n}").alias(f"_came_{n}") for n in names])
    inside = groups.select(by, "_group", F.inline("_done.all")).join(came, [by, "_group"])
    return inside.select(by, "_block", *[(F.col(f"_came_{n}") * F.col(f"c_{n}") + F.col(f"y_{n}")).alias(f"_in_{n}") for n in names])
