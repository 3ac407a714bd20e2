"""Work that may fail key by key: what fails is kept with its error and tried first by the next run.

A run takes the keys that failed before, as long as they have tries left, and then new ones. Each key is
worked on by itself inside tasks, so a failure costs its own key only. What came out is written down
before anything is derived from it, so calls to a service aren't repeated because a later step failed; results
and the table of failures then move in one commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.operators.commits import Commit, Store
from gavel.operators.upsert import with_unique

Work = Callable[[dict], list[dict]]


def attempted(rows: DataFrame, key: str, make: Callable[[], Work], result: str) -> DataFrame:
    """(key, result columns, error): what the work gives for each row, or one row with its error.

    ``make`` builds the work once for each task; the work gets a row as a dict and gives a list of dicts. A result row
    has a null error. A row without results gives one row with nothing but its key, so that it counts as done.
    """
    columns = T.StructType.fromDDL(result)
    out = T.StructType([rows.schema[key], *columns.fields]).add("error", T.StringType()).add("empty", T.BooleanType())
    names = [f.name for f in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = make()
        for part in batches:
            found = []
            for row in part.to_dict("records"):
                none = dict.fromkeys(names)
                try:
                    made = [{key: row[key], **none, **x, "error": None, "empty": False} for x in work(row)]
                    found += made or [{key: row[key], **none, "error": None, "empty": True}]
                except Exception as problem:  # whatever the service raises
                    found.append({key: row[key], **none, "error": f"{type(problem).__name__}: {problem}", "empty": True})
            yield pd.DataFrame(found, columns=out.names).astype(object)

    return rows.mapInPandas(run, out)


def due(todo: DataFrame, key: str, failed: DataFrame | None, done: DataFrame | None, most_tries: int) -> DataFrame:
    """Rows of ``todo`` for the next run, with ``tries`` so far: those that failed and have tries left, and new ones."""
    rows = todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")
    if failed is None:
        return rows.withColumn("tries", F.lit(0))
    counted = rows.join(failed.select(key, "tries"), key, "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    return counted.where(F.col("tries") < most_tries)


def run_attempts(
    store: Store, name: str, todo: DataFrame, key: str, make: Callable[[], Work], result: str, scratch: str, *, most_tries: int = 5, retries_only: bool = False,
) -> Commit:
    """One run over what is due: results go to table ``name``, failures to ``name``_failed, keys that are through to ``name``_done.

    ``todo`` has one row for each key. With ``retries_only`` new keys wait. ``scratch`` is a new folder for what came out.
    """
    spark = store.spark
    now, tables = store.snapshot()
    failed, done = tables.get(f"{name}_failed"), tables.get(f"{name}_done")
    rows = due(with_unique(todo, [key]), key, failed, done, most_tries)
    if retries_only:
        rows = rows.where("tries > 0")
    out = attempted(rows.drop("tries"), key, make, result)
    out.write.parquet(scratch)
    came = spark.read.schema(out.schema).parquet(scratch)
    errors = came.where("error IS NOT NULL").select(key, "error")
    fine = came.where("error IS NULL")

    def change(newest: dict[str, DataFrame]) -> dict[str, DataFrame]:
        old = newest.get(f"{name}_failed")
        before = errors.withColumn("tries", F.lit(0)) if old is None else errors.join(old.select(key, "tries"), key, "left")
        again = before.select(key, (F.coalesce("tries", F.lit(0)) + 1).alias("tries"), "error")
        if old is not None:
            again = again.unionByName(old.join(came.select(key).distinct(), key, "left_anti").select(key, "tries", "error"))
        results = fine.where("NOT empty").drop("error", "empty")
        through = fine.select(key).distinct()
        add = lambda n, df: df if n not in newest else newest[n].unionByName(df)
        return {name: add(name, results), f"{name}_failed": again, f"{name}_done": add(f"{name}_done", through)}

    return store.update(change)
