"""Commands on tables of the catalog: register, compact, delete, update, drop and more."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import names
from ..core.errors import UnsupportedOperation, ValidationError

ACTIONS = ("registerTableInCatalog", "vacuumTable", "optimiseTable", "restoreTable", "deleteFromTable", "updateTable", "dropTable", "fsckRepairTable", "runDDL")
LEAST_HOURS = 168


@dataclass(frozen=True)
class TableOperations:
    """Runs one command on a table and returns one row about it.

    Tables of a format with commands of its own get those commands.  On tables of
    plain files, deleting, updating and compacting write the new rows to a staging
    table and then overwrite the table from it, so a failed job leaves either the
    old rows or the whole staging table; ``vacuumTable``, ``restoreTable`` and
    ``fsckRepairTable`` raise :class:`UnsupportedOperation` there.

    ``optimiseTable`` with ``zorder`` columns orders plain files by ranges of them.
    ``runDDL`` runs ``ddl`` with ``{table_name}`` put as the table.  An empty action
    does nothing; its row says so, with the status ``Failed``.
    """

    table: str
    action: str = "optimiseTable"
    database: str = ""
    catalog: str = ""
    path: str = ""
    format: str = "parquet"
    retain_hours: int | None = LEAST_HOURS
    where: str = ""
    zorder: Sequence[str] = ()
    restore_via: str = "version"
    restore_value: str = ""
    delete_condition: str = "true"
    update_set: str = ""
    update_condition: str = ""
    ddl: str = ""

    @property
    def target(self) -> str:
        return ".".join(names.quoted(p) for p in (self.catalog, self.database, self.table) if p)

    def problems(self) -> list[str]:
        out = [] if self.table else ["table is required"]
        if self.action and self.action not in ACTIONS:
            out.append(f"unknown action {self.action!r}")
        wants = {"registerTableInCatalog": ("path",), "deleteFromTable": ("delete_condition",), "updateTable": ("update_set",), "runDDL": ("ddl",), "restoreTable": ("restore_value",)}
        out += [f"{name} is required" for name in wants.get(self.action, ()) if not getattr(self, name)]
        if self.action == "vacuumTable" and (self.retain_hours is None or self.retain_hours < LEAST_HOURS):
            out.append(f"retain_hours must be at least {LEAST_HOURS}")
        if self.action == "restoreTable" and self.restore_value:
            out += self._restore_problems()
        return out

    def _restore_problems(self) -> list[str]:
        if self.restore_via == "version":
            return [] if str(self.restore_value).isdigit() and int(self.restore_value) > 0 else ["the version must be a positive number"]
        try:
            datetime.strptime(str(self.restore_value), "%Y-%m-%d %H:%M:%S")
        except ValueError:
            return ["the timestamp must be like 2024-01-31 12:00:00"]
        return []

    def __call__(self, spark: SparkSession) -> DataFrame:
        if found := self.problems():
            raise ValidationError("TableOperations", found)
        {
            "registerTableInCatalog": lambda: spark.sql(f"CREATE TABLE {self.target} USING {self.format} LOCATION {self._text(self.path)}"),
            "vacuumTable": lambda: self._native(spark, f"VACUUM {self.target} RETAIN {self.retain_hours} HOURS"),
            "optimiseTable": lambda: self._optimise(spark),
            "restoreTable": lambda: self._native(spark, f"RESTORE TABLE {self.target} TO {self._when()}"),
            "deleteFromTable": lambda: self._either(spark, f"DELETE FROM {self.target} WHERE {self.delete_condition}", self._kept),
            "updateTable": lambda: self._either(spark, f"UPDATE {self.target} SET {self.update_set}" + (f" WHERE {self.update_condition}" if self.update_condition else ""), self._updated),
            "dropTable": lambda: spark.sql(f"DROP TABLE {self.target}"),
            "fsckRepairTable": lambda: self._native(spark, f"FSCK REPAIR TABLE {self.target}"),
            "runDDL": lambda: spark.sql(self.ddl.replace("{table_name}", self.target)),
            "": lambda: None,
        }[self.action]()
        said = (self.action, "Success") if self.action else ("No Action", "Failed")
        done = F.lit(said[0]).alias("operation"), F.lit(self.target).alias("target_table"), F.lit(said[1]).alias("status"), F.current_timestamp().alias("executed_at")
        return spark.range(1).select(*done)

    @staticmethod
    def _text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def _when(self) -> str:
        return f"VERSION AS OF {int(self.restore_value)}" if self.restore_via == "version" else f"TIMESTAMP AS OF {self._text(self.restore_value)}"

    def _provider(self, spark: SparkSession) -> str:
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {self.target}").filter("col_name = 'Provider'").collect()
        return rows[0]["data_type"].lower() if rows else ""

    def _native(self, spark: SparkSession, command: str) -> None:
        if (provider := self._provider(spark)) != "delta":
            raise UnsupportedOperation(f"{self.action}: tables of format {provider or 'unknown'!r} have no such command")
        spark.sql(command)

    def _either(self, spark: SparkSession, command: str, rewrite: Callable[[DataFrame], DataFrame]) -> None:
        if self._provider(spark) == "delta":
            spark.sql(command)
        else:
            self._rewrite(spark, rewrite)

    def _rewrite(self, spark: SparkSession, change: Callable[[DataFrame], DataFrame]) -> None:
        staging = ".".join(names.quoted(p) for p in (self.catalog, self.database, f"{self.table}_staging_{uuid.uuid4().hex}") if p)
        change(spark.table(self.target)).write.format(self._provider(spark)).saveAsTable(staging)
        spark.sql(f"INSERT OVERWRITE TABLE {self.target} SELECT * FROM {staging}")
        spark.sql(f"DROP TABLE {staging}")

    def _kept(self, rows: DataFrame) -> DataFrame:
        return rows.filter(~F.coalesce(F.expr(self.delete_condition), F.lit(False)))

    def _updated(self, rows: DataFrame) -> DataFrame:
        new = {names.resolve(rows, name): value for name, value in assignments(self.update_set)}
        hit = F.coalesce(F.expr(self.update_condition), F.lit(False)) if self.update_condition else F.lit(True)
        kinds = {f.name: f.dataType for f in rows.schema}
        return rows.select([F.when(hit, F.expr(new[c]).cast(kinds[c])).otherwise(names.col(c)).alias(c) if c in new else names.col(c) for c in rows.columns])

    def _optimise(self, spark: SparkSession) -> None:
        if self._provider(spark) == "delta":
            order = f" ZORDER BY ({', '.join(map(names.quoted, self.zorder))})" if self.zorder else ""
            spark.sql(f"OPTIMIZE {self.target}" + (f" WHERE {self.where}" if self.where else "") + order)
        elif self.where:
            raise UnsupportedOperation("optimiseTable: plain files are compacted as a whole")
        else:
            keys = [names.col(c) for c in names.resolve_all(spark.table(self.target), self.zorder)]
            self._rewrite(spark, lambda rows: rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows.hint("rebalance"))


def assignments(text: str) -> list[tuple[str, str]]:
    """``a = x, b = f(y, z)`` as pairs: cut at commas outside brackets and quotes."""
    parts, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    out = []
    for part in [*parts, text[at:]]:
        m = re.fullmatch(r"\s*(?:`((?:[^`]|``)+)`|(\w+))\s*=\s*(.+?)\s*", part, re.S)
        if not m:
            raise ValidationError("TableOperations", [f"{part.strip()!r} is not an assignment"])
        out.append(((m[1] or m[2]).replace("``", "`"), m[3]))
    return out
