"""The read-only SQL surface: an allow-list of statements over the public views, with a row cap and a timeout."""

from __future__ import annotations

import csv
import io
import json
import re
import threading
import uuid

from pyspark.sql import DataFrame

from codeloom.model import CodeModel


class Refused(ValueError):
    """A statement that the surface doesn't run."""


def split_statements(text: str) -> list[str]:
    """Statements between semicolons; quotes and comments hide theirs. Empty ones are dropped."""
    out, now, i = [], [], 0
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            end = i + 1
            while end < len(text):
                if text[end] == c:
                    if text[end + 1 : end + 2] != c:
                        break
                    end += 1
                end += 1
            now.append(text[i : end + 1])
            i = end + 1
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = len(text) if end < 0 else end + 2
            now.append(" ")
        elif c == ";":
            out.append("".join(now).strip())
            now, i = [], i + 1
        else:
            now.append(c)
            i += 1
    return [s for s in [*out, "".join(now).strip()] if s]


def _outside_quotes(sql: str, change) -> str:
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)", sql)
    return "".join(p if i % 2 else change(p) for i, p in enumerate(parts))


_VIEW = re.compile(r"^create\s+(?:or\s+replace\s+)?(?:temp|temporary)\s+(?:table|view)\s+(\w+)\s+as\s+(.*)$", re.IGNORECASE | re.DOTALL)
_FILES = re.compile(r"\b(?:parquet|csv|json|orc|text|avro|binaryfile|delta|jdbc)\s*\.\s*$|\b(?:read_files|java_method|reflect|try_reflect)\s*\(", re.IGNORECASE)
_WRITES = re.compile(r"^\s*with\b.*\binsert\s+(?:into|overwrite)\b", re.IGNORECASE | re.DOTALL)


class Surface:
    """An isolated session with the model's views as v1.symbols, v1.edges, v1.files and v1.meta, and snapshots as snap.<table>."""

    def __init__(self, model: CodeModel, snapshots: dict[str, DataFrame] | None = None, cap: int = 1000, timeout_s: float = 10.0):
        self.parent = model.symbols.sparkSession
        self.spark = self.parent.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.cap, self.timeout_s = cap, timeout_s
        for name in ("symbols", "edges", "files", "meta"):
            self._adopt(f"v1_{name}", getattr(model, f"v1_{name}")())
        for name, df in (snapshots or {}).items():
            self._adopt(f"snap_{name}", df)

    def _adopt(self, name: str, df: DataFrame) -> None:
        """A view of this session on a plan of the parent's."""
        from pyspark.sql import DataFrame as Frame

        jdf = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan())
        Frame(jdf, self.spark).createOrReplaceTempView(name)

    def frame(self, text: str) -> DataFrame:
        """The last statement's result, lazily; those before it may only make temporary views."""
        statements = split_statements(text)
        if not statements:
            raise Refused("no statement")
        names = lambda s: _outside_quotes(s, lambda p: re.sub(r"\b(v1|snap)\.(\w+)", r"\1_\2", p))
        for s in statements[:-1]:
            m = _VIEW.match(s)
            if not m:
                raise Refused("only CREATE TEMP VIEW or TABLE ... AS may come before the last statement")
            self._check(m[2])
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {m[1]} AS {names(m[2])}")
        self._check(statements[-1])
        return self.spark.sql(names(statements[-1]))

    @staticmethod
    def _check(sql: str) -> None:
        head = re.match(r"[\s(]*(\w+)", sql)
        if not head or head[1].lower() not in ("select", "with", "values"):
            raise Refused("only SELECT, WITH and VALUES are run")
        bare = "".join(p for i, p in enumerate(re.split(r"('(?:[^']|'')*')", sql)) if not i % 2)
        if _WRITES.match(bare) or any(_FILES.search(p) for p in bare.split("`")):
            raise Refused("statements don't write, or read files")

    def run(self, text: str, cap: int | None = None) -> tuple[list[str], list[tuple], bool]:
        """(columns, rows, whether rows were cut off). cap 0 is none; beyond timeout_s the jobs are cancelled."""
        cap = self.cap if cap is None else cap
        df = self.frame(text)
        group = uuid.uuid4().hex
        sc = self.spark.sparkContext
        sc.setJobGroup(group, "sql surface", True)
        timer = threading.Timer(self.timeout_s, lambda: sc.cancelJobGroup(group))
        timer.start()
        try:
            rows = (df.limit(cap + 1) if cap else df).collect()
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
        cut = bool(cap) and len(rows) > cap
        return df.columns, [tuple(r) for r in (rows[:cap] if cut else rows)], cut


def render(columns: list[str], rows: list[tuple], form: str = "table", width: int = 200) -> str:
    """Rows as a table (null: ∅), csv or json."""
    if form == "json":
        return json.dumps([dict(zip(columns, r, strict=True)) for r in rows], default=str)
    if form == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([columns, *rows])
        return out.getvalue()
    cells = [[("∅" if v is None else str(v))[:width] for v in r] for r in rows]
    sizes = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(columns)]
    line = lambda r: " | ".join(v.ljust(n) for v, n in zip(r, sizes, strict=True)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * n for n in sizes), *map(line, cells)])
