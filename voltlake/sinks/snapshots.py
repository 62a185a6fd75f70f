"""Date-partitioned Parquet tables whose readers see all of a write or nothing of it.

A table is a folder of versions; a version holds the dates that one write replaced. A
pointer, one small file, names the version in which each date is current. A write adds a
version and then a pointer, under a name that only one writer can take. Readers resolve
the newest pointer once and list what it names, so a write that runs, or died at any step,
is not seen. Versions that no kept pointer names are removed by later writes; a reader may
take as long as ``KEEP`` writes do.

The pointer also says which row version was loaded last, and when each date changed, so
that tables made from this one can follow. It grows with the calendar, not with the rows.

A version has a folder per date, or, when the writer knows that its rows are of more than
``APART`` dates, a folder per month whose files are sorted by date: a folder and a file take
longer than a small date's rows. Such a folder goes when no date of its month is current.
"""

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from voltlake.sinks.files import delete, list_names, move_new, read_text, write_text

PART, VERSION = "part_date", "version"
NO_DATE = "1900-01-01"
# Pointers, and the versions they name, that stay for readers.
KEEP = 3
# Rows of more dates than this are filed by month, in versions with this ending.
APART, BY_MONTH = 62, "-months"
# The date of a row in a folder of a month.
DAY = "_part_day"


@dataclass(frozen=True)
class Pointer:
    """What is current.

    ``parts`` has the version of each date, ``dates`` the days a part's rows touch where
    those are not just its own, ``changed`` the number of the pointer that last changed a
    day, ``written`` how many dates each version was written with, ``mark`` the greatest
    row version as ISO text, ``schema`` all columns ever written, ``notes`` whatever the
    writer wants to find again.
    """

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    dates: dict[str, list[str]] = field(default_factory=dict)
    changed: dict[str, int] = field(default_factory=dict)
    written: dict[str, int] = field(default_factory=dict)
    mark: str | None = None
    schema: dict | None = None
    notes: dict[str, int] = field(default_factory=dict)

    def days(self, part: str) -> list[str]:
        """The days that rows of a part touch."""
        return self.dates.get(part, [part])

    def changed_since(self, number: int) -> set[str]:
        """Days with rows that were added, replaced or removed after a pointer."""
        return {day for day, n in self.changed.items() if n > number}

    def parts_written_since(self, number: int) -> set[str]:
        """Dates whose rows were written after a pointer."""
        return {p for p, v in self.parts.items() if int(v.split("-")[0]) > number}

    def parts_touching(self, days: set[str]) -> list[str]:
        """The parts with rows of some days."""
        return [p for p in self.parts if not days.isdisjoint(self.days(p))]


def dated(column: str | Column) -> Column:
    """The date a row is filed under; rows without one share a date of their own."""
    return F.coalesce(F.to_date(column), F.lit(NO_DATE).cast("date"))


def _folder(root: str, version: str, part: str) -> str:
    """Where a version has the rows of a date."""
    part = f"{part[:7]}-01" if version.endswith(BY_MONTH) else part
    return f"{root}/{VERSION}={version}/{PART}={part}"


def _pointers(root: str) -> str:
    return f"{root.rstrip('/')}/_pointers"


def _number(name: str) -> int:
    return int(name.removesuffix(".json"))


def _named(spark: SparkSession, root: str) -> list[str]:
    """Names of the pointers there are, oldest first."""
    return sorted(n for n in list_names(spark, _pointers(root)) if n.endswith(".json"))


def current(spark: SparkSession, root: str) -> Pointer:
    """The newest pointer; an empty one for a table that was never written."""
    names = _named(spark, root)
    return _load(spark, root, names[-1]) if names else Pointer()


def _load(spark: SparkSession, root: str, name: str) -> Pointer:
    return Pointer(**json.loads(read_text(spark, f"{_pointers(root)}/{name}")))


def read(
    spark: SparkSession,
    root: str,
    pointer: Pointer | None = None,
    parts: Iterable[str] | None = None,
) -> DataFrame:
    """The table as the pointer names it, with its ``part_date``; some parts or all.

    Only folders of the wanted parts are listed, and no footers are read for their columns.
    Columns added by a later write are NULL in older files. A table that was never written
    has no columns but the date.
    """
    pointer = current(spark, root) if pointer is None else pointer
    wanted = pointer.parts if parts is None else {p: pointer.parts[p] for p in parts if p in pointer.parts}
    by_version: dict[str, list[str]] = {}
    for part, version in sorted(wanted.items()):
        by_version.setdefault(version, []).append(part)
    root = root.rstrip("/")
    paths, some, monthly = [], [], any(v.endswith(BY_MONTH) for v in by_version)
    for version, its in sorted(by_version.items()):
        whole = len(its) == pointer.written[version]
        if whole:
            paths.append(f"{root}/{VERSION}={version}")
        else:
            paths += dict.fromkeys(_folder(root, version, p) for p in its)
            if version.endswith(BY_MONTH):
                some.append((version, its))
    columns = StructType.fromJson(pointer.schema).fields if pointer.schema else []
    if not paths:
        return spark.createDataFrame([], StructType([*columns, _FILED[1]]))
    days = [StructField(DAY, DateType())] if monthly else []
    reader = spark.read.option("basePath", root).schema(StructType([*columns, *days, *_FILED]))
    rows = reader.parquet(*paths)
    if some:
        here = [(F.col(VERSION) == v) & _in_runs(F.col(DAY), its) for v, its in some]
        rows = rows.filter(reduce(Column.__or__, here, ~F.col(VERSION).isin([v for v, _ in some])))
        # The same without versions, which files can be searched by.
        rows = rows.filter(F.col(DAY).isNull() | _in_runs(F.col(DAY), wanted))
    if monthly:
        rows = rows.withColumn(PART, F.coalesce(DAY, PART))
    return rows.drop(VERSION, DAY)


_FILED = [StructField(VERSION, StringType()), StructField(PART, DateType())]


def _columns(before: dict | None, rows: DataFrame) -> dict:
    """The columns there were and those that ``rows`` add, all of them nullable."""
    known = {f.name: f for f in StructType.fromJson(before).fields} if before else {}
    for f in rows.schema.fields:
        if f.name != PART:
            if f.name in known and known[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} was {known[f.name].dataType}, now {f.dataType}")
            known.setdefault(f.name, StructField(f.name, f.dataType))
    return StructType(list(known.values())).jsonValue()


def write(
    spark: SparkSession,
    root: str,
    rows: DataFrame,
    *,
    replaced: Iterable[str] = (),
    everything: bool = False,
    touches: str | None = None,
    version_column: str | None = None,
    notes: dict[str, int] | None = None,
    n_dates: int = 0,
) -> Pointer:
    """Write ``rows``, filed by their ``part_date``, and make them current.

    The dates of ``rows`` are replaced, and so are those named in ``replaced``, which lose
    their rows if none come. With ``everything`` no other date stays. ``touches`` is a time
    column whose days are recorded per part, ``version_column`` the one whose greatest
    value is the mark. ``n_dates`` is about how many dates the rows are of, if the writer
    knows. One writer at a time: see ``upsert.held``.
    """
    root = root.rstrip("/")
    names = _named(spark, root)
    before = _load(spark, root, names[-1]) if names else Pointer()
    schema = _columns(None if everything else before.schema, rows)
    number = before.number + 1
    monthly = n_dates > APART
    version = f"{number:09d}-{uuid.uuid4().hex[:8]}{BY_MONTH if monthly else ''}"
    folder = f"{root}/{VERSION}={version}"
    seen = Observation("written")
    if version_column:
        rows = rows.observe(seen, F.max(version_column).alias("mark"))
    # Rebalancing splits a date that holds most of the rows and merges tiny ones.
    if monthly:
        rows = rows.withColumn(DAY, F.col(PART)).withColumn(PART, F.trunc(PART, "month"))
        rows = rows.hint("rebalance", PART).sortWithinPartitions(PART, DAY)
    else:
        rows = rows.hint("rebalance", PART)
    rows.write.partitionBy(PART).parquet(folder)
    marks = [before.mark, _iso(seen.get["mark"])] if version_column else [before.mark]
    here = [n.removeprefix(f"{PART}=") for n in list_names(spark, folder) if n.startswith(f"{PART}=")]
    filed = DAY if monthly else PART
    if monthly and here:
        filed_on = spark.read.schema(f"{DAY} date").parquet(folder)
        here = [str(r[0]) for r in filed_on.select(DAY).distinct().collect()]  # by the calendar
    days = _days(spark, folder, filed, touches) if touches and here else {}
    gone = set(before.parts) if everything else set(replaced) | set(here)
    touched = {d for p in gone if p in before.parts for d in before.days(p)}
    touched |= {d for p in here for d in days.get(p, [p])} | set(replaced)
    parts = {p: v for p, v in before.parts.items() if p not in gone} | dict.fromkeys(here, version)
    used = set(parts.values())
    after = Pointer(
        number,
        parts,
        {p: d for p, d in (before.dates | days).items() if p in parts and (p in days or p not in gone)},
        before.changed | dict.fromkeys(touched, number),
        {v: n for v, n in (before.written | {version: len(here)}).items() if v in used},
        max((m for m in marks if m is not None), default=None),
        schema,
        before.notes if notes is None else notes,
    )
    _publish(spark, root, after)
    _clean(spark, root)
    return after


def _iso(moment: datetime | None) -> str | None:
    return None if moment is None else moment.isoformat(timespec="microseconds")


def _days(spark: SparkSession, folder: str, filed: str, touches: str) -> dict[str, list[str]]:
    """The days that rows of each part touch, where they are not just the part's own."""
    rows = spark.read.parquet(folder).select(F.col(filed).cast("string"), dated(touches).cast("string").alias("day"))
    found: dict[str, list[str]] = {}
    for part, day in rows.distinct().collect():  # days by the calendar
        found.setdefault(part, []).append(day)
    return {p: sorted(d) for p, d in found.items() if d != [p]}


def _publish(spark: SparkSession, root: str, pointer: Pointer) -> None:
    """Make a pointer the newest. It appears whole, and not if its number is taken."""
    target = f"{_pointers(root)}/{pointer.number:09d}.json"
    draft = f"{_pointers(root)}/.{uuid.uuid4().hex}"
    write_text(spark, draft, json.dumps(asdict(pointer)))
    if not move_new(spark, draft, target):
        delete(spark, draft)
        raise RuntimeError(f"another run has written {root}")


def _clean(spark: SparkSession, root: str) -> None:
    """Remove what no kept pointer names: old dates and what dead writes left."""
    names = _named(spark, root)
    stay, go = names[-KEEP:], names[:-KEEP]
    kept = [_load(spark, root, n) for n in stay]
    named = {(v, p) for pointer in kept for p, v in pointer.parts.items()}
    versions = {v for v, _ in named}
    used = {_folder(root, v, p) for v, p in named}
    old = [(v, p) for n in go for p, v in _load(spark, root, n).parts.items()]
    for folder in sorted({_folder(root, v, p) for v, p in old if v in versions} - used):
        delete(spark, folder)
    for name in list_names(spark, root):
        if name.startswith(f"{VERSION}=") and name.removeprefix(f"{VERSION}=") not in versions:
            delete(spark, f"{root}/{name}")
    for name in go:
        delete(spark, f"{_pointers(root)}/{name}")
    for name in list_names(spark, _pointers(root)):
        if name.startswith(".") and not name.endswith(".crc"):
            delete(spark, f"{_pointers(root)}/{name}")


def on_days(column: str | Column, days: Iterable[str]) -> Column:
    """Whether a time falls on one of some days, as literals; no time counts as its own day."""
    return _in_runs(dated(column), days)


def _in_runs(column: Column, days: Iterable[str]) -> Column:
    """Whether a date is one of some days, by runs of days that follow each other."""
    runs: list[list[date]] = []
    for day in map(date.fromisoformat, sorted(set(days))):
        if runs and day - runs[-1][1] == timedelta(days=1):
            runs[-1][1] = day
        else:
            runs.append([day, day])
    alone = column.isin([first for first, last in runs if first == last])
    return reduce(Column.__or__, [column.between(*run) for run in runs if run[0] < run[1]], alone)
