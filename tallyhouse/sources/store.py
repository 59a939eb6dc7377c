"""Tables kept in versions on shared storage.

A version is one small JSON file that lists, for each table and month, the Parquet folders that hold it, the
highest number given out, and the batches posted so far. Data folders are never changed. A commit writes
new folders for the months it touches and then puts the next version file in place; that file
appears whole or not at all, and only if no other writer has put it there before. So readers see all of a
batch or nothing of it, in every table, and months that a batch does not touch keep their files.

The month of a document's lines is the month of its head, so a few months of documents are the same
few months of heads and lines. Masters are kept in one part. The driver handles folder names only:
one a table, month and commit.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyhouse.operators.stock import merged_sums, movement_sums, stock_running_balance
from tallyhouse.plans.batches import Posting
from tallyhouse.schemas import DDL, conform, schema
from tallyhouse.tables import Tables

#: The date that gives a row its month.
DATES = {
    "purchase_order_head": "po_date",
    "sales_invoice_head": "inv_dt",
    "goods_receipt_head": "grn_dt",
    "indent_request_head": "indent_dt",
    "stock_update": "update_date",
}
#: The key that rows are replaced and numbered by; lines are replaced by document.
KEYS = {
    "part": "part_num", "unit": "unit_id", "tax": "tax_id",
    "vendor": "vendor_code", "customer": "customer_code",
    "purchase_order_head": "po_no", "purchase_order_tran": "po_no",
    "sales_invoice_head": "inv_no", "sales_invoice_tran": "inv_no",
    "goods_receipt_head": "grn_no", "goods_receipt_tran": "grn_no",
    "indent_request_head": "indent_id", "indent_request_tran": "indent_id",
    "stock_update": "update_id",
}
HEAD_OF = {name: name.replace("_tran", "_head") for name in DDL if name.endswith("_tran")}
ALL = "all"
LEDGER, LEVELS = "stock_update", "stock_levels"
KEYS_ASKED = "keys"
PACKED = {"compression": "zstd"}
#: What Spark names the folder of rows without a month.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


class Conflict(Exception):
    """Another writer has changed a table that this posting reads and writes."""


@dataclass(frozen=True)
class Manifest:
    """One version: ``parts[table][month]`` are data folders, ``marks[table]`` the highest number of company
    1, ``batches`` the names of the batches posted, ``derived[name][month]`` tables made from the
    folders of ``covers`` up to that month."""

    version: int = 0
    parts: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)
    derived: dict[str, dict[str, dict]] = field(default_factory=dict)


def _any(conditions: list[Column]) -> Column:
    """OR as a balanced tree, whose depth stays small for many conditions."""
    if len(conditions) <= 1:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def _folder(commit: str, month: str) -> str:
    return f"commit={commit}/month={month}"


def _merged(made: dict, table: str, old: dict, new: dict, months: Iterable[str]) -> dict:
    """A derived table after a compaction: a month whose folders it covers is covered as merged."""
    covers = dict(made["covers"])
    for m in months:
        if made["table"] == table and set(old[m]) <= set(covers.get(m, [])):
            covers[m] = new.get(m, [])
    return {**made, "covers": covers}


def _of_commit(table: str, commit: str, months: Iterable[str]) -> Manifest:
    """Just the rows that one commit has written to a table."""
    return Manifest(parts={table: {m: [_folder(commit, m)] for m in months}})


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Files

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, folder: str) -> None:
        path = self._path(folder)
        path.getFileSystem(self._conf).delete(path, True)

    def _put(self, manifest: Manifest) -> bool:
        """The version file in place, whole; False if another writer was first."""
        text = json.dumps(manifest.__dict__, sort_keys=True)
        target = self._path(f"{self.root}/versions/{manifest.version:012}.json")
        draft = self._path(f"{self.root}/versions/_draft-{uuid.uuid4().hex}")
        fs = target.getFileSystem(self._conf)
        with_content = fs.create(draft, True)
        with_content.write(bytearray(text.encode()))
        with_content.close()
        no_overwrite = self.spark.sparkContext._gateway.new_array(
            self._jvm.org.apache.hadoop.fs.Options.Rename, 0
        )
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(target), no_overwrite)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True

    # Versions

    def versions(self) -> list[int]:
        found = (re.fullmatch(r"(\d+)\.json", n) for n in self._names(f"{self.root}/versions"))
        return sorted(int(m[1]) for m in found if m)

    def manifest(self, version: int | None = None) -> Manifest:
        """The given or the latest version; an empty one where there is none yet."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Manifest()
        rows = self.spark.read.text(f"{self.root}/versions/{version:012}.json", wholetext=True)
        return Manifest(**json.loads(rows.first().value))

    def rows(
        self, manifest: Manifest, table: str, months: Collection[str] | None = None
    ) -> DataFrame:
        """Rows of a table with their ``month``; other months are not even listed."""
        layout = StructType(
            [*schema(table), StructField("commit", StringType()), StructField("month", StringType())]
        )
        parts = manifest.parts.get(table, {})
        base = f"{self.root}/data/{table}"
        paths = [
            f"{base}/{folder}" for m, listed in parts.items() if months is None or m in months for folder in listed
        ]
        if not paths:
            return self.spark.createDataFrame([], layout).drop("commit")
        return self.spark.read.schema(layout).option("basePath", base).parquet(*paths).drop("commit")

    def tables(
        self, manifest: Manifest | None = None, months: Mapping[str, Collection[str]] | None = None
    ) -> Tables:
        """The tables of a version, with the highest numbers known; ``months`` cuts tables to some months."""
        current, cut = manifest or self.manifest(), months or {}
        return Tables(
            lambda name: conform(self.rows(current, name, cut.get(name)), name),
            marks=current.marks,
            standing=None if LEDGER in cut else lambda: standing(self, current),
        )

    def find(self, current: Manifest, table: str, keys: DataFrame, most: int = 1000) -> DataFrame:
        """The rows of company 1 whose key is in ``keys``. Up to ``most`` keys go to the scan as equalities, which
        Parquet checks against the limits and Bloom filters of row groups; more are joined. The keys are kept as a
        file until ``expire``: they are derived once, and the size of the file lets Spark broadcast a short list."""
        key = KEYS[table]
        rows = self.rows(current, table).filter("company = 1")
        asked = keys.select(F.col(key).cast(schema(table)[key].dataType)).dropna()
        wanted = self._listed(asked, f"{self.root}/{KEYS_ASKED}/{uuid.uuid4().hex}")
        listed = [k for (k,) in wanted.limit(most + 1).collect()]
        if len(listed) > most:
            return conform(rows.join(wanted, key, "left_semi"), table)
        return conform(rows.filter(_any([F.col(key) == k for k in sorted(listed)])), table)

    def _listed(self, keys: DataFrame, folder: str) -> DataFrame:
        """Distinct keys as files, derived once. Sorted and packed they take a few bytes a key, and Spark knows that
        size before a join: lines stay where they are as long as the keys are short enough to broadcast."""
        distinct = keys.distinct()
        distinct.sortWithinPartitions(*reversed(keys.columns)).write.options(**PACKED).parquet(folder)
        return self.spark.read.schema(distinct.schema).parquet(folder)

    @contextmanager
    def listed(self, keys: DataFrame) -> Iterator[DataFrame]:
        """Distinct keys as files for the time of a posting that joins them with heads and lines."""
        folder = f"{self.root}/staging-{uuid.uuid4().hex}"
        try:
            yield self._listed(keys, folder)
        finally:
            self._delete(folder)

    def months_of(self, manifest: Manifest, table: str, keys: DataFrame) -> list[str]:
        """Months of ``table`` (heads, ledger or masters) that hold one of ``keys`` (company, key)."""
        hit = self.rows(manifest, table).join(keys, ["company", KEYS[table]], "left_semi")
        return [m or NO_MONTH for (m,) in hit.select("month").distinct().collect()]

    def around(self, manifest: Manifest, head: str, keys: DataFrame) -> Tables:
        """The tables of a version with the documents of ``head`` and their lines cut to the months that hold
        one of ``keys``: what an edit of these documents has to read. The lines carry their ``month``."""
        key, tran = KEYS[head], head.replace("_head", "_tran")
        wanted = keys.select(F.lit(1).alias("company"), F.col(key).cast(schema(head)[key].dataType))
        months = self.months_of(manifest, head, wanted)
        near = self.tables(manifest, {head: months, tran: months})
        return Tables(
            lambda name: conform(self.rows(manifest, tran, months), tran, "month") if name == tran else getattr(near, name),
            near.marks,
            near.standing,
            {tran: months},
        )

    def between(self, manifest: Manifest, date_from=None, date_to=None) -> Tables:
        """The tables of a version with documents, their lines and the ledger cut to the months of an inclusive
        date range: a report over it reads these months only, on both sides of each join."""
        first, last = str(date_from or "")[:7], str(date_to or "9999-12")[:7]
        whole = not (date_from or date_to)
        return self.tables(
            manifest,
            {
                table: [m for m in manifest.parts.get(table, {}) if whole or (m != NO_MONTH and first <= m <= last)]
                for table in (*DATES, *HEAD_OF)
            },
        )

    # Writing

    def _write(self, rows: DataFrame, table: str, commit: str) -> tuple[list[str], int | None]:
        """Rows (with ``month``) as a new folder; (its months, the highest number in it)."""
        folder = f"{self.root}/data/{table}/commit={commit}"
        # Sorted by key and with Bloom filters of it: a lookup skips row groups without its keys.
        ordered = rows.hint("rebalance", "month").sortWithinPartitions("month", KEYS[table])
        bloom = {
            f"parquet.bloom.filter.enabled#{KEYS[table]}": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
        }
        ordered.write.options(**PACKED, **bloom).partitionBy("month").parquet(folder)
        months = [n.removeprefix("month=") for n in self._names(folder) if n.startswith("month=")]
        numbers = self.rows(_of_commit(table, commit, months), table).filter("company = 1").agg(F.max(KEYS[table]))
        return months, numbers.first()[0]

    def _with_month(self, rows: DataFrame, table: str, heads: DataFrame | None) -> DataFrame:
        """``heads`` (company, key, month) gives lines the month of their document."""
        if table in DATES:
            return rows.withColumn("month", F.date_format(DATES[table], "yyyy-MM"))
        if table in HEAD_OF:
            return rows.join(heads, ["company", KEYS[table]], "left")
        return rows.withColumn("month", F.lit(ALL))

    def _replaced(
        self, base: Manifest, table: str, new: DataFrame, keys: DataFrame, touched: list[str]
    ) -> DataFrame:
        """The rows of the touched months without those whose key is in ``keys``, and ``new``."""
        kept = self.rows(base, table, touched).join(keys, ["company", KEYS[table]], "left_anti")
        return kept.unionByName(new)

    def _rewritten(self, rows: DataFrame, table: str, touched: list[str]) -> DataFrame:
        """The rows of the touched months as a posting has them, changed ones in the month of their document: lines
        meet neither the heads nor the changed keys once more."""
        kept = F.coalesce("month", F.lit(NO_MONTH)).isin(touched)
        month = F.when(F.col("_hit"), F.date_format("_dated", "yyyy-MM")).otherwise(F.col("month"))
        return conform(rows.filter(F.col("_hit") | kept).withColumn("month", month), table, "month")

    def commit(self, posting: Posting, batch: str, base: Manifest) -> Manifest:
        """Saves a posting that was built on version ``base``: added rows beside the old ones, changed
        rows in place of those with their key. A batch that is already saved changes nothing. Raises
        ``Conflict`` when a table of the posting has changed since ``base``; a version that only touched
        other tables is built upon."""
        current = self.manifest()
        if batch in current.batches:
            return current
        commit = uuid.uuid4().hex
        tables = sorted({*posting.added, *posting.changed}, key=lambda t: (t in HEAD_OF, t))
        self._check(base, current, tables)
        parts = {t: {m: list(f) for m, f in base.parts.get(t, {}).items()} for t in tables}
        marks = {t: base.marks.get(t, 0) for t in tables}
        staging = f"{self.root}/staging-{commit}"
        months_touched: dict[str, list[str]] = {}
        heads: dict[str, DataFrame] = {}
        try:
            for table in tables:
                new, touched = [], []
                if table in posting.added:
                    new.append(conform(posting.added[table], table))
                months = months_touched.get(HEAD_OF.get(table), [])
                if table in posting.rewritten and set(months) <= set(posting.months[table]):
                    touched = months
                    new.append(self._rewritten(posting.rewritten[table], table, touched))
                elif table in posting.changed:
                    path = f"{staging}/{table}"
                    conform(posting.changed[table], table).write.options(**PACKED).parquet(path)
                    changed = self.spark.read.schema(schema(table)).parquet(path)
                    keys = self._listed(changed.select("company", KEYS[table]), f"{staging}/{table}-keys")
                    touched = months if table in HEAD_OF else self.months_of(base, table, keys)
                    months_touched[table] = touched
                    changed = self._with_month(changed, table, heads.get(HEAD_OF.get(table)))
                    new.append(self._replaced(base, table, changed, keys, touched))
                new[0] = new[0] if "month" in new[0].columns else self._with_month(
                    new[0], table, heads.get(HEAD_OF.get(table))
                )
                rows = new[0] if len(new) == 1 else new[0].unionByName(new[1])
                written, highest = self._write(rows, table, commit)
                for month in touched:
                    parts[table].pop(month, None)
                for month in written:
                    parts[table].setdefault(month, []).append(_folder(commit, month))
                marks[table] = max(marks[table], highest or 0)
                if table in HEAD_OF.values():
                    mine = self.rows(_of_commit(table, commit, written), table)
                    heads[table] = mine.select("company", KEYS[table], "month")
        finally:
            self._delete(staging)
        while True:
            following = replace(
                current,
                version=current.version + 1,
                parts={**current.parts, **parts},
                marks={**current.marks, **marks},
                batches=[*current.batches, batch],
            )
            if self._put(following):
                return following
            current = self.manifest()
            if batch in current.batches:
                return current
            self._check(base, current, tables)

    def _check(self, base: Manifest, current: Manifest, tables: Iterable[str]) -> None:
        changed = [t for t in tables if base.parts.get(t, {}) != current.parts.get(t, {})]
        if changed:
            raise Conflict(f"{', '.join(changed)}: version {current.version} is not version {base.version}")

    def post(
        self, build: Callable[[Manifest], Posting], batch: str, tries: int = 3
    ) -> Manifest:
        """Builds a posting on the latest version and saves it; after a conflict it is built anew."""
        for left in reversed(range(tries)):
            try:
                base = self.manifest()
                return base if batch in base.batches else self.commit(build(base), batch, base)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    @contextmanager
    def staged(self, *frames: DataFrame) -> Iterator[list[DataFrame]]:
        """The frames as files for the time of a posting, which reads its forms and lines several times."""
        folder = f"{self.root}/staging-{uuid.uuid4().hex}"
        try:
            for i, rows in enumerate(frames):
                rows.write.options(**PACKED).parquet(f"{folder}/{i}")
            yield [self.spark.read.schema(rows.schema).parquet(f"{folder}/{i}") for i, rows in enumerate(frames)]
        finally:
            self._delete(folder)

    def create(self, D: Tables, names: Iterable[str] = tuple(DDL), batch: str = "opening") -> Manifest:
        """The first version, with whole tables."""
        opening = Posting(rejects=None, added={name: getattr(D, name) for name in names})
        return self.commit(opening, batch, Manifest())

    def compact(self, table: str, most: int = 1) -> Manifest:
        """Months of more than ``most`` folders as one folder each, in a new version; readers of earlier
        versions keep their files."""
        base = self.manifest()
        months = [m for m, folders in base.parts.get(table, {}).items() if len(folders) > most]
        if not months:
            return base
        commit = uuid.uuid4().hex
        written, _ = self._write(self.rows(base, table, months), table, commit)
        parts = {m: f for m, f in base.parts[table].items() if m not in months}
        parts |= _of_commit(table, commit, written).parts[table]
        current = self.manifest()
        self._check(base, current, [table])
        return self.follow(
            current,
            parts={**current.parts, table: parts},
            derived={
                name: {m: _merged(d, table, base.parts[table], parts, months) for m, d in made.items()}
                for name, made in current.derived.items()
            },
        )

    def follow(self, current: Manifest, **changes) -> Manifest:
        """The version after ``current``; ``Conflict`` if another writer has made it."""
        following = replace(current, version=current.version + 1, **changes)
        if not self._put(following):
            raise Conflict(f"version {following.version} exists")
        return following

    def expire(self, keep: int) -> None:
        """Removes all but the last ``keep`` versions and the data folders that no other lists, and the keys
        of lookups. For times without writers and lookups: a commit on its way is not listed yet."""
        self._delete(f"{self.root}/{KEYS_ASKED}")
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        for name in {n for v in versions for n in self.manifest(v).derived}:
            used = {d["folder"] for m in kept for d in m.derived.get(name, {}).values()}
            for folder in self._names(f"{self.root}/data/{name}"):
                if folder not in used:
                    self._delete(f"{self.root}/data/{name}/{folder}")
        for v in versions[:-keep]:
            self._delete(f"{self.root}/versions/{v:012}.json")
        for table in DDL:
            used = {f for m in kept for listed in m.parts.get(table, {}).values() for f in listed}
            for commit in self._names(f"{self.root}/data/{table}"):
                for month in self._names(f"{self.root}/data/{table}/{commit}"):
                    if month.startswith("month=") and f"{commit}/{month}" not in used:
                        self._delete(f"{self.root}/data/{table}/{commit}/{month}")


# Stock levels kept with the ledger


def _order(month: str) -> str:
    """Movements without a date come before all others, as in the running balance."""
    return "" if month == NO_MONTH else month


def _snapshot(current: Manifest, before: str | None) -> tuple[str, dict]:
    """The latest kept levels before a month of which all files are still part of the ledger."""
    parts = current.parts.get(LEDGER, {})
    for month, made in sorted(current.derived.get(LEVELS, {}).items(), reverse=True):
        whole = all(set(listed) <= set(parts.get(m, [])) for m, listed in made["covers"].items())
        if whole and (before is None or month < before):
            return month, made
    return "", {"covers": {}}


def standing(store: Store, current: Manifest, before: str | None = None) -> DataFrame:
    """Movement sums per part of the ledger, or of its months ``before`` one: kept levels, and the sums of the
    folders they do not cover. Rows that came late lie in such folders, whatever their date."""
    _, made = _snapshot(current, before)
    open_parts = {
        m: [f for f in listed if f not in made["covers"].get(m, [])]
        for m, listed in current.parts.get(LEDGER, {}).items()
        if before is None or _order(m) < before
    }
    tail = movement_sums(store.rows(Manifest(parts={LEDGER: open_parts}), LEDGER))
    if "folder" not in made:
        return tail
    kept = store.spark.read.schema(tail.schema).parquet(f"{store.root}/data/{LEVELS}/{made['folder']}")
    return merged_sums(kept.unionByName(tail))


def keep_levels(store: Store, month: str) -> Manifest:
    """Keeps the movement sums of all parts at the end of ``month`` (yyyy-MM), made from the levels kept last and
    the rows since."""
    current = store.manifest()
    following = f"{month}~"  # after the month, before the next one
    folder = f"commit={uuid.uuid4().hex}"
    standing(store, current, following).write.parquet(f"{store.root}/data/{LEVELS}/{folder}")
    covers = {m: f for m, f in current.parts.get(LEDGER, {}).items() if _order(m) < following}
    made = {**current.derived.get(LEVELS, {}), month: {"folder": folder, "table": LEDGER, "covers": covers}}
    return store.follow(current, derived={**current.derived, LEVELS: made})


def balance_between(
    store: Store, current: Manifest, first: str, last: str, sign: str = "reference"
) -> DataFrame:
    """The running balance of the movements of some months: reads these, the levels kept before them and
    what these do not cover."""
    months = [m for m in current.parts.get(LEDGER, {}) if first <= m <= last and m != NO_MONTH]
    D = store.tables(current, {LEDGER: months})
    return stock_running_balance(D, sign, standing(store, current, first))
