"""Packs and fixtures as data sources of Spark, and indexes of folders that are compared from the top down.

``spark.read.format("fixtures").option("path", root)`` and ``format("packs")`` list folders once and read them in tasks, a partition for each
domain. A filter on the domain is pushed down: other domains' folders are not opened. The folder must be one that all
executors see; any file system that pyarrow opens will do.

An index has a row for each file and folder. A folder's digest is made of the digests of all files below it, each with
its path, by exclusive or: it is a partial aggregate, and two folders agree if it does. So two indexes are compared level by
level, and only below folders that differ.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from provenant.held import held

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _open(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


class Domain(InputPartition):
    """The files of one domain."""

    def __init__(self, name: str, files: list[str]):
        super().__init__(name)
        self.name, self.files = name, files


class _Reader(DataSourceReader):
    """Partitions by the first folder below the root."""

    def __init__(self, root: str, last: str):
        self.root, self.last = root, last
        self.only: set[str] | None = None

    def partitions(self) -> Sequence[InputPartition]:
        fs, top = _open(self.root)
        top = top.rstrip("/")
        domains = [f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(top)) if f.type == pyarrow.fs.FileType.Directory]
        out = []
        for name in sorted(d for d in domains if self.only is None or d in self.only):
            files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/{name}", recursive=True)) if f.type == pyarrow.fs.FileType.File and f.path.endswith(self.last)]
            if files:
                out.append(Domain(name, sorted(files)))
        return out or [Domain("", [])]


def _pruned(reader: type[_Reader]) -> type[_Reader]:
    """The reader with filters on the domain pushed down; Spark refuses such a reader while its setting is off."""

    class Pruned(reader):  # type: ignore[misc, valid-type]
        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute == ("domain",):
                    self.only = {f.value} if self.only is None else self.only & {f.value}
                else:
                    yield f

    return Pruned


class FixtureReader(_Reader):
    def read(self, partition: Domain) -> Iterator[tuple]:
        fs, _ = _open(self.root)

        def content(path: str) -> bytes | None:
            if fs.get_file_info(path).type != pyarrow.fs.FileType.File:
                return None
            with fs.open_input_file(path) as f:
                return f.read()

        for meta in partition.files:
            folder = meta.rpartition("/")[0]
            try:
                label = json.loads(content(meta) or b"").get("golden_label")
            except (ValueError, AttributeError):  # another format's, which no index here manages
                continue
            if label is None:
                continue
            expected, page = content(f"{folder}/expected.json"), content(f"{folder}/page.html.gz")
            yield partition.name, label, folder, expected and expected.decode(), page and gzip.decompress(page).decode("utf-8", "replace")


class PackReader(_Reader):
    def read(self, partition: Domain) -> Iterator[tuple]:
        import yaml

        fs, _ = _open(self.root)
        for path in partition.files:
            with fs.open_input_file(path) as f:
                document = yaml.safe_load(f.read())
            entity = path.rpartition("/")[2].removesuffix(".yaml")
            if not isinstance(document, dict) or (document.get("domain"), document.get("entity")) != (partition.name, entity):
                raise ValueError(f"{path}: its name and its content differ")
            yield partition.name, entity, int(document.get("version", 1)), json.dumps(document, sort_keys=True, default=str)


class Fixtures(DataSource):
    """(domain, label, folder, expected, html) of each golden fixture; null where a file is missing."""

    reader_type: type[_Reader] = FixtureReader

    @classmethod
    def name(cls) -> str:
        return "fixtures"

    def schema(self) -> str:
        return "domain string, label string, folder string, expected string, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reader_type(self.options["path"], "/meta.json")


class Packs(DataSource):
    """(domain, entity, version, document) of each pack; a document whose names differ from its path is an error."""

    reader_type: type[_Reader] = PackReader

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return "domain string, entity string, version int, document string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reader_type(self.options["path"], ".yaml")


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session; filters are pushed down if its setting ``PUSHDOWN`` is on."""
    push = spark.conf.get(PUSHDOWN, "false") == "true"
    for source, reader in ((Fixtures, FixtureReader), (Packs, PackReader)):
        spark.dataSource.register(type(source.__name__, (source,), {"reader_type": _pruned(reader) if push else reader}))


# ---------------------------------------------------------------- indexes

_LANES = ["d0", "d1", "d2", "d3"]


def files(spark: SparkSession, root: str, names: Sequence[str] = ("page.html.gz", "expected.json")) -> DataFrame:
    """(path, digest) of the files of these names below ``root``, by tasks; paths begin below the root."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.element_at(F.split("path", "/"), -1).isin(*names))
    whole = root.split("://")[-1].rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{whole}/", "")
    return read.select(below.alias("path"), F.sha2("content", 256).alias("digest"))


def index(found: DataFrame) -> DataFrame:
    """(depth, parent, path, is_file, n, d0 to d3) of ``found`` (path, digest): a row for each file and each folder above one.

    ``n`` is how many files a folder has below it; the lanes are the exclusive or of what their SHA-256 over path and
    digest has. The root is the empty path at depth 0. Null paths are left out; a path that comes twice counts twice.
    """
    parts = F.split("path", "/")
    each = found.filter("path is not null").select("path", F.size(parts).alias("size"), F.sha2(F.concat_ws("\x00", "path", F.coalesce("digest", F.lit("")), F.col("digest").isNull().cast("string")), 256).alias("_h"), parts.alias("_parts"))
    lanes = [F.conv(F.substring("_h", 1 + 16 * k, 15), 16, 10).cast("long").alias(c) for k, c in enumerate(_LANES)]
    up = each.select(F.explode(F.sequence(F.lit(0), F.col("size"))).alias("depth"), "_parts", "size", *lanes)
    at = lambda k: F.array_join(F.slice("_parts", F.lit(1), k), "/")
    rows = up.select("depth", F.when(F.col("depth") > 0, at(F.col("depth") - 1)).alias("parent"), at(F.col("depth")).alias("path"), (F.col("depth") == F.col("size")).alias("is_file"), *_LANES)
    return rows.groupBy("depth", "parent", "path", "is_file").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(c).alias(c) for c in _LANES])


def descend(committed: DataFrame, now: DataFrame) -> tuple[DataFrame, int]:
    """(path, change) of the files that differ between two indexes, and how many rows of both were compared.

    Level by level: of each level only what stands in folders that differ is joined; where nothing differs the
    descent ends. Changes are ``added``, ``removed`` and ``changed``.
    """
    spark, frontier, depth, compared, out = committed.sparkSession, None, 0, 0, []
    while True:
        sides = []
        for side in (committed, now):
            level = side.filter(F.col("depth") == depth)
            sides.append(level if frontier is None else level.join(frontier, F.col("parent") == F.col("_folder"), "left_semi"))
        a, b = (s.select("path", "is_file", F.struct("n", *_LANES).alias(name)) for s, name in zip(sides, ("a", "b"), strict=True))
        level = held(a.join(b, ["path", "is_file"], "full_outer"), "descent")
        compared += level.count()
        differ = level.filter(~F.col("a").eqNullSafe(F.col("b")))
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
        out.append(differ.filter("is_file").select("path", change.alias("change")))
        frontier, depth = differ.filter("not is_file").select(F.col("path").alias("_folder")), depth + 1
        if frontier.isEmpty():
            break
    return reduce(DataFrame.union, out, spark.createDataFrame([], "path string, change string")), compared
