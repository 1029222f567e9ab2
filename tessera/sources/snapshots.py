"""The index on disk: segments of rows, and versions that say which segments hold.

A pass never touches what is being read.  It writes a segment - new rows, and which documents are withdrawn - and commits
the next version, a small file that lists all segments.  The file is created or not at all, so of two passes that started
from one version the second one fails with `Conflict` and starts again from the first one's result.  What is written
follows what has changed, not the size of the index.

Rows carry the generation (version) that wrote them.  A withdrawn document hides its rows of earlier generations; its
postings leave the counts by blocks of negative size, and counts of documents by type, module, status and tag are kept as
signed sums.  ``compact`` writes all that stands as one segment again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lexical

DATASETS = {
    "documents": "gen long, doc_id long, path string, title string, summary string, type string, module string, status string, owner string, tags array<string>, updated string, hash string",
    "chunks": "gen long, chunk_id long, doc_id long, heading string, content string, position int",
    "vectors": "gen long, chunk_id long, embedding array<float>",
    "blocks": lexical.BLOCKS,
    "totals": lexical.TOTALS,
    "gone": "gen long, part int, doc_id long, chunk_id long",
    "counts": "gen long, field string, value string, n long",
}
#: What identifies a row that a withdrawn document hides.
HIDDEN_BY = {"documents": "doc_id", "chunks": "doc_id", "vectors": "chunk_id"}
#: Segments after which a pass compacts the index.
MAX_SEGMENTS = 16


class Conflict(RuntimeError):
    """Another pass has committed a version since this one began."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: int
    segments: tuple[str, ...]


def names(dataset: str) -> list[str]:
    return [c.split()[0] for c in DATASETS[dataset].split(", ")]


class SnapshotStore:
    """The newest version, or the one it is pinned to."""

    def __init__(self, spark: SparkSession, path: str, pinned: Version | None = None):
        self.spark, self.path, self._pinned = spark, path.rstrip("/"), pinned

    # ------------------------------------------------------------ versions
    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, Path = self._fs()
        folder = Path(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[1:-5]) for n in found if n.startswith("v") and n.endswith(".json"))

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/v{number:012d}.json"

    def current(self) -> Version | None:
        if self._pinned is not None:
            return self._pinned
        numbers = self._numbers()
        if not numbers:
            return None
        fs, Path = self._fs()
        stream = fs.open(Path(self._file(numbers[-1])))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(told["number"], told["parts"], tuple(told["segments"]))

    def pinned(self) -> SnapshotStore:
        """Reads of what is returned all see one version."""
        return SnapshotStore(self.spark, self.path, self.current() or Version(0, 1, ()))

    def commit(self, version: Version) -> None:
        """Creates the version's file, unless it is there already."""
        fs, Path = self._fs()
        own, final = f"{self.path}/versions/.new-{uuid.uuid4().hex}", self._file(version.number)
        out = fs.create(Path(own), True)
        out.write(bytearray(json.dumps({"number": version.number, "parts": version.parts, "segments": list(version.segments)}).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would replace the other pass's file
                file = self.spark._jvm.java.io.File
                plain = lambda p: file(Path(p).toUri().getPath()).toPath()
                try:
                    self.spark._jvm.java.nio.file.Files.createLink(plain(final), plain(own))
                except Py4JJavaError as e:
                    if "FileAlreadyExists" in str(e.java_exception):
                        raise Conflict(f"version {version.number} is taken") from None
                    raise
            elif fs.exists(Path(final)) or not fs.rename(Path(own), Path(final)):
                raise Conflict(f"version {version.number} is taken")
        finally:
            fs.delete(Path(own), False)

    # ------------------------------------------------------------ reading
    def _rows(self, name: str, version: Version | None) -> DataFrame:
        paths = [f"{self.path}/{s}/{name}" for s in (version.segments if version else ())]
        if not paths:
            return self.spark.createDataFrame([], DATASETS[name])
        return self.spark.read.schema(DATASETS[name]).parquet(*paths)

    def _gone(self, version: Version | None, key: str) -> DataFrame | None:
        """(key, since): what is withdrawn; None in an index of one segment, which withdraws nothing."""
        if version is None or len(version.segments) < 2:
            return None
        return self._rows("gone", version).groupBy(F.col(key).alias("_key")).agg(F.max("gen").alias("_since"))

    def read(self, name: str, with_gen: bool = False) -> DataFrame:
        """The rows of a dataset that stand."""
        version = self.current()
        rows = self._rows(name, version)
        key = HIDDEN_BY.get(name)
        gone = self._gone(version, key) if key else None
        if gone is not None:
            rows = rows.join(gone, (F.col(key) == F.col("_key")) & (F.col("gen") < F.col("_since")), "left_anti")
        return rows if with_gen else rows.drop("gen")

    def inverted(self) -> lexical.Inverted:
        version = self.current()
        one = version is None or len(version.segments) < 2
        gone = None if one else self._rows("gone", version).select("part", "chunk_id", "gen")
        return lexical.Inverted(self._rows("blocks", version), self._rows("totals", version), version.parts if version else 1, gone)

    def counts(self) -> DataFrame:
        """(field, value, n): documents by type, module, status and tag, and all of them; no document is read."""
        return self._rows("counts", self.current()).groupBy("field", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def has_vectors(self) -> bool:
        return self.current() is not None and not self.read("vectors").isEmpty()

    # ------------------------------------------------------------ writing
    def segment(self, **datasets: DataFrame) -> str:
        """Writes a segment that no version lists yet; datasets that are not given are empty."""
        name = f"segment-{uuid.uuid4().hex}"
        for dataset, schema in DATASETS.items():
            df = datasets.get(dataset)
            df = self.spark.createDataFrame([], schema) if df is None else df.select(*names(dataset))
            if dataset == "blocks":  # terms lie together, so a query's terms prune row groups
                df = df.sortWithinPartitions("part", "term")
            df.write.parquet(f"{self.path}/{name}/{dataset}")
        return name

    def write(self, **datasets: DataFrame) -> Version:
        """A new index of these datasets alone, whatever was there: documents, chunks and vectors, with all that follows."""
        documents, chunks = datasets.get("documents"), datasets.get("chunks")
        parts = lexical.parts_of(chunks.count()) if chunks is not None else 1
        own = dict(datasets)
        if documents is not None:
            own["counts"] = counted(documents)
        if chunks is not None:
            own |= {"blocks": lexical.blocks(chunks, parts), "totals": lexical.totals(chunks, parts)}
        name = self.segment(**{k: of_generation(v, 0) for k, v in own.items()})
        while True:
            base = self.current()
            version = Version(base.number + 1 if base else 1, parts, (name,))
            try:
                self.commit(version)
                return version
            except Conflict:  # a whole index replaces whatever is there
                continue

    def append(self, base: Version | None, name: str) -> Version:
        """Commits a segment on top of the version that it was made from."""
        version = Version(base.number + 1, base.parts, (*base.segments, name)) if base else Version(1, 1, (name,))
        self.commit(version)
        return version

    def compact(self) -> Version:
        """What stands as one segment; the number of parts follows the number of chunks."""
        base = self.current()
        whole = SnapshotStore(self.spark, self.path, base)
        chunks = whole.read("chunks")
        parts = lexical.parts_of(chunks.count())
        documents = whole.read("documents")
        own = {"documents": documents, "chunks": chunks, "vectors": whole.read("vectors"), "counts": counted(documents), "blocks": lexical.blocks(chunks, parts), "totals": lexical.totals(chunks, parts)}
        version = Version(base.number + 1, parts, (self.segment(**{k: of_generation(v, 0) for k, v in own.items()}),))
        self.commit(version)
        return version

    def size(self, segment: str) -> int:
        fs, Path = self._fs()
        return fs.getContentSummary(Path(f"{self.path}/{segment}")).getLength()

    def vacuum(self) -> None:
        """Removes segments and versions that no longer hold; call it when nobody reads or writes them."""
        fs, Path = self._fs()
        keep = SnapshotStore(self.spark, self.path).current()
        for status in fs.listStatus(Path(self.path)):
            name = status.getPath().getName()
            if name.startswith("segment-") and (keep is None or name not in keep.segments):
                fs.delete(status.getPath(), True)
        for number in self._numbers()[:-1]:
            fs.delete(Path(self._file(number)), False)


def of_generation(df: DataFrame, gen: int) -> DataFrame:
    return df.withColumn("gen", F.lit(gen).cast("long"))


def counted(documents: DataFrame, sign: int = 1) -> DataFrame:
    """(field, value, n) of documents: all, by type, module and status, and by tag in lower case; what is absent is not counted."""
    every = F.struct(F.lit("documents").alias("field"), F.lit("").alias("value"))
    own = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("type", "module", "status")]
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("field"), F.lower(t).alias("value")))
    pairs = documents.select(F.explode(F.concat(F.array(every, *own), tags)).alias("p")).select("p.*").where("value is not null")
    return pairs.groupBy("field", "value").agg((F.count("*") * sign).alias("n"))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of the keys in new replaced by new's."""
    return without(old, new, key).unionByName(new)


def appended_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors added; a chunk that has one already is an error."""
    twice = old.join(new.select("chunk_id"), "chunk_id", "left_semi")
    if not twice.isEmpty() or not new.groupBy("chunk_id").count().where("count > 1").isEmpty():
        raise ValueError("a chunk would have two vectors")
    return old.unionByName(new)


def write_text(path: str, content: str) -> bool:
    """Writes a text file unless it holds the same already, line ends aside; says whether it wrote."""
    same = lambda s: s.replace("\r\n", "\n")
    try:
        with open(path, encoding="utf-8", newline="") as f:
            if same(f.read()) == same(content):
                return False
    except OSError:
        pass
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(content)
    return True
