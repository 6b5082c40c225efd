"""The store of a knowledge base: Parquet snapshots of its collections behind a pointer that is renamed into place.

Rows stand in buckets by their document, as many as the corpus asks for when the store is first filled. A change writes the buckets that it touches anew and then moves the pointer, so
readers see the old state or the new one and a crash leaves the old one. The snapshots of the state before are kept for readers that are
still at it, older ones are removed. Images are rows of a collection, under the path that they are exported to, so they
come and go with their documents. Paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTIONS = {
    "chunks": "row_id string, doc_uid string, document_name string, source_path string, page_number int, line_start int, line_end int, chunk_index int, content_type string, text string, caption string, image_path string, embedding array<float>",
    "figures": "row_id string, doc_uid string, document_name string, source_path string, page_number int, line_start int, line_end int, figure_index int, kind string, label string, caption string, image_path string, text string, embedding array<float>",
    "images": "row_id string, doc_uid string, image_path string, data binary",
    "manifest": "doc_uid string, document_name string, source_path string, rel_path string, sha256 string, size_bytes long, mtime double, status string, page_count int, chunk_count int, figure_count int, table_count int, parser_version string, error string, indexed_at string, updated_at string",
}


LEAST_BUCKETS, MOST_BUCKETS = 64, 16_384
BUCKET_BYTES = 256 << 20  # of files that one bucket takes, about, up to MOST_BUCKETS
TRIES = 10  # to read the pointer while it is moved


def bucket_of(uid: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("int")


class BackendChanged(RuntimeError):
    """The store's vectors come from another embedding backend than the one given."""


class Store:
    """Snapshots under `root`; `fingerprint` names the embedding backend that its vectors come from."""

    def __init__(self, spark: SparkSession, root: str, fingerprint: str = ""):
        self.spark, self.root, self.fingerprint = spark, root.rstrip("/"), fingerprint
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        state = self._state()
        self._known = _paths(state["tables"]) | _paths(state.get("before", {}))

    def _state(self) -> dict:
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return {"tables": {}, "meta": {}}
        for left in range(TRIES, -1, -1):
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(at), "UTF-8"))
            except Exception:  # it and its checksum are renamed into place one after the other
                if not left:
                    raise
                time.sleep(0.1)

    def _move(self, state: dict) -> None:
        new, at = self._path(f"{self.root}/CURRENT.{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT")
        self._fs.mkdirs(self._path(self.root))
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if "://" in self.root else self._fs.getUri())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(at), options)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A collection, or its rows in some buckets."""
        known = self._state()["tables"].get(name, {})
        paths = [path for b, path in known.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(COLLECTIONS[name]).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], COLLECTIONS[name])

    @property
    def buckets(self) -> int:
        return self._state().get("buckets", LEAST_BUCKETS)

    def sized(self, n_bytes: int) -> None:
        """Sets the number of buckets for so many bytes of files, if the store holds no rows; others keep theirs until they
        are rebuilt."""
        state = self._state()
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES)))
        if not _paths(state["tables"]) and buckets != state.get("buckets", LEAST_BUCKETS):
            state["buckets"] = buckets
            self._move(state)

    def touched(self, uids: DataFrame) -> list[int]:
        """The buckets of documents (doc_uid)."""
        return sorted(r[0] for r in uids.select(bucket_of(F.col("doc_uid"), self.buckets)).distinct().collect())

    def get_meta(self, key: str) -> str | None:
        return self._state()["meta"].get(key)

    def set_meta(self, key: str, value: str) -> None:
        state = self._state()
        state["meta"][key] = value
        self._move(state)

    def check_backend(self) -> None:
        """Raises if the stored vectors are another backend's; a store without one takes this one's name."""
        known = self.get_meta("fingerprint")
        if known is None:
            self.set_meta("fingerprint", self.fingerprint)
        elif known != self.fingerprint:
            raise BackendChanged(f"vectors are from {known}, not {self.fingerprint}: rebuild the store")

    def write(self, buckets: list[int] | None = None, **tables: DataFrame) -> None:
        """New snapshots of the collections given, or of some of their buckets, all seen at once."""
        state = self._state()
        before = state["tables"]
        state["tables"] = dict(before)
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            fields = [f.split(" ")[0] for f in COLLECTIONS[name].split(", ")]
            rows = df.select(*fields, bucket_of(F.col("doc_uid"), state.get("buckets", LEAST_BUCKETS)).alias("_b"))
            rows = rows if buckets is None else rows.where(F.col("_b").isin(buckets))
            rows.hint("rebalance", "_b").write.partitionBy("_b").parquet(f"{self.root}/{folder}")
            kept = {} if buckets is None else {b: p for b, p in before.get(name, {}).items() if int(b) not in buckets}
            made = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")))
            state["tables"][name] = kept | {n.removeprefix("_b="): f"{folder}/{n}" for n in made if n.startswith("_b=")}
        state["before"] = before
        self._move(state)
        now = _paths(state["tables"]) | _paths(before)
        for path in self._known - now:
            self.remove_path(path)
        for folder in {p.split("/")[0] for p in self._known - now} - {p.split("/")[0] for p in now}:
            self.remove_path(folder)
        self._known = now

    def remove_path(self, path: str) -> None:
        """Removes a folder under the root."""
        self._fs.delete(self._path(f"{self.root}/{path}"), True)

    def replace_documents(self, chunks: DataFrame, figures: DataFrame, images: DataFrame | None = None, manifest: DataFrame | None = None) -> None:
        """Takes the place of all rows of the documents that chunks or figures hold; their images go too. The rows of
        manifest, those of the same and of other documents, take the place of the ones known in the same step."""
        uids = chunks.select("doc_uid").unionByName(figures.select("doc_uid")).distinct()
        changed = uids if manifest is None else uids.unionByName(manifest.select("doc_uid"))
        buckets = self.touched(changed)
        images = self.read("images").limit(0) if images is None else images
        new = {n: upserted(without(self.read(n, buckets), uids), d) for n, d in (("chunks", chunks), ("figures", figures), ("images", images))}
        if manifest is not None:
            new["manifest"] = without(self.read("manifest", buckets), manifest).unionByName(manifest)
        self.write(buckets, **new)

    def delete_documents(self, uids: DataFrame) -> None:
        """Takes documents out of all collections, the manifest and their images among them."""
        buckets = self.touched(uids)
        self.write(buckets, **{n: without(self.read(n, buckets), uids) for n in COLLECTIONS})

    def reset(self) -> None:
        """Empty collections and no backend."""
        self.write(**{n: self.spark.createDataFrame([], s) for n, s in COLLECTIONS.items()})
        state = self._state()
        state["meta"].pop("fingerprint", None)
        self._move(state)


def _paths(tables: dict[str, dict[str, str]]) -> set[str]:
    return {path for of in tables.values() for path in of.values()}


def without(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """rows but those of the documents uids (doc_uid)."""
    return rows.join(uids.select("doc_uid"), "doc_uid", "left_anti").select(rows.columns)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those of the same row_id."""
    return old.join(new.select("row_id"), "row_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))


def counts(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """(collection, n) of both collections."""
    one = lambda d, n: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("collection"), "n")
    return one(chunks, "chunks").unionByName(one(figures, "figures"))


def document_names(chunks: DataFrame) -> DataFrame:
    return chunks.where("document_name <> ''").select("document_name").distinct().orderBy("document_name")


def image_paths(figures: DataFrame, uid: str) -> DataFrame:
    return figures.where((F.col("doc_uid") == uid) & (F.col("image_path") != "")).select("image_path")


def orphans(before: DataFrame, after: DataFrame, images_dir: str) -> DataFrame:
    """Image paths of `before` that `after` lacks and that lie inside images_dir; no path with a .. step does."""
    gone = before.select("image_path").where("image_path <> ''").subtract(after.select("image_path"))
    return gone.where(F.startswith("image_path", F.lit(images_dir.rstrip("/") + "/")) & ~F.col("image_path").rlike(r"(^|/)\.\.(/|$)"))
