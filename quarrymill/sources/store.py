"""Blobs under a folder that Spark can reach, and a small cache of texts over it."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import SparkSession


class Store:
    """Bytes by relative key, in any file system that Spark's own file layer opens: a local disk or a shared one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._system = self._path("").getFileSystem(self._conf)

    def _path(self, key: str):  # noqa: ANN202 - a JVM object
        if ".." in key.split("/"):
            raise ValueError(f"a key stays below the root: {key}")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def exists(self, key: str) -> bool:
        return self._system.exists(self._path(key))

    def modified(self, key: str) -> tuple[int, int] | None:
        """(time, length) of a blob, or None."""
        if not self.exists(key):
            return None
        status = self._system.getFileStatus(self._path(key))
        return status.getModificationTime(), status.getLen()

    def read(self, key: str) -> bytes | None:
        if not self.exists(key):
            return None
        stream = self._system.open(self._path(key))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, key: str, data: bytes) -> None:
        """The blob appears under its key as a whole."""
        part = self._path(key + ".part")
        stream = self._system.create(part, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self._system.delete(self._path(key), False)
        self._system.rename(part, self._path(key))

    def delete(self, key: str) -> None:
        self._system.delete(self._path(key), True)

    def keys(self, prefix: str = "") -> list[str]:
        """Keys that begin with a prefix, in order."""
        if not self.exists(""):
            return []
        found, base = [], self._path("").toUri().getPath().rstrip("/") + "/"
        listing = self._system.listFiles(self._path(""), True)
        while listing.hasNext():
            key = listing.next().getPath().toUri().getPath()[len(base) :]
            if key.startswith(prefix) and not key.rsplit("/", 1)[-1].startswith("."):
                found.append(key)
        return sorted(found)


class TextCache:
    """The texts of a store's blobs read last, read anew when the blob changes. Hits and misses are counted."""

    def __init__(self, store: Store, most: int = 256) -> None:
        self.store, self.most, self.hits, self.misses = store, most, 0, 0
        self._held: OrderedDict[str, tuple[tuple[int, int], str]] = OrderedDict()

    def get(self, key: str) -> str | None:
        now = self.store.modified(key)
        held = self._held.pop(key, None)
        if now is None:
            self.misses += 1
            return None
        if held is None or held[0] != now:
            self.misses += 1
            held = now, (self.store.read(key) or b"").decode("utf-8", "replace")
        else:
            self.hits += 1
        self._held[key] = held
        while len(self._held) > self.most:
            self._held.popitem(last=False)
        return held[1]

    def forget(self, key: str | None = None) -> None:
        """Drop one text, or all."""
        if key is None:
            self._held.clear()
        else:
            self._held.pop(key, None)

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0, "size": len(self._held)}
