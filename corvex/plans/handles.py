"""Indexes that live on between questions: a bounded cache by tenant, site and version of the corpus, backed by stored folders."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from ..operators import retrieval as R
from ..sources.storage import exists, remove, still_there

Handle = tuple[R.KeywordIndex, DataFrame]


class IndexHandles:
    """Keyword index and vectors of a tenant's site (None: all sites), for a version of its corpus.

    A handle comes from memory, from its folder below root, or is built by `chunks`, in that order;
    one that was built is stored. At most `most` are in memory, the one used longest ago goes first; its
    folder stays. A site has one version: when another is asked for, the older one's folder goes.
    Folders are named by digests, so any tenant's name will do; a mark is written last, so a folder
    that a lost driver left unfinished is built again.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 16):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most
        self.held: OrderedDict[tuple, Handle] = OrderedDict()
        self.built = self.loaded = 0

    def folder(self, tenant: str, site: str | None) -> str:
        return f"{self.root}/{sha256(json.dumps([tenant, site]).encode()).hexdigest()[:24]}"

    def get(self, tenant: str, site: str | None, version: object, chunks: Callable[[], DataFrame]) -> Handle:
        if not tenant:
            raise ValueError("a tenant is required")
        name = sha256(repr(version).encode()).hexdigest()[:24]
        key, path = (tenant, site, name), f"{self.folder(tenant, site)}/{name}"
        handle = self.held.get(key)
        if handle is None or not still_there(handle[0].corpus):
            self.forget(tenant, site)
            if exists(self.spark, f"{path}/done"):
                index = R.load_index(self.spark, f"{path}/index")
                handle = index, self.spark.read.parquet(f"{path}/vectors")
                self.loaded += 1
            else:
                remove(self.spark, self.folder(tenant, site))
                index = R.build_index(chunks(), f"{path}/index")
                handle = index, R.store_vectors(index.corpus, path=f"{path}/vectors")
                self.spark.range(1).write.parquet(f"{path}/done")
                self.built += 1
        self.held[key] = handle
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.drop_from_memory(next(iter(self.held)))
        return handle

    def drop_from_memory(self, key: tuple) -> None:
        index, vectors = self.held.pop(key)
        for table in (index.corpus, index.blocks, index.terms, index.stats, vectors):
            table.unpersist()  # in case a caller has cached one

    def forget(self, tenant: str, site: str | None) -> None:
        """Drop a site's versions from memory."""
        for key in [k for k in self.held if k[:2] == (tenant, site)]:
            self.drop_from_memory(key)

    def invalidate(self, tenant: str, site: str | None = None) -> bool:
        """A site's index goes, from memory and from its folder, and that of all the tenant's sites; whether there was one."""
        there = False
        for s in {site, None}:
            self.forget(tenant, s)
            there |= remove(self.spark, self.folder(tenant, s))
        return there
