"""What the operators share: the shared folder, written tables, the learning
split, and connected components."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.sources import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once a Spark context, so
    that their Python workers can import it wherever the driver found it."""
    sc = spark.sparkContext
    if any(os.path.basename(f).startswith("gridwork-") for f in sc.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="gridwork-ship-"), f"gridwork-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local
    session without that setting (tests) gets a fresh folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="gridwork-llm-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, and a lost executor only reruns what reads it."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_no(id_col: str) -> Column:
    """crc32 of the id's text modulo 4; rows with 2 are held out of learning
    (a null id counts as 2)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)), F.lit(2))


def is_held_out(id_col: str) -> Column:
    return split_no(id_col) == 2


def hash01(*cols: str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tidy() -> None:
    """Hand memory that is free in this process back to the system. Spark keeps
    idle Python workers; what they held at their peak would count beside the
    JVM's memory in the steps that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):       # glibc only
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that ends with :func:`tidy`."""
    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        tidy()
    return wrapped


class Memory:
    """Results by text piece, in two generations of ``size``: when the young
    one is full it becomes the old one, and what is asked for again moves to
    the young. Bounded, and what is frequent stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def recall(self, lists: Iterable[list[str]], make: Callable[[list[str]], dict]) -> Iterator[list]:
        """What belongs to each piece of each list. ``make`` gives what belongs
        to those not known; each is asked for once. Of the lists only the
        pieces not known are held."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        found, new = [], {}
        for pieces in lists:
            got, gaps, at = list(map(self.young.get, pieces)), [], -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                p = pieces[at]
                if (known := self.old.get(p)) is not None:
                    got[at] = self.young[p] = known
                else:
                    gaps.append((at, new.setdefault(p, p)))
            found.append((got, gaps))
        new = make(list(new))
        self.young.update(new)
        for got, gaps in found:
            for at, p in gaps:
                got[at] = new[p]
            yield got


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (u, v): rows (node, root),
    root the smallest node reachable. Alternates large-star and small-star
    steps, so the number of rounds grows with the logarithm of the longest
    path; every round is written to the shared folder, and only two numbers a
    round (edge count and checksum) come to the driver. A node with very many
    edges costs partial aggregates and a join that AQE can split, never one
    task's memory. No edges: an empty table."""
    hi, lo = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    cur = materialize(edges.where("u <> v").select(hi, lo).distinct(), tag)
    seen = None
    while True:
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), tag)
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
