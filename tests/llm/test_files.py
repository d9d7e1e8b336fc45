import helpers as H
import pytest
from pyspark.sql import functions as F

from ombuds.llm import graph, minhash, substring

PARTS = 40


@pytest.fixture
def files(spark, monkeypatch):
    """Files of each table that the operators write, from inputs and shuffles of many partitions."""
    found = {}

    def spied(write):
        def run(session, df, name):
            out = write(session, df, name)
            found[name] = max(found.get(name, 0), len(out.inputFiles()))
            return out
        return run

    for module in (graph, minhash, substring):
        monkeypatch.setattr(module, "written", spied(module.written))
    conf = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield found
    for k, v in before.items():
        spark.conf.set(k, v)


def texts():
    """300 texts, all different; the first ten share a passage, the next ten are near copies, then exact ones."""
    out = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    shared = " ".join(f"s{j}" for j in range(30))
    for i in range(10):
        out[i] += " " + shared
        out[10 + i] = " ".join([f"n{j}" for j in range(200)] + [f"end{i}"])
        out[20 + i] = "exact " * 6 + "copy"
    return list(enumerate(out))


def most(spark):
    return 4 * max(6, spark.sparkContext.defaultParallelism)


def test_near_duplicates_write_few_files(spark, files):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(PARTS, "doc_id")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == H.classes(texts())
    assert {"profiles", "members", "edges", "candidates", "blocks", "roots"} <= set(files)
    assert max(files.values()) <= most(spark) < PARTS


def test_repeated_passages_write_few_files(spark, files):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(PARTS, "doc_id")
    got = {r.doc_id: r.n_removed for r in substring.remove(docs).collect()}
    assert got == {i: sum(gone) for i, (_, gone) in H.removed_by_windows(texts()).items()}
    assert {"scanned", "runs", "firsts", "spans"} <= set(files)
    assert max(files.values()) <= most(spark) < PARTS


def test_row_numbers_stay_unique(spark):
    """Partitions that are worked in one task keep their own numbers."""
    from ombuds.session import few
    rows = few(spark.range(3000, numPartitions=PARTS).select(F.monotonically_increasing_id().alias("uid")), 1)
    assert rows.distinct().count() == 3000
