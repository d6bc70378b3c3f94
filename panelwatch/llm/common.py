"""What the operators of this subpackage share: the working folder, lineage cuts, bounded samples, small text helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of a text that are looked at in one go; longer texts are worked through piece by piece.
STEP = 1 << 20
#: Bytes after which a batch of rows goes to Python, however few its rows are.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def workdir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) may make up its own; elsewhere a machine-local folder
    would lose rows, so a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session cuts batches of texts by their size; a smaller setting of the user's stays."""
    now = str(spark.conf.get(_BATCH)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, under the application's own folder."""
    return f"{workdir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a frame of short rows: computed once, survives lost executors."""
    workdir(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame as a compressed table in the shared folder: computed once, survives lost executors."""
    path = scratch(df.sparkSession, name)
    bounded_batches(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_ids(df: DataFrame, key: str, bound: int) -> list:
    """At most ``bound`` ids, those of smallest hash: the same rows at every run and split of the input.

    A top-k over id and hash only (each task keeps ``bound`` rows), so it stays small however long the rows are.
    """
    rows = df.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(F.col(key), F.lit("sample")), key).limit(bound).collect()
    return list(dict.fromkeys(r[0] for r in rows))


def spare(columns: list[str], name: str) -> str:
    """The name, with as many underscores more as make it different from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_ids(column: Column, ids: list) -> Column:
    return column.isin(ids) if ids else F.lit(False)


def chunks_of_words(text: str, step: int = STEP) -> Iterator[list[bytes]]:
    """The words of a text, runs of bytes other than ASCII white space, ASCII lower-cased, in lists of bounded size."""
    if len(text) <= step:
        words = text.encode().lower().split()
        if words:
            yield words
        return
    rest: list[bytes] = []
    for i in range(0, len(text), step):
        part = text[i : i + step].encode().lower()
        words = part.split()
        if not words:
            if rest:
                yield [b"".join(rest)]
                rest = []
            continue
        if rest and not part[:1].isspace():
            rest.append(words.pop(0))
            if not words and not part[-1:].isspace():
                continue
            words.insert(0, b"".join(rest))
            rest = []
        elif rest:
            words.insert(0, b"".join(rest))
            rest = []
        if not part[-1:].isspace():
            rest = [words.pop()]
        if words:
            yield words
    if rest:
        yield [b"".join(rest)]


def by_row(fn, batches: Iterator[pd.DataFrame], columns: list[str], flush: int = 20_000) -> Iterator[pd.DataFrame]:
    """Yield the tuples that ``fn(row tuple)`` gives for every row, as frames of about ``flush`` rows."""
    out: list[tuple] = []
    for pdf in batches:
        for row in zip(*(pdf[c] for c in pdf.columns)):
            out.extend(fn(*row))
            if len(out) >= flush:
                yield pd.DataFrame(out, columns=columns)
                out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def groups(batches: Iterator[pd.DataFrame], chars: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of rows ``(id, text)``, in groups of about ``chars`` characters."""
    ids, texts, held = [], [], 0
    for pdf in batches:
        for d, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
            ids.append(d)
            texts.append(t or "")
            held += len(texts[-1]) + 50
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
