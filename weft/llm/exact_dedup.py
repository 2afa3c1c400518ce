"""Exact duplicates by content sort.

One pass over the texts stores each row's normalised bytes with their first characters, SHA-256 and
length. Rows are range-partitioned by sampled splitters over (first characters, SHA-256, salt), sorted
on disk within each partition by these and by the normalised bytes, and each row is compared in full
with its neighbour: where they differ a new run begins. Runs alone decide which rows are equal, how
many they are and which one stays (most code points, then smallest id); the digest only keeps the
splitter key short (a long text would otherwise reach the driver's sample) and orders contents that
begin alike.

Digests that hold at least ``1/HOT_SHARE`` of all rows — at most ``HOT_SHARE`` of them, whatever the
data — are dealt to salts in proportion to their rows, ``SPREAD`` a shuffle partition in all. The runs
of such a digest, one a salt and text, are then sorted and compared in full the same way: there are at
most ``SPREAD`` times the shuffle partitions and two for each such digest (but for colliding digests).

Defined results: null text is the empty text, so all empty and all-white-space texts are one group;
a null id sorts after every other id; repeated rows with the same id count as rows of their group,
and exactly one row of a group is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import HOT_SHARE, whole
from weft.runtime import materialize, shuffle_partitions

SPACES = "\t\n\x0b\f\r "
HEAD = 32
SPREAD = 4


def normalised(text: Column | str) -> Column:
    return F.translate(whole(text), SPACES, "")


def _prepared(df: DataFrame, id_col: str, text_col: str, payload: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of digests that are not hot, and rows of hot ones (None where there are none): ``at`` (a
    row number), ``id, n, head, sha`` (and ``salt``, if hot) and ``norm``, or the column ``payload``, a struct that
    holds the text, where one is named (the text is then stored and shuffled within it)."""
    rows = df.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("id"), whole(text_col).alias("t"), *([payload] if payload else []))
    rows = rows.select("*", F.char_length("t").alias("n"), normalised("t").alias("norm"))
    rows = rows.select("*", F.substring("norm", 1, HEAD).alias("head"), F.sha2("norm", 256).alias("sha")).drop("t", *(["norm"] if payload else []))
    rows = materialize(rows, "normalised")
    total, spread = rows.count(), SPREAD * shuffle_partitions(df.sparkSession)
    copies = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).filter((F.col("copies") > 1) & (F.col("copies") >= -(-total // HOT_SHARE)))
    hot = materialize(copies.select("sha", F.ceil(F.col("copies") * spread / total).alias("salts")), "hot")
    if hot.isEmpty():
        return rows, None
    return rows.join(F.broadcast(hot), "sha", "left_anti"), rows.join(F.broadcast(hot), "sha").withColumn("salt", F.pmod("at", "salts")).drop("salts")


COLD, HOT = ("head", "sha"), ("head", "sha", "salt")


def _runs(rows: DataFrame, keys: tuple[str, ...], payload: str | None = None, field: str = "text") -> DataFrame:
    """``rows`` range-partitioned and sorted by content, with ``norm``, ``run`` and ``fresh``."""
    rows = rows.repartitionByRange(*keys)
    if payload:
        rows = rows.withColumn("norm", normalised(F.col(f"{payload}.`{field}`")))
    return _compared(rows, *keys)


def _compared(rows: DataFrame, *keys: str, run: str = "run", fresh: str = "fresh") -> DataFrame:
    """``rows`` sorted by content within ``keys``; a row that differs from the one before it is
    ``fresh`` and begins a new ``run``."""
    content = Window.partitionBy(*keys).orderBy("norm", F.desc("n"), F.asc_nulls_last("id"), "at")
    before = F.lag("norm").over(content)
    rows = rows.withColumn(fresh, before.isNull() | (before != F.col("norm")))
    return rows.withColumn(run, F.sum(F.col(fresh).cast("int")).over(content.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _whole_groups(leads: DataFrame) -> DataFrame:
    """The runs of hot digests with ``first`` (the first row of all equal runs) and ``all_rows``."""
    same = Window.partitionBy("head", "sha", "group")
    leads = _compared(leads, "head", "sha", run="group", fresh="leads")
    return leads.select("*", F.max(F.when(F.col("leads"), F.struct("at", "id"))).over(same).alias("first"), F.sum("size").over(same).alias("all_rows"))


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row of ``df``."""
    cold, hot = _prepared(df, id_col, text_col)

    def sized(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        run = Window.partitionBy(*keys, "run")
        return rows.select("*", F.count(F.lit(1)).over(run).alias("size"), F.max(F.when(F.col("fresh"), F.struct("at", "id"))).over(run).alias("first"))

    named = lambda rows, size: rows.select("id", F.col("first.id").alias("keep_id"), F.col(size).alias("group_size"), (F.col("first.at") == F.col("at")).alias("kept"), F.col("sha").alias("text_sha256"))
    out = named(sized(_runs(cold, COLD), COLD), "size")
    if hot is None:
        return out
    rows = sized(_runs(hot, HOT).withColumn("norm", F.when(F.col("fresh"), F.col("norm"))), HOT)  # the first of a run is compared once more
    rows = materialize(rows.drop("first"), "hot-runs")
    groups = _whole_groups(rows.filter("fresh")).select("head", "sha", "salt", "run", "first", "all_rows")
    return out.unionByName(named(rows.drop("norm").join(F.broadcast(groups), ["head", "sha", "salt", "run"]), "all_rows"))


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cold, hot = _prepared(packed, "_id", "_text", "_row")
    out = _runs(cold, COLD, "_row", text_col).filter("fresh").select("_row.*")
    if hot is None:
        return out
    leads = _whole_groups(_runs(hot, HOT, "_row", text_col).filter("fresh").withColumn("size", F.lit(1)))
    return out.unionByName(leads.filter(F.col("first.at") == F.col("at")).select("_row.*"))
