"""Hard negatives by a two-dimensional block matrix multiply in the manner of SUMMA.

Components become whole numbers, so scores are exact. Rows are dealt to blocks and their
dimensions to chunks. The panel of an anchor block goes to every block of candidates and
the reverse, so each (anchor block, candidate block, chunk) meets in one group, which
multiplies its two panels into a partial tile of 64-bit scores. Partial tiles are shuffled
by (anchor block, candidate block) and added, and each tile is reduced where it is added:
only the first rows of each anchor, or of each window of an anchor and a positive, leave it.

Two such products are taken. The first pairs rows of one label and finds the positives; a
label of many rows has many blocks. The second pairs all anchors with all rows, since
by then the windows are known, and rows outside of them never leave their tile. No group
holds more than one tile, whatever the labels are.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part. Of vectors of several lengths the common components count. Rows
that share the anchor's id are not its partners; otherwise repeated rows count one by one, a
repeated anchor gives its rows once for each. An empty vector scores zero with all. A table without
rows or anchors gives an empty result. Other columns have no influence. Scores
are 64-bit: components that don't fit them are clipped, and sums beyond them wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Rows of an anchor block and of a candidate block, dimensions of a chunk.
ANCHORS, CANDIDATES, CHUNK = 256, 2048, 32
#: Products of smaller numbers than this are exact in doubles.
EXACT = 1 << 53

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PARTIAL = "grp long, i int, j int, layer int, a_row array<long>, a_id array<long>, a_label array<long>, b_row array<long>, b_id array<long>, b_label array<long>, wanted array<array<struct<id:long,row:long,score:long>>>, tile binary"
POSITIVES = "anchor_row long, anchor_id long, positive_row long, positive_id long, score long"
NEGATIVES = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, negative_row long, negative_id long, score long"


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def _panels(rows: DataFrame, layers: int, chunk: int) -> DataFrame:
    """One row for each (group, block, layer): the rows' ids and labels, and their chunks, one after another."""
    part = F.slice("q", F.col("layer") * chunk + 1, chunk)
    cut = rows.select("grp", "block", "row", "id", "label", "wanted", "q", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer")).withColumn(
        "part", F.concat(part, F.array_repeat(F.lit(0).cast("long"), F.lit(chunk) - F.size(part)))
    )
    one = F.array_sort(F.collect_list(F.struct("row", "id", "label", "part", "wanted")))
    packed = cut.groupBy("grp", "block", "layer").agg(one.alias("x"))
    first = F.col("layer") == 0  # only there ids are needed
    of = lambda c, kind: F.when(first, F.transform("x", lambda r: r[c])).otherwise(F.array().cast(kind))
    return packed.select(
        "grp", "block", "layer", F.size("x").alias("n"), of("row", "array<long>").alias("row"), of("id", "array<long>").alias("id"), of("label", "array<long>").alias("label"),
        F.flatten(F.transform("x", lambda r: r["part"])).alias("data"), of("wanted", "array<array<struct<id:long,row:long,score:long>>>").alias("wanted"),
    )


def _matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of ``a`` and the transposed ``b``, both of 64-bit whole numbers."""
    most = max(int(np.abs(a.astype(float)).max(initial=0)) * int(np.abs(b.astype(float)).max(initial=0)), 1) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _multiply(key: tuple, table: pa.Table) -> pa.Table:
    """The partial tile of one anchor panel and one candidate panel."""
    side = table["side"].to_pylist()
    schema = PARTIAL_ARROW
    if sorted(side) != ["a", "b"]:
        return schema.empty_table()
    a, b = table.slice(side.index("a"), 1), table.slice(side.index("b"), 1)
    matrix = lambda t: np.asarray(t["data"].combine_chunks().flatten()).reshape(t["n"][0].as_py(), -1)
    tile = np.ascontiguousarray(_matmul(matrix(a), matrix(b)))
    arrays = [pa.array([k.as_py()], f.type) for k, f in zip(key, schema, strict=False)]
    arrays += [t[c].combine_chunks().cast(schema.field(f"{s}_{c}").type) for s, t in (("a", a), ("b", b)) for c in ("row", "id", "label")]
    return pa.Table.from_arrays([*arrays, a["wanted"].combine_chunks().cast(schema.field("wanted").type), pa.array([tile.tobytes()], pa.binary())], schema=schema)


WANTED = pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])))
PARTIAL_ARROW = pa.schema(
    [("grp", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("layer", pa.int32())]
    + [(f"{s}_{c}", pa.list_(pa.int64())) for s in "ab" for c in ("row", "id", "label")]
    + [("wanted", WANTED), ("tile", pa.binary())]
)


class _Tile:
    """The sum of a tile's layers with the ids of its rows and columns."""

    def __init__(self, table: pa.Table):
        parts = [np.frombuffer(x.as_buffer(), np.int64) for x in table["tile"]]
        lead = table.slice(table["layer"].to_pylist().index(0), 1)
        get = lambda c: np.asarray(lead[c].combine_chunks().flatten())
        self.a_row, self.a_id, self.a_label, self.b_row, self.b_id, self.b_label = (get(f"{s}_{c}") for s in "ab" for c in ("row", "id", "label"))
        total = parts[0].copy()
        for p in parts[1:]:
            total += p
        self.scores = total.reshape(len(self.a_id), len(self.b_id))
        self.wanted = lead["wanted"].combine_chunks()

    def first(self, at: int, fits: np.ndarray, most: int) -> np.ndarray:
        """The columns of row ``at`` that come first among those that fit: higher scores, then smaller ids."""
        s, found = self.scores[at], np.flatnonzero(fits)
        if len(found) > most:
            cut = np.partition(s[found], len(found) - most)[len(found) - most]
            found = found[s[found] >= cut]
        return found[np.lexsort((self.b_row[found], self.b_id[found], ~s[found]))[:most]]


def _columns(rows: Iterator[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _first_positives(table: pa.Table, most: int) -> pa.Table:
    tile = _Tile(table)

    def rows() -> Iterator[tuple]:
        for at in range(len(tile.a_id)):
            found = tile.first(at, tile.b_id != tile.a_id[at], most)
            yield np.full(len(found), tile.a_row[at]), np.full(len(found), tile.a_id[at]), tile.b_row[found], tile.b_id[found], tile.scores[at, found]

    return _columns(rows(), _names(POSITIVES))


def _first_negatives(table: pa.Table, most: int, low: int, high: int) -> pa.Table:
    tile = _Tile(table)
    wanted = tile.wanted[0].as_py() if len(tile.wanted) else []

    def rows() -> Iterator[tuple]:
        for at, positives in enumerate(wanted):
            other = tile.b_label != tile.a_label[at]
            for p in positives or []:
                s, score = tile.scores[at], p["score"]
                least, top = -((-low * score) // 100), (high * score) // 100
                found = tile.first(at, other & (s >= least) & (s <= top), most)
                same = lambda x, n=len(found): np.full(n, x)
                yield same(tile.a_row[at]), same(tile.a_id[at]), same(p["row"]), same(p["id"]), same(score), tile.b_row[found], tile.b_id[found], s[found]

    return _columns(rows(), _names(NEGATIVES))


def _tiles(anchors: DataFrame, rows: DataFrame, layers: int, chunk: int) -> DataFrame:
    """The partial tiles of all pairs of blocks of a group; both sides name the other's number of blocks (``across``)."""
    a = _panels(anchors, layers, chunk).join(anchors.select("grp", "across").distinct(), "grp").select("*", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j")).withColumn("i", F.col("block"))
    b = _panels(rows, layers, chunk).join(rows.select("grp", "across").distinct(), "grp").select("*", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i")).withColumn("j", F.col("block"))
    columns = ["grp", F.col("i").cast("int"), F.col("j").cast("int"), F.col("layer").cast("int"), "n", "row", "id", "label", "data", "wanted"]
    both = a.select(F.lit("a").alias("side"), *columns).unionByName(b.select(F.lit("b").alias("side"), *columns))
    return both.groupBy("grp", "i", "j", "layer").applyInArrow(_multiply, PARTIAL)


def mine(
    df: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, chunk: int = CHUNK, anchor_rows: int = ANCHORS, candidate_rows: int = CANDIDATES,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    An anchor's positives are its first rows of the same label; for each, the first rows of other labels come
    whose score is from ``low`` to ``high`` per cent of the positive's.
    """
    spark, vector = df.sparkSession, F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & _finite(F.col("v")))
    rows = settle(rows.select("id", "label", "anchor", F.monotonically_increasing_id().alias("row"), whole_numbers(F.col("v"), scale).alias("q")), "negatives-rows")
    total, n_anchors, width = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("q"))).first()
    if not n_anchors:
        return spark.createDataFrame([], OUT)
    layers = max(1, -(-width // chunk))
    spot = lambda blocks: F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block")
    none = F.lit(None).cast("array<struct<id:long,row:long,score:long>>").alias("wanted")
    blocks_of = lambda n, size: F.ceil(n / F.lit(size)).cast("int")

    # the positives: blocks within a label
    sizes = rows.groupBy("label").agg(blocks_of(F.count("*"), candidate_rows).alias("n_j"), blocks_of(F.count_if("anchor"), anchor_rows).alias("n_i")).where("n_i > 0")
    sized = rows.join(sizes, "label")
    side = lambda part, own, other: part.select(F.col("label").alias("grp"), spot(F.col(own)), "row", "id", "label", none, "q", F.col(other).alias("across"))
    partial = _tiles(side(sized.where("anchor"), "n_i", "n_j"), side(sized, "n_j", "n_i"), layers, chunk)
    found = partial.groupBy("grp", "i", "j").applyInArrow(lambda t: _first_positives(t, positives), POSITIVES)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "positive_id", "positive_row")
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
    windows = best.groupBy("anchor_row").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_row").alias("row"), "score")).alias("wanted"))
    windows = settle(windows, "negatives-windows")

    # the negatives: blocks of all rows
    n_i, n_j = -(-n_anchors // anchor_rows), -(-total // candidate_rows)
    grp = F.lit(0).cast("long").alias("grp")
    asking = rows.where("anchor").join(windows, F.col("row") == F.col("anchor_row")).select(grp, spot(F.lit(n_i)), "row", "id", "label", "wanted", "q", F.lit(n_j).alias("across"))
    asked = rows.select(grp, spot(F.lit(n_j)), "row", "id", "label", none, "q", F.lit(n_i).alias("across"))
    partial = _tiles(asking, asked, layers, chunk)
    found = partial.groupBy("grp", "i", "j").applyInArrow(lambda t: _first_negatives(t, negatives, low, high), NEGATIVES)
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("score"), "negative_id", "negative_row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
